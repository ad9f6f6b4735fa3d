"""The conversion queue: destinations, routing, warnings, endpoints and model predicates (SRC3-4, F1-F9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docflow.functions import text as T

from .media import stem, suffix

# Fixed values.
SUPPORTED = (
    ".pdf", ".docx", ".doc", ".pptx", ".ppt", ".xlsx", ".xls", ".csv", ".tsv", ".html", ".htm", ".xml", ".json", ".txt", ".md", ".rtf", ".epub", ".png",
    ".jpg", ".jpeg", ".bmp", ".tiff", ".gif", ".mp3", ".wav", ".m4a", ".flac", ".zip",
)
NEAR_EMPTY = 50
VISION_PATTERNS = (
    "gpt-4o", "gpt-4-vision", "gpt-4-turbo", "gpt-5", "o1", "o3", "chatgpt-4o", "claude-3", "claude-4", "claude-opus", "claude-sonnet", "claude-haiku",
    "gemini", "gemma-3", "gemma3", "llama-3.2-11b-vision", "llama-3.2-90b-vision", "llama3.2-vision", "llama-3.2-vision", "llama-4", "qwen-vl",
    "qwen2-vl", "qwen2.5-vl", "qwen3-vl", "qwen2.5-omni", "internvl", "internlm-xcomposer", "moondream", "minicpm-v", "minicpm-llama3-v", "minicpm-o",
    "pixtral", "molmo", "phi-3-vision", "phi-3.5-vision", "phi-4-multimodal", "llava", "bakllava", "obsidian", "cogvlm", "cogagent", "glm-4v", "yi-vl",
    "deepseek-vl", "reka-", "-vl-", "-vision", "-multimodal", "vlm",
)
PROVIDERS = (
    ("Custom", "", ""),
    ("OpenAI", "https://api.openai.com/v1", "gpt-4o"),
    ("Google Gemini", "https://generativelanguage.googleapis.com/v1beta/openai/", "gemini-2.0-flash"),
    ("Groq", "https://api.groq.com/openai/v1", "meta-llama/llama-4-scout-17b-16e-instruct"),
    ("OpenRouter", "https://openrouter.ai/api/v1", "google/gemini-2.0-flash-exp:free"),
    ("Mistral", "https://api.mistral.ai/v1", "pixtral-12b-2409"),
    ("Azure OpenAI", "https://YOUR-RESOURCE.openai.azure.com/openai/v1", "gpt-4o"),
    ("LM Studio (local)", "http://localhost:1234/v1", ""),
    ("Ollama (local)", "http://localhost:11434/v1", ""),
)
#: Error classes in the order in which they are tried: name, words in the message, words in the error's class.
ERRORS = (
    ("memory", ("memory", "oom"), ()),
    ("connection", ("connection",), ("connection",)),
    ("auth", ("401", "unauthorized"), ("auth",)),
    ("not_found", ("404", "not found", "does not exist"), ()),
    ("timeout", ("timed out",), ("timeout",)),
)


def providers(spark: SparkSession) -> DataFrame:
    """Provider presets in display order."""
    return spark.createDataFrame([(i, *p) for i, p in enumerate(PROVIDERS)], "place int, name string, endpoint string, model string")


def supported(path: Column | str) -> Column:
    """SRC1's filter: the suffix is one of SUPPORTED, whatever its case."""
    return suffix(path).isin(*SUPPORTED)


def enqueue(paths: DataFrame, path: str = "path", order: str = "pos") -> DataFrame:
    """SRC3: each path once; queue_pos is the place where it came first, so a queue of any length needs no one task."""
    return paths.groupBy(F.col(path).alias("source")).agg(F.min(order).alias("queue_pos"))


def enqueue_by(paths: DataFrame, batch: str, path: str = "path", order: str = "pos") -> DataFrame:
    """SRC3 for many queues at once, told apart by `batch`, with queue_pos from 0 without gaps."""
    first = paths.groupBy(batch, path).agg(F.min(order).alias("_at"))
    return first.select(batch, F.col(path).alias("source"), (F.row_number().over(Window.partitionBy(batch).orderBy("_at", path)) - 1).alias("queue_pos"))


def remove(queue: DataFrame, chosen: DataFrame) -> DataFrame:
    """SRC4: the queue without the chosen sources."""
    return queue.join(chosen.select("source"), "source", "left_anti")


def destination(source: Column | str, out_root: Column | str, in_root: Column | str | None = None) -> Column:
    """mirror the source's place below in_root, or flatten to its stem where it lies elsewhere."""
    src, out = T.col(source), F.rtrim(T.col(out_root), F.lit("/"))
    flat = F.concat(out, F.lit("/"), stem(src), F.lit(".md"))
    if in_root is None:
        return flat
    root = F.concat(F.rtrim(T.col(in_root), F.lit("/")), F.lit("/"))
    rel = F.substring(src, F.char_length(root) + 1, F.char_length(src))
    folder = F.regexp_extract(rel, r"^(.*/)", 1)
    return F.when(F.startswith(src, root), F.concat(out, F.lit("/"), folder, stem(src), F.lit(".md"))).otherwise(flat)


def collisions(queue: DataFrame, dest: str = "destination") -> DataFrame:
    """Q9: adds collision, the place of a row among those that go to one destination (0 wins without overwriting)."""
    return queue.withColumn("collision", F.row_number().over(Window.partitionBy(dest).orderBy("queue_pos")) - 1)


def route(ocr: Column, is_scanned: Column | str) -> Column:
    """F2."""
    return F.when(ocr & F.coalesce(T.col(is_scanned), F.lit(False)), "OCR").otherwise("text")


def needs_ocr(queue: DataFrame) -> DataFrame:
    """whether any row is scanned; only then is an OCR converter made."""
    return queue.agg(F.coalesce(F.bool_or("is_scanned"), F.lit(False)).alias("needs_ocr"))


def strips_running_lines(path: Column | str) -> Column:
    """PDF and DOCX lose running headers and footers ..."""
    return suffix(path).isin(".pdf", ".docx")


def strips_page_numbers(path: Column | str) -> Column:
    """... and PDF its page numbers."""
    return suffix(path) == ".pdf"


def near_empty(text: Column | str) -> Column:
    """fewer than NEAR_EMPTY characters, white space among them."""
    return F.char_length(T.col(text)) < NEAR_EMPTY


def image_mode(embed: Column | bool, extract: Column | bool) -> Column:
    """embedding wins over extraction."""
    flag = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(flag(embed), "embed").when(flag(extract), "extract").otherwise("none")


def check_credentials(api_key: Column | str, base_url: Column | str) -> Column:
    """what is missing, or null: a key is needed unless an endpoint of one's own is given."""
    given = (T.strip(F.coalesce(T.col(api_key), F.lit(""))) != "") | (T.strip(F.coalesce(T.col(base_url), F.lit(""))) != "")
    return F.when(~given, "an API key or an endpoint is needed")


def is_vision_model(model: Column | str, patterns: Sequence[str] = VISION_PATTERNS) -> Column:
    """the lower-cased id holds one of the patterns."""
    low = F.lower(F.coalesce(T.col(model), F.lit("")))
    return F.exists(F.array(*map(F.lit, patterns)), lambda p: F.contains(low, p))


def normalise_endpoint(url: Column | str) -> Column:
    """F8: without slashes at the end, and with /v1 if it has no path."""
    bare = F.rtrim(T.col(url), F.lit("/"))
    path = F.regexp_extract(bare, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.when((bare == "") | (path != ""), bare).otherwise(F.concat(bare, F.lit("/v1")))


def diagnose(message: Column | str, error_class: Column | str) -> Column:
    """the first of ERRORS whose words are found, or else default."""
    text, kind = F.lower(F.coalesce(T.col(message), F.lit(""))), F.lower(F.coalesce(T.col(error_class), F.lit("")))
    out = F.lit("default")
    for name, words, classes in reversed(ERRORS):
        found = F.lit(False)
        for w in words:
            found = found | F.contains(text, F.lit(w))
        for c in classes:
            found = found | F.contains(kind, F.lit(c))
        out = F.when(found, name).otherwise(out)
    return out


def vision_models(models: Column) -> tuple[Column, Column]:
    """The models of an array that see, and those that do not (array difference)."""
    seeing = F.filter(models, lambda m: is_vision_model(m))
    return seeing, F.array_except(models, seeing)


def totals(results: DataFrame, status: str = "status") -> DataFrame:
    """Success and failure totals of a run."""
    return results.agg(F.count_if(F.col(status) == "ok").alias("succeeded"), F.count_if(F.col(status) != "ok").alias("failed"))
