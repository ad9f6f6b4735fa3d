"""Navigation index of long documents: headings, endpoints and the rendered index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions import text as T

from . import lines as L

WS = T.WS

# Fixed values.
MIN_LINES = 500
ATX = rf"^(#{{1,6}}){WS}+(.+?){WS}*\z"
NUMBERED = rf"^{WS}*(\d+(?:\.\d+){{0,5}})\.?{WS}+({T.NON_WS}.{{0,120}})\z"
NAMED = rf"(?i)^{WS}*(Chapter|Section|Part|Appendix|Annex){WS}+([IVXLCDM]+|\d+)\b[\s\x1c-\x1f:.\-–—]*(.{{0,120}})?\z"
METHOD = rf"(?i)^{WS}*(Get|Post|Put|Patch|Delete){WS}+method{WS}*[:\-]?{WS}*(/[A-Za-z0-9_\-{{}}/.]+)"
INLINE = rf"(?i)^{WS}*(GET|POST|PUT|PATCH|DELETE){WS}+(/[A-Za-z0-9_\-{{}}/.]+){WS}*\z"
CODE = r"[(){}\[\]<>=;*+|/\\\"'`]"
STOPS = r"[.:,;]\z"
API = ("api", "v1", "v2")


def should_index(text: Column | str) -> Column:
    """The text has MIN_LINES lines or more."""
    return F.size(F.split(T.col(text), "\n", -1)) >= MIN_LINES


def looks_like_code(c: Column | str) -> Column:
    """F12."""
    return T.has(c, CODE)


def real_heading_text(c: Column | str) -> Column:
    """two characters or more, not only digits, stops, commas and spaces."""
    bare = T.strip(c)
    digits = T.sub(bare, r"[., ]", "")
    return (F.char_length(bare) >= 2) & ~T.has(digits, r"^\d+\z")


def boilerplate(lines: DataFrame, min_repeats: int = 4) -> DataFrame:
    """Adds bare (the stripped line) and boiler, on lines of 3 to 120 characters that stand min_repeats times. Lines that have them stay as they are."""
    if "boiler" in lines.columns:
        return lines
    fit = F.char_length("bare").between(3, 120)
    out = lines.withColumn("bare", T.strip("line"))
    n = F.count("*").over(Window.partitionBy(L.KEY, "bare"))
    return out.withColumn("boiler", fit & (n >= min_repeats))


def _all_caps(s: Column) -> Column:
    letters = T.sub(s, r"\P{L}", "")
    return F.char_length(s).between(5, 80) & ~looks_like_code(s) & (F.char_length(letters) >= 4) & T.has(letters, r"^\p{Lu}+\z") & ~T.has(s, STOPS) & F.size(T.words(s)).between(1, 10)


def _title_case(s: Column) -> Column:
    words = F.filter(T.words(s), lambda w: T.has(w, r"\p{L}"))
    capped = F.size(F.filter(words, lambda w: T.has(w, r"^\p{Lu}")))
    n = F.size(words)
    return F.char_length(s).between(8, 80) & ~looks_like_code(s) & ~T.has(s, STOPS) & n.between(2, 10) & (capped * 10 >= n * 7)


def headings(lines: DataFrame) -> DataFrame:
    """(doc_id, level, title, line_no from 1, kind): of each line the first kind of heading that it is."""
    out = _marked(lines).filter("h is not null")
    return out.select(L.KEY, "h.level", "h.title", (F.col("line_no") + 1).alias("line_no"), "h.kind")


def _marked(lines: DataFrame) -> DataFrame:
    """Lines with h, the heading that a line is, or null."""
    blank = lambda c: F.coalesce(T.is_blank(c), F.lit(True))
    nxt = F.coalesce(L.after("line"), F.lit(""))
    seen = boilerplate(lines).withColumns({"prev_blank": blank(L.before("line")), "next_blank": T.is_blank(nxt), "next_prose": F.char_length(T.strip(nxt)) > 60})
    open_ = (F.col("bare") != "") & ~F.col("boiler") & ~F.startswith("bare", F.lit("|"))
    hit = lambda ok, level, title, kind: F.when(ok, F.struct(level.cast("int").alias("level"), title.alias("title"), F.lit(kind).alias("kind")))
    line, s = F.col("line"), F.col("bare")
    num, rest = T.group(line, NUMBERED, 1), F.rtrim(T.strip(T.group(line, NUMBERED, 2)), F.lit("."))
    dots = F.char_length(num) - F.char_length(F.translate(num, ".", ""))
    numbered = T.has(line, NUMBERED) & real_heading_text(rest) & ~looks_like_code(rest) & ((dots > 0) | F.col("prev_blank"))
    tail = F.rtrim(T.strip(T.group(line, NAMED, 3)), F.lit("."))
    label = F.concat(T.title_case(T.group(line, NAMED, 1)), F.lit(" "), T.group(line, NAMED, 2), F.when(tail != "", F.concat(F.lit(" — "), tail)).otherwise(""))
    found = F.coalesce(
        hit(T.has(line, ATX), F.char_length(T.group(line, ATX, 1)), T.strip(T.group(line, ATX, 2)), "atx"),
        hit(numbered, F.least(F.lit(6), dots + 1), F.concat(num, F.lit(" "), rest), "numbered"),
        hit(T.has(line, NAMED), F.lit(1), label, "named"),
        hit(_all_caps(s) & (F.col("prev_blank") | F.col("next_blank") | F.col("next_prose")), F.lit(2), T.title_case(s), "caps"),
        hit(F.col("prev_blank") & F.col("next_prose") & _title_case(s), F.lit(3), s, "title"),
    )
    return seen.withColumn("h", F.when(open_, found))


def dedupe_headings(found: DataFrame, busy: int = 10) -> DataFrame:
    """I8: of a title that stands more than `busy` times keep the first, then of equal neighbours the first."""
    same = Window.partitionBy(L.KEY, "title")
    once = (F.count("*").over(same) <= busy) | (F.row_number().over(same.orderBy("line_no")) == 1)
    out = found.withColumn("_once", once).filter("_once").drop("_once")
    return out.withColumn("_prev", L.before("title")).filter(~F.col("title").eqNullSafe(F.col("_prev"))).drop("_prev")


def group_key(path: Column | str) -> Column:
    """I10."""
    parts = F.filter(F.split(T.col(path), "/", -1), lambda x: x != "")
    inner = (F.size(parts) >= 2) & F.lower(F.get(parts, F.lit(0))).isin(*API)
    return F.coalesce(F.when(inner, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0))), T.col(path))


def endpoints(lines: DataFrame) -> DataFrame:
    """(doc_id, method, path, line_no from 1, grp)."""
    out = boilerplate(lines).withColumn("e", _endpoint()).filter("e is not null")
    return _endpoint_rows(out)


def _endpoint() -> Column:
    hit = lambda p: F.when(T.has("line", p), F.struct(F.upper(T.group("line", p, 1)).alias("method"), F.rtrim(T.group("line", p, 2), F.lit(".")).alias("path")))
    return F.when(~F.col("boiler"), F.coalesce(hit(METHOD), hit(INLINE)))


def _endpoint_rows(out: DataFrame) -> DataFrame:
    return out.select(L.KEY, "e.method", "e.path", (F.col("line_no") + 1).alias("line_no"), group_key("e.path").alias("grp"))


def endpoint_groups(found: DataFrame) -> DataFrame:
    """(doc_id, grp, place of the group, members in source order)."""
    members = F.array_sort(F.collect_list(F.struct("line_no", "method", "path")))
    out = found.groupBy(L.KEY, "grp").agg(members.alias("members"), F.min("line_no").alias("first"))
    place = F.row_number().over(Window.partitionBy(L.KEY).orderBy(F.lower("grp"), "first"))
    return out.select(L.KEY, "grp", (place - 1).alias("place"), "members")


def render_index(docs: DataFrame, name: Column | str = "source", text: str = "text") -> DataFrame:
    """(doc_id, index) for documents long enough to have one."""
    long = docs.filter(should_index(text)).select(L.KEY, F.col(text).alias("text"), T.col(name).alias("_name"))
    # The lines that the index names, found in one pass: both branches read this one exchange.
    named = _marked(L.to_lines(long)).withColumn("e", _endpoint()).filter("h is not null or e is not null").select(L.KEY, "line_no", "h", "e").repartition(L.KEY)
    heads = dedupe_headings(named.filter("h is not null").select(L.KEY, "h.level", "h.title", (F.col("line_no") + 1).alias("line_no"), "h.kind"))
    entry = F.concat(F.repeat(F.lit("  "), F.greatest(F.col("level") - 1, F.lit(0))), F.lit("- "), F.col("title"), F.lit(" (line "), F.col("line_no"), F.lit(")"))
    heads = heads.groupBy(L.KEY).agg(F.array_sort(F.collect_list(F.struct("line_no", entry.alias("s")))).alias("_heads"))
    member = lambda m: F.concat(F.lit("- `"), m["method"], F.lit(" "), m["path"], F.lit("` (line "), m["line_no"], F.lit(")"))
    section = F.concat(F.lit("### "), F.col("grp"), F.lit("\n\n"), F.array_join(F.transform("members", member), "\n"))
    ends = endpoint_groups(_endpoint_rows(named.filter("e is not null")))
    ends = ends.groupBy(L.KEY).agg(F.array_sort(F.collect_list(F.struct("place", section.alias("s")))).alias("_ends"), F.sum(F.size("members")).alias("_n_ends"))
    out = long.join(heads, L.KEY, "left").join(ends, L.KEY, "left")
    n_heads, n_ends = F.coalesce(F.size("_heads"), F.lit(0)), F.coalesce("_n_ends", F.lit(0))
    parts = F.concat_ws(", ", F.when(n_heads > 0, F.concat(n_heads.cast("string"), F.lit(" sections"))), F.when(n_ends > 0, F.concat(n_ends.cast("string"), F.lit(" endpoints"))))
    summary = F.when(parts == "", "no structured sections detected").otherwise(parts)
    title = F.when(F.coalesce(F.col("_name"), F.lit("")) == "", "# Index").otherwise(F.concat(F.lit("# Index of "), F.col("_name")))
    # The texts of the index.
    body = F.concat_ws(
        "\n\n",
        title,
        F.concat(F.lit("Auto-generated navigation index. "), summary, F.lit(". Line numbers refer to the main file.")),
        F.when(n_heads > 0, F.concat(F.lit("## Sections\n\n"), F.array_join(F.transform("_heads", lambda x: x["s"]), "\n"))),
        F.when(n_ends > 0, F.concat(F.lit("## Endpoints\n\n"), F.array_join(F.transform("_ends", lambda x: x["s"]), "\n\n"))),
        F.when((n_heads == 0) & (n_ends == 0), "_No headings, sections, or endpoint patterns were detected._"),
    )
    return out.select(L.KEY, F.concat(T.rstrip(body), F.lit("\n")).alias("index"))
