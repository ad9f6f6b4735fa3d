"""File sources: folder scans, ZIP media, converters, settings and model lists (SRC1-SRC13, U1, U2, U5)."""

from __future__ import annotations

import functools
import io
import json
import posixpath
import re
import struct
import zipfile
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.functions import text as T
from docflow.functions.shared import small_batches
from docflow.operators.media import IMAGE_EXTENSIONS, MEDIA_PREFIX, suffix
from docflow.operators.queue import SUPPORTED

from . import ole, pdf


def scan_folder(spark: SparkSession, folder: str, extensions: Sequence[str] = SUPPORTED) -> DataFrame:
    """SRC1: path, modificationTime, length, content of files below folder with these suffixes.

    The filter is on the path, so a file's content is read only if a later step uses it.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return _with_empty(found).filter(suffix("path").isin(*extensions))


def read_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """SRC2."""
    return _with_empty(spark.read.format("binaryFile").load(list(paths)))


_EMPTY = re.compile(r"\{path=(.*); isDirectory=false; length=0; .*?modification_time=(\d+)")
_LISTED = 10_000  # files whose listing the driver looks at in one go


def _with_empty(found: DataFrame) -> DataFrame:
    """Spark lists empty files and then reads no row of them: add theirs."""
    listed = found._jdf.queryExecution().analyzed().relation().location().allFiles()
    empty = []
    for lo in range(0, listed.size(), _LISTED):
        empty += _EMPTY.findall(listed.slice(lo, lo + _LISTED).mkString("\n"))
    if not empty:
        return found
    rows = found.sparkSession.createDataFrame([(path, int(ms)) for path, ms in empty], "path string, ms long")
    return found.unionByName(rows.select("path", F.timestamp_millis("ms").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")))


def accepts_pdf(path: Column | str, mime: Column | str | None = None) -> Column:
    """SRC7: by suffix or by media type."""
    by_name = suffix(path) == ".pdf"
    if mime is None:
        return by_name
    kind = F.lower(F.coalesce(T.col(mime), F.lit("")))
    return by_name | F.startswith(kind, F.lit("application/pdf")) | F.startswith(kind, F.lit("application/x-pdf"))


def with_fallback(primary: Column | str, fallback: Column | str) -> Column:
    """SRC8: the fallback where the primary result is null or empty."""
    return F.coalesce(F.nullif(T.col(primary), F.lit("")), T.col(fallback))


# --- ZIP documents --------------------------------------------------------------------


def zip_images(path: str, content: bytes) -> Iterator[tuple[str, bytes, str]]:
    """SRC9: (entry, bytes, suffix) of a ZIP document's images; nothing where it cannot be opened."""
    ext = posixpath.splitext(path.lower())[1]
    prefix = MEDIA_PREFIX.get(ext)
    if prefix is None and ext != ".epub":
        return
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, OSError, ValueError):
        return
    with archive:
        for info in archive.infolist():
            name, kind = info.filename, posixpath.splitext(info.filename.lower())[1]
            if info.is_dir() or kind not in IMAGE_EXTENSIONS or (prefix and not name.lower().startswith(prefix)):
                continue
            try:
                data = archive.read(info)
            except Exception:  # an entry that cannot be read is left out, as an empty one is
                data = b""
            if data:
                yield name, data, kind


def media(files: DataFrame, key: str = "path") -> DataFrame:
    """SRC9 over binaryFile rows: key, ord, entry_name, content, ext."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, path, content in zip(batch["key"], batch["path"], batch["content"], strict=True):
                rows = [(k, i, *x) for i, x in enumerate(zip_images(path, content))]
                yield pd.DataFrame(rows, columns=["key", "ord", "entry_name", "content", "ext"])

    small_batches(files.sparkSession)
    source = files.filter(suffix("path").isin(*MEDIA_PREFIX, ".epub")).select(F.col(key).cast("string").alias("key"), "path", "content")
    return source.mapInPandas(run, "key string, ord int, entry_name string, content binary, ext string").withColumnRenamed("key", key)


# --- converters -----------------------------------------------------------------------


class _Markdown(HTMLParser):
    """HTML to Markdown: headings, paragraphs, lists, links, images, emphasis, code and tables."""

    SKIP = {"script", "style", "noscript", "template", "head"}
    BLOCK = {"p", "div", "section", "article", "header", "footer", "main", "ul", "ol", "table", "blockquote", "figure", "nav", "aside", "form"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip, self.lists, self.links, self.pre = [], 0, [], [], False
        self.rows: list[list[str]] | None = None
        self.cell: list[str] | None = None

    def put(self, s: str) -> None:
        (self.out if self.cell is None else self.cell).append(s)

    def handle_starttag(self, tag, attrs):
        at = dict(attrs)
        if tag in self.SKIP:
            self.skip += 1
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.put("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append(0 if tag == "ol" else None)
            self.put("\n" if len(self.lists) > 1 else "\n\n")
        elif tag == "li":
            depth = max(len(self.lists) - 1, 0)
            if self.lists and self.lists[-1] is not None:
                self.lists[-1] += 1
                mark = f"{self.lists[-1]}."
            else:
                mark = "-"
            self.put("\n" + "  " * depth + mark + " ")
        elif tag == "br":
            self.put("\n")
        elif tag == "hr":
            self.put("\n\n---\n\n")
        elif tag == "a":
            self.links.append(at.get("href"))
            if at.get("href"):
                self.put("[")
        elif tag == "img":
            self.put(f"![{at.get('alt') or ''}]({at.get('src') or ''})")
        elif tag in ("b", "strong"):
            self.put("**")
        elif tag in ("i", "em"):
            self.put("*")
        elif tag == "pre":
            self.pre = True
            self.put("\n\n```\n")
        elif tag == "code" and not self.pre:
            self.put("`")
        elif tag == "table":
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows is not None:
            self.cell = []
        elif tag in self.BLOCK:
            self.put("\n\n")

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.put("\n" if self.lists else "\n\n")
        elif tag == "a":
            href = self.links.pop() if self.links else None
            if href:
                self.put(f"]({href})")
        elif tag in ("b", "strong"):
            self.put("**")
        elif tag in ("i", "em"):
            self.put("*")
        elif tag == "pre":
            self.pre = False
            self.put("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.put("`")
        elif tag in ("td", "th") and self.cell is not None and self.rows is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "table" and self.rows is not None:
            rows, self.rows, self.cell = self.rows, None, None
            self.put("\n\n" + table_markdown(rows) + "\n\n")
        elif tag in self.BLOCK or (len(tag) == 2 and tag[0] == "h"):
            self.put("\n\n")

    def handle_data(self, data):
        if self.skip or (self.rows is not None and self.cell is None):
            return
        if not self.pre:
            edge = (" " if data[:1].isspace() else "", " " if data[-1:].isspace() and data.strip() else "")
            data = " ".join(data.split()).join(edge)
            held = self.out if self.cell is None else self.cell
            if not held or held[-1][-1:].isspace():  # white space at the start of a block, or after other white space
                data = data.lstrip()
        if data:
            self.put(data)

    def text(self) -> str:
        lines, blank, code = [], True, False
        for line in "".join(self.out).split("\n"):
            line = line.rstrip()
            if line or code or not blank:
                lines.append(line if code or line.startswith("  ") else line.lstrip())
            code ^= line == "```"
            blank = not line
        return "\n".join(lines).strip()


def html_markdown(html: str | None) -> str:
    parser = _Markdown()
    parser.feed(html or "")
    parser.close()
    return parser.text()


def table_markdown(rows: list[list[str]]) -> str:
    """A plain Markdown table, the first row its header."""
    rows = [[c.replace("|", "\\|") for c in r] for r in rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    line = lambda r: "| " + " | ".join(r + [""] * (width - len(r))) + " |"
    return "\n".join([line(rows[0]), "|" + " --- |" * width, *map(line, rows[1:])])


def _text(raw: bytes) -> str:
    return raw.decode("utf-8-sig", "replace")


def _delimited(raw: bytes, sep: str) -> str:
    import csv

    rows = [[" ".join(c.split()) for c in r] for r in csv.reader(io.StringIO(_text(raw)), delimiter=sep)]
    return table_markdown(rows)


def _xml_texts(raw: bytes, block: str, run: str) -> Iterator[str]:
    for node in ElementTree.fromstring(raw).iter():
        if node.tag.rpartition("}")[2] == block:
            yield "".join(x.text or "" for x in node.iter() if x.tag.rpartition("}")[2] == run)


def _number(name: str) -> tuple[int, str]:
    digits = "".join(c for c in posixpath.basename(name) if c.isdigit())
    return int(digits or 0), name


#: What stands for an image whose bytes are not in the text; M8 finds them by ordinal.
CUT_SHORT = "data:image/png;base64..."


def _docx(raw: bytes) -> str:
    local = lambda e: e.tag.rpartition("}")[2]
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        out = []
        for p in ElementTree.fromstring(z.read("word/document.xml")).iter():
            if local(p) != "p":
                continue
            text = "".join((x.text or "") if local(x) == "t" else f"![]({CUT_SHORT})" if local(x) == "blip" else "" for x in p.iter())
            style = next((v for x in p.iter() if local(x) == "pStyle" for k, v in x.attrib.items() if k.endswith("val")), "")
            level = style.removeprefix("Heading")
            if text:
                out.append("#" * int(level) + " " + text if style.startswith("Heading") and level.isdigit() and 1 <= int(level) <= 6 else text)
        return "\n\n".join(out)


def _pptx(raw: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        slides = sorted((n for n in z.namelist() if n.startswith("ppt/slides/slide") and n.endswith(".xml")), key=_number)
        return "\n\n".join(f"<!-- Slide number: {i} -->\n" + "\n".join(t for t in _xml_texts(z.read(n), "p", "t") if t) for i, n in enumerate(slides, 1))


def _xlsx(raw: bytes) -> str:
    local = lambda e: e.tag.rpartition("}")[2]
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = list(_xml_texts(z.read("xl/sharedStrings.xml"), "si", "t")) if "xl/sharedStrings.xml" in z.namelist() else []
        names = [e.attrib.get("name", "") for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if local(e) == "sheet"]
        sheets = sorted((n for n in z.namelist() if n.startswith("xl/worksheets/sheet")), key=_number)
        out = []
        for i, n in enumerate(sheets):
            rows = []
            for row in (e for e in ElementTree.fromstring(z.read(n)).iter() if local(e) == "row"):
                cells = []
                for c in (e for e in row if local(e) == "c"):
                    value = "".join(x.text or "" for x in c.iter() if local(x) in ("v", "t"))
                    cells.append(shared[int(value)] if c.attrib.get("t") == "s" and value.isdigit() and int(value) < len(shared) else value)
                rows.append(cells)
            out.append(f"## {names[i] if i < len(names) else f'Sheet{i + 1}'}\n\n{table_markdown(rows)}")
        return "\n\n".join(out)


def _epub(raw: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        pages = [n for n in z.namelist() if n.lower().endswith((".xhtml", ".html", ".htm"))]
        return "\n\n".join(filter(None, (html_markdown(_text(z.read(n))) for n in pages)))


def _json(raw: bytes) -> str:
    return "```json\n" + json.dumps(json.loads(_text(raw)), indent=2, ensure_ascii=False) + "\n```"


def _xml(raw: bytes) -> str:
    ElementTree.fromstring(raw)
    return "```xml\n" + _text(raw).strip() + "\n```"


def _rtf(raw: bytes) -> str:
    s = re.sub(r"\{\\\*?\\?(?:fonttbl|colortbl|stylesheet|info|pict)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", raw.decode("latin-1"))
    s = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), s)
    s = re.sub(r"\\(?:par|line)\b ?", "\n", s)
    return re.sub(r"\\[a-zA-Z]+-?\d* ?|[{}]", "", s).strip()


def _xls(raw: bytes) -> str:
    return "\n\n".join(f"## {name}\n\n{table_markdown(rows)}" for name, rows in ole.xls(raw))


def image_size(raw: bytes) -> tuple[int, int] | None:
    """Width and height of a PNG, GIF, BMP, TIFF or JPEG file, as its head tells them."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", raw[16:24])
    if raw[:4] == b"GIF8":
        return struct.unpack("<HH", raw[6:10])
    if raw[:2] == b"BM":
        width, height = struct.unpack("<ii", raw[18:26])
        return width, abs(height)
    if raw[:4] in (b"II*\0", b"MM\0*"):
        end = "<" if raw[:2] == b"II" else ">"
        at = struct.unpack(end + "I", raw[4:8])[0]
        found = {}
        for i in range(struct.unpack_from(end + "H", raw, at)[0]):
            tag, kind = struct.unpack_from(end + "HH", raw, at + 2 + 12 * i)
            found[tag] = struct.unpack_from(end + ("H" if kind == 3 else "I"), raw, at + 10 + 12 * i)[0]
        return (found[256], found[257]) if 256 in found and 257 in found else None
    if raw[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(raw) and raw[at] == 255:
            if 0xC0 <= raw[at + 1] <= 0xCF and raw[at + 1] not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", raw[at + 5 : at + 9])
                return width, height
            at += 2 + struct.unpack(">H", raw[at + 2 : at + 4])[0]
    return None


def _image(raw: bytes) -> str:
    size = image_size(raw)
    if size is None:
        raise ValueError("not an image of a known kind")
    return f"ImageSize: {size[0]}x{size[1]}"


def _audio(raw: bytes) -> str:
    """What the head of an audio file tells; words are a transcriber's work, which may be registered."""
    import wave

    if raw[:4] == b"RIFF":
        with wave.open(io.BytesIO(raw)) as w:
            return f"NumChannels: {w.getnchannels()}\nSampleRate: {w.getframerate()}\nDuration: {w.getnframes() / (w.getframerate() or 1):.2f} s"
    if raw[:4] == b"fLaC":
        packed = int.from_bytes(raw[18:26], "big")
        rate, samples = packed >> 44, packed & (1 << 36) - 1
        return f"NumChannels: {(packed >> 41 & 7) + 1}\nSampleRate: {rate}\nDuration: {samples / (rate or 1):.2f} s"
    if raw[:3] == b"ID3" or raw[:2] in (b"\xff\xfb", b"\xff\xf3", b"\xff\xf2"):
        return "Format: MPEG audio"
    if raw[4:8] == b"ftyp":
        return "Format: MPEG-4 audio"
    raise ValueError("not an audio file of a known kind")


ARCHIVE_DEPTH, ARCHIVE_BYTES = 3, 1 << 28


def _archive(known: Registry, raw: bytes, depth: int = 0) -> str:
    """The files of a ZIP archive that convert, each under a heading with its name; archives within, three deep."""
    out, left = [], ARCHIVE_BYTES
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for info in z.infolist():
            left -= info.file_size
            if left < 0:
                raise ValueError("the archive unpacks to too many bytes")
            chosen = known.pick(info.filename)
            inner = info.filename.lower().endswith(".zip")
            if info.is_dir() or (chosen is None and not info.filename.lower().endswith(".pdf")) or (inner and depth + 1 >= ARCHIVE_DEPTH):
                continue
            data = z.read(info)
            try:
                text = _archive(known, data, depth + 1) if inner else chosen.convert(data) if chosen else pdf.plain_text(data)
            except Exception as e:
                text = f"*[failed: {type(e).__name__}: {e}]*"
            out.append(f"## File: {info.filename}\n\n{text}")
    return "\n\n".join(out)


Convert = Callable[[bytes], str]


@dataclass(order=True)
class Converter:
    """Of the converters that accept a suffix, the one of least priority converts, later ones first among equals."""

    priority: float
    order: int
    extensions: tuple[str, ...] = field(compare=False)
    convert: Convert = field(compare=False)
    name: str = field(compare=False, default="")


class Registry:
    """Converters by priority. Built-ins stand at 0; what is registered goes before them by default.

    PDF has none among them: the page operators lay it out (plans/convert.py), unless one is registered.
    """

    def __init__(self):
        self.items: list[Converter] = []
        for extensions, f in (
            ((".txt", ".md"), _text),
            ((".csv",), lambda b: _delimited(b, ",")),
            ((".tsv",), lambda b: _delimited(b, "\t")),
            ((".html", ".htm"), lambda b: html_markdown(_text(b))),
            ((".json",), _json),
            ((".xml",), _xml),
            ((".rtf",), _rtf),
            ((".docx",), _docx),
            ((".pptx",), _pptx),
            ((".xlsx",), _xlsx),
            ((".epub",), _epub),
            ((".doc",), ole.doc),
            ((".xls",), _xls),
            ((".ppt",), ole.ppt),
            ((".png", ".jpg", ".jpeg", ".bmp", ".tiff", ".gif"), _image),
            ((".mp3", ".wav", ".m4a", ".flac"), _audio),
            ((".zip",), functools.partial(_archive, self)),
        ):
            self.register(extensions, f, 0.0)

    def register(self, extensions: Sequence[str], convert: Convert, priority: float = -1.0, name: str = "") -> None:
        self.items.append(Converter(priority, -len(self.items), tuple(extensions), convert, name))

    def pick(self, path: str) -> Converter | None:
        ext = posixpath.splitext(path.lower())[1]
        return min((c for c in self.items if ext in c.extensions), default=None)

    def has_ocr(self) -> bool:
        """whether a converter for scanned pages has been registered."""
        return any("OCR" in c.name for c in self.items)


def convert(files: DataFrame, registry: Registry | None = None, ocr: Convert | None = None) -> DataFrame:
    """SRC5, U2, U5: path, text, error, route of binaryFile rows (with is_scanned, if there is such a column).

    A file that fails gives a row with its error, never a failed job. Where ocr is given,
    scanned rows go to it, and its failure becomes a marker in the text.
    """
    known = registry or Registry()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content, scanned in zip(batch["path"], batch["content"], batch["is_scanned"], strict=True):
                by_ocr = ocr is not None and bool(scanned)
                try:
                    if by_ocr:
                        rows.append((path, ocr(content), None, "OCR"))
                        continue
                    chosen = known.pick(path)
                    if chosen is None and path.lower().endswith(".pdf"):
                        rows.append((path, pdf.plain_text(content), None, "text"))
                    elif chosen is None:
                        rows.append((path, None, "no converter accepts this file", "text"))
                    else:
                        rows.append((path, chosen.convert(content), None, "text"))
                except Exception as e:
                    rows.append((path, f"*[OCR failed: {e}]*" if by_ocr else None, f"{type(e).__name__}: {e}", "OCR" if by_ocr else "text"))
            yield pd.DataFrame(rows, columns=["path", "text", "error", "route"])

    small_batches(files.sparkSession)
    flag = F.coalesce("is_scanned", F.lit(False)) if "is_scanned" in files.columns else F.lit(False)
    return files.select("path", "content", flag.alias("is_scanned")).mapInPandas(run, "path string, text string, error string, route string")


def html_documents(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """SRC5 for tables of web pages: key, text; null where there is no page."""

    @F.pandas_udf("string")
    def markdown(s: pd.Series) -> pd.Series:
        return s.map(html_markdown, na_action="ignore")

    small_batches(pages.sparkSession)
    return pages.select(key, markdown(html).alias("text"))


# --- settings and model lists ---------------------------------------------------------


def settings(body: Column | str, schema: str, legacy: Column | str | None = None) -> Column:
    """SRC12: settings JSON with an explicit schema; where it is missing or invalid, the older file's."""
    read = lambda c: F.from_json(T.col(c), schema, {"mode": "PERMISSIVE"})
    return read(body) if legacy is None else F.coalesce(read(body), read(legacy))


def probe(endpoints: DataFrame, timeout: float = 1.5) -> DataFrame:
    """SRC13: GET {base_url}/models of each row (name, base_url): name, base_url, models, error. Errors are data."""
    import urllib.error
    import urllib.request

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, url in zip(batch["name"], batch["base_url"], strict=True):
                models, error = [], ""
                try:
                    request = urllib.request.Request(url.rstrip("/") + "/models", headers={"Authorization": "Bearer not-needed"})
                    with urllib.request.urlopen(request, timeout=timeout) as r:
                        found = json.loads(r.read())
                    found = found.get("data", []) if isinstance(found, dict) else []
                    models = sorted({m["id"] for m in found if isinstance(m, dict) and m.get("id")})
                except urllib.error.URLError as e:
                    error = str(e.reason)
                except Exception as e:
                    error = str(e)
                rows.append((name, url, models, error))
            yield pd.DataFrame(rows, columns=["name", "base_url", "models", "error"])

    return endpoints.select("name", "base_url").mapInPandas(run, "name string, base_url string, models array<string>, error string")


#: Local model servers, in the order in which they are tried.
LOCAL_SERVERS = (
    ("LM Studio", "http://localhost:1234/v1"),
    ("Ollama", "http://localhost:11434/v1"),
    ("vLLM", "http://localhost:8000/v1"),
    ("llama.cpp server", "http://localhost:8080/v1"),
    ("Text Generation WebUI", "http://localhost:5000/v1"),
)


def discover(spark: SparkSession, timeout: float = 1.5) -> DataFrame:
    """place, name, base_url, models, error of each local server, probed at the same time."""
    rows = spark.createDataFrame([(i, *s) for i, s in enumerate(LOCAL_SERVERS)], "place int, name string, base_url string")
    found = probe(rows.repartition(len(LOCAL_SERVERS), "base_url"), timeout)
    return rows.join(found.select("base_url", "models", "error"), "base_url").select("place", "name", "base_url", "models", "error")
