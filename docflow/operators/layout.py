"""Page layout to Markdown (P1-P8), on pages as structs of text lines, tables and images.

A page row has doc_id, page_index, width, height, char_sizes array<double>, text, n_images,
text_lines array<struct<text, top, bottom, sizes array<double>>>,
tables array<struct<x0, top, x1, bottom, rows array<array<string>>>> and
images array<struct<xref, y, width, height>>. sources/pdf.py finds them in a PDF (P4).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions import text as T

from .grid import _let, clean_table
from .media import marker

# Fixed values.
RATIOS = ((1.8, 1), (1.45, 2), (1.2, 3))
LONGEST_HEADING, THINNEST_BAND, SCAN_CHARS, SCAN_SHARE = 120, 2.0, 50, 0.8
PAGE_STRUCT = (
    "doc_id long, page_index int, width double, height double, char_sizes array<double>, text string, n_images int, "
    "text_lines array<struct<text: string, top: double, bottom: double, sizes: array<double>>>, "
    "tables array<struct<x0: double, top: double, x1: double, bottom: double, rows: array<array<string>>>>, "
    "images array<struct<xref: int, y: double, width: int, height: int>>"
)


def body_size(sizes: Column | str) -> Column:
    """The most frequent size, rounded half-even to one decimal; of equals the first seen; 0 without any.

    Halves are judged on the decimal that a size prints as, which can differ from binary rounding.
    """
    real = F.transform(F.filter(T.col(sizes), lambda x: F.coalesce(x, F.lit(0.0)) != 0), lambda x: F.bround(x, 1))

    def best(r: Column) -> Column:
        told = F.transform(F.array_distinct(r), lambda v: F.struct(F.size(F.filter(r, lambda x: x == v)).alias("n"), (-F.array_position(r, v)).alias("at"), v.alias("v")))
        return F.coalesce(F.array_max(told)["v"], F.lit(0.0))

    return _let(F.coalesce(real, F.array().cast("array<double>")), best)


def body_sizes(chars: DataFrame, key: str, size: str, order: str) -> DataFrame:
    """P1 as an aggregate over rows of characters, for sizes that do not fit in one array."""
    seen = chars.filter(F.coalesce(F.col(size), F.lit(0.0)) != 0).withColumn("body_size", F.bround(F.col(size).cast("double"), 1))
    n = seen.groupBy(key, "body_size").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return n.groupBy(key).agg(F.max_by("body_size", F.struct(F.col("n"), -F.col("first"))).alias("body_size"))


def heading_level(ratio: Column) -> Column:
    """1 to 3, null for text of body size."""
    out = F.lit(None).cast("int")
    for least, level in reversed(RATIOS):
        out = F.when(ratio >= least, level).otherwise(out)
    return out


def heading_worthy(c: Column | str) -> Column:
    """three letters or more, and no pipe."""
    return (F.char_length(T.sub(c, r"\P{L}", "")) >= 3) & ~F.contains(T.col(c), F.lit("|"))


def band(lines: Column, top: Column, bottom: Column, body: Column) -> Column:
    """The text between two heights, larger lines as headings.

    A line lies in a band if its middle does: lines are not cut at a border.
    """
    inside = F.filter(F.coalesce(lines, F.array().cast("array<struct<text: string, top: double, bottom: double, sizes: array<double>>>")), lambda x: ((x["top"] + x["bottom"]) / 2 >= top) & ((x["top"] + x["bottom"]) / 2 < bottom))

    def line(x: Column) -> Column:
        real = F.filter(x["sizes"], lambda s: F.coalesce(s, F.lit(0.0)) != 0)
        mean = F.aggregate(real, F.lit(0.0), lambda a, s: a + s) / F.nullif(F.size(real), F.lit(0))
        text = T.strip(x["text"])
        level = F.when((body > 0) & (F.char_length(text) <= LONGEST_HEADING), heading_level(mean / body))
        head = F.concat(F.lit("\n"), F.repeat(F.lit("#"), level), F.lit(" "), text, F.lit("\n"))
        return F.when(level.isNotNull() & heading_worthy(text), head).otherwise(text)

    texts = F.filter(F.transform(inside, line), lambda s: s != "")
    return F.when(bottom - top < THINNEST_BAND, "").otherwise(T.strip(F.array_join(texts, "\n")))


def page_markdown(page: DataFrame, markers: bool = False, *extra: Column) -> DataFrame:
    """doc_id, page_index, markdown and what extra asks for. Bands, tables and image markers in reading order.

    The cursor after a table is its bottom, even where a table overlaps the one before, so
    it is a fold over obstacles by (top, tables first). Empty results fall back to the page's text (SRC8).
    """
    tables = F.filter(F.transform(F.coalesce("tables", F.array().cast("array<struct<x0: double, top: double, x1: double, bottom: double, rows: array<array<string>>>>")), lambda t: F.struct(t["top"].alias("top"), F.lit(0).alias("kind"), t["bottom"].alias("bottom"), clean_table(t["rows"]).alias("md"))), lambda o: o["md"].isNotNull())
    if markers:
        real = F.filter(F.coalesce("images", F.array().cast("array<struct<xref: int, y: double, width: int, height: int>>")), lambda i: real_image(i))
        images = F.transform(real, lambda i: F.struct(i["y"].alias("top"), F.lit(1).alias("kind"), i["y"].alias("bottom"), marker(i["xref"], i["width"], i["height"]).alias("md")))
        tables = F.concat(tables, images)
    out = page.withColumn("_body", body_size("char_sizes")).withColumn("_obstacles", F.array_sort(tables, lambda a, b: F.when(a["top"] < b["top"], -1).when(a["top"] > b["top"], 1).otherwise(a["kind"] - b["kind"])))
    chunk = lambda at, md: F.struct(at.cast("double").alias("at"), md.alias("md"))
    start = F.struct(F.lit(0.0).alias("cursor"), F.array().cast("array<struct<at: double, md: string>>").alias("out"))

    def step(a: Column, o: Column) -> Column:
        above = F.when(o["top"] > a["cursor"], band(F.col("text_lines"), a["cursor"], o["top"], F.col("_body"))).otherwise("")
        grown = F.concat(a["out"], F.filter(F.array(chunk(a["cursor"], above), chunk(o["top"], o["md"])), lambda c: c["md"] != ""))
        cursor = F.when(o["kind"] == 0, o["bottom"]).otherwise(F.greatest(a["cursor"], o["top"]))
        return F.struct(cursor.alias("cursor"), grown.alias("out"))

    def finish(a: Column) -> Column:
        rest = F.when(a["cursor"] < F.col("height"), band(F.col("text_lines"), a["cursor"], F.col("height"), F.col("_body"))).otherwise("")
        return F.concat(a["out"], F.filter(F.array(chunk(a["cursor"], rest)), lambda c: c["md"] != ""))

    chunks = F.aggregate("_obstacles", start, step, finish)
    placed = F.array_sort(F.transform(chunks, lambda c, i: F.struct(c["at"].alias("at"), i.alias("i"), c["md"].alias("md"))))
    text = F.array_join(F.transform(placed, lambda c: c["md"]), "\n\n")
    return out.select("doc_id", "page_index", F.coalesce(F.nullif(text, F.lit("")), T.strip(F.coalesce("text", F.lit("")))).alias("markdown"), *extra)


def document_markdown(pages: DataFrame, *extra: Column) -> DataFrame:
    """doc_id, markdown and extra aggregates: pages with text, in order, a blank line between."""
    rows = F.array_sort(F.collect_list(F.when(F.col("markdown") != "", F.struct("page_index", "markdown"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["markdown"]), "\n\n").alias("markdown"), *extra)


def scanned(pages: DataFrame, key: str = "doc_id", text: str = "text", images: str = "n_images", chars: int = SCAN_CHARS, share: float = SCAN_SHARE) -> DataFrame:
    """Key, n_pages, n_scanned, is_scanned: most pages have an image and next to no text."""
    hit = (F.char_length(T.strip(F.coalesce(text, F.lit("")))) < chars) & (F.coalesce(images, F.lit(0)) > 0)
    out = pages.groupBy(key).agg(F.count("*").alias("n_pages"), F.count_if(hit).alias("n_scanned"))
    return out.withColumn("is_scanned", F.col("n_scanned") >= F.col("n_pages") * share)


def unique_images(pages: DataFrame) -> DataFrame:
    """SRC10: images of a document, each xref once, where it comes first."""
    flat = pages.select("doc_id", "page_index", F.posexplode("images").alias("pos", "i")).select("doc_id", "page_index", "pos", "i.*")
    first = F.row_number().over(Window.partitionBy("doc_id", "xref").orderBy("page_index", "pos"))
    return flat.withColumn("_n", first).filter("_n = 1").drop("_n")


def real_image(i: Column, least: int = 4) -> Column:
    """a real xref, a place, and both sides of `least` pixels or more."""
    return F.coalesce((i["xref"] > 0) & i["y"].isNotNull() & (i["width"] >= least) & (i["height"] >= least), F.lit(False))


def image_markers(pages: DataFrame) -> DataFrame:
    """SRC11: every placement of a real image."""
    flat = pages.select("doc_id", "page_index", F.posexplode("images").alias("pos", "i")).filter(real_image(F.col("i"))).select("doc_id", "page_index", "pos", "i.*")
    return flat.select("doc_id", "page_index", "y", marker(F.col("xref"), F.col("width"), F.col("height")).alias("placeholder"))
