"""Documents as rows of lines, and the line states that other operators share.

Lines are (doc_id, line_no, line), line_no from 0. All windows partition by document, so a
chain of line operators takes the one shuffle that brings a document's lines together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions import text as T

KEY = "doc_id"
FENCE = r"^[ \t]{0,3}(?:```|~~~)"
FRONT_MATTER = rf"^---{T.WS}*\z"
HEADING = rf"^{T.WS}*#"
LIST_ITEM = rf"^{T.WS}*(?:[-*+]|\d+[.)]){T.WS}+"
TOP_ITEM = rf"^(?:[-*+]|\d+[.)]){T.WS}+"
ORDERED_ITEM = rf"^({T.WS}*)(\d+)([.)])({T.WS}+)(.*)\z"
NUMBERED_ITEM = rf"^{T.WS}*\d+[.)]{T.WS}"
BULLET_ITEM = rf"^{T.WS}*[-*+]{T.WS}"
BLOCK_START = rf"^{T.WS}*(?:#{{1,6}}{T.WS}|>|\||```|~~~|<)"


def ordered(key: str = KEY):
    return Window.partitionBy(key).orderBy("line_no")


def upto(key: str = KEY):
    return ordered(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def whole(key: str = KEY):
    return Window.partitionBy(key)


def to_lines(docs: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """(key, line_no, line) of every document; a null text has no lines, an empty one has one."""
    return docs.select(F.col(key), F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))


def from_lines(lines: DataFrame, key: str = KEY, *extra: Column) -> DataFrame:
    """Inverse of to_lines: lines joined in order by newline."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"), *extra)


def renumber(lines: DataFrame, *order: str, key: str = KEY) -> DataFrame:
    """Give lines places 0, 1, ... in the given order."""
    w = Window.partitionBy(key).orderBy(*(order or ("line_no",)))
    return lines.withColumn("line_no", F.row_number().over(w) - 1)


def with_fence(lines: DataFrame, key: str = KEY) -> DataFrame:
    """L2: in_fence. A marker toggles whatever its kind, belongs to the block, and an open block runs to the end."""
    mark = T.has("line", FENCE)
    return lines.withColumn("in_fence", mark | (F.sum(mark.cast("int")).over(upto(key)) % 2 == 1))


def with_front_matter(lines: DataFrame, key: str = KEY) -> DataFrame:
    """L3: fm_end, the line after the closing mark of front matter that opens at line 0; 0 without it."""
    mark = T.has("line", FRONT_MATTER)
    opens = F.max((mark & (F.col("line_no") == 0)).cast("int")).over(whole(key)) == 1
    close = F.min(F.when(mark & (F.col("line_no") > 0), F.col("line_no"))).over(whole(key))
    return lines.withColumn("fm_end", F.when(opens, F.coalesce(close + 1, F.lit(0))).otherwise(0))


def with_skip(lines: DataFrame, key: str = KEY) -> DataFrame:
    """L4: in_fence, fm_end and skip, their union."""
    out = with_front_matter(with_fence(lines, key), key)
    return out.withColumn("skip", F.col("in_fence") | (F.col("line_no") < F.col("fm_end")))


def blank(c: str = "line") -> Column:
    return T.is_blank(c)


def before(c: Column | str, key: str = KEY) -> Column:
    return F.lag(c).over(ordered(key))


def after(c: Column | str, key: str = KEY) -> Column:
    return F.lead(c).over(ordered(key))


def needs_blank_before(key: str = KEY) -> Column:
    """There is a line before, and it is not blank."""
    return F.coalesce(before(~blank(), key), F.lit(False))


def needs_blank_after(key: str = KEY) -> Column:
    return F.coalesce(after(~blank(), key), F.lit(False))
