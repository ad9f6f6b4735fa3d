"""Cell grids (array<array<string>>, first row the header) to Markdown tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docflow.functions import text as T

# Fixed values.
LONG_CELL, LONG_SHARE, MIN_ROWS, MIN_COLUMNS, MIN_WIDTH = 120, 0.3, 2, 2, 3
ZEBRA_ROWS, ZEBRA_PAIRS, ZEBRA_SHARE = 4, 2, 0.7

def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _upto(n: Column) -> Column:
    """0 .. n-1, empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _width(g: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(g, F.size)), F.lit(0))


def cell(c: Column) -> Column:
    """Null to the empty string, line breaks to spaces, stripped, pipes escaped."""
    s = c.cast("string")
    bare = lambda x: (x >= "!") & (x < "\x7f") & F.right(x, F.lit(1)).between("!", "~")  # noqa: E731  # nothing to strip: most cells
    fully = lambda x: F.when(bare(x), x).otherwise(T.strip(x))
    out = F.when(bare(s), s).when(s != "", _let(F.btrim(s, F.lit(" \t\r\n")), fully)).otherwise("")
    for old, new in (("\r", " "), ("\n", " "), ("|", "\\|")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def normalise(g: Column) -> Column:
    """Clean cells, and rows padded to one width."""
    return _let(_width(g), lambda w: F.transform(g, lambda r: F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), w - F.size(r)))))


def drop_empty_rows(g: Column) -> Column:
    """T3."""
    return F.filter(g, lambda r: F.exists(r, lambda c: c != ""))


def drop_empty_columns(g: Column) -> Column:
    """T4."""

    def kept(width: Column) -> Column:
        filled = F.filter(_upto(width), lambda i: F.exists(g, lambda r: F.get(r, i) != ""))
        return _let(filled, lambda keep: F.when(F.size(keep) == width, g).otherwise(F.transform(g, lambda r: F.transform(keep, lambda i: F.get(r, i)))))

    return _let(_width(g), kept)


def merge_zebra_rows(g: Column) -> Column:
    """T5: where rows come in complementary pairs, each pair becomes one row; the left cell wins."""

    def pairs(starts: Column) -> Column:
        def tell(i: Column) -> Column:  # 2: the pair is complementary, 1: it is not, 0: one of it is empty
            a, b = F.get(g, i), F.get(g, i + 1)
            both = F.exists(F.zip_with(a, b, lambda x, y: (x != "") & (y != "")), lambda x: x)
            filled = F.exists(a, lambda x: x != "") & F.exists(b, lambda x: x != "")
            return F.when(filled, F.when(both, 1).otherwise(2)).otherwise(0)

        return _let(F.transform(F.filter(starts, lambda i: i + 1 < F.size(g)), tell), lambda told: judged(starts, told))

    def judged(starts: Column, told: Column) -> Column:
        counted, fits = F.size(F.filter(told, lambda t: t > 0)), F.size(F.filter(told, lambda t: t == 2))
        merged = F.transform(starts, lambda i: F.when(i + 1 < F.size(g), F.zip_with(F.get(g, i), F.get(g, i + 1), lambda x, y: F.when(x != "", x).otherwise(y))).otherwise(F.get(g, i)))
        return F.when((counted >= ZEBRA_PAIRS) & (fits >= counted * ZEBRA_SHARE), merged).otherwise(g)

    starts = F.sequence(F.lit(0), F.size(g) - 1, F.lit(2))
    return F.when(F.size(g) >= ZEBRA_ROWS, _let(starts, pairs)).otherwise(g)


def merge_exclusive_columns(g: Column) -> Column:
    """Neighbouring columns never filled in one row become one, leftmost pair first, until none is left.

    A pair left of a merged one does not change, unless it is next to it: the search goes on from there.
    """

    def once(state: Column) -> Column:
        grid = state["grid"]

        def fits(i: Column) -> Column:
            a, b = lambda r: F.get(r, i) != "", lambda r: F.get(r, i + 1) != ""
            two = (F.exists(grid, a) & F.exists(grid, b)) | (F.size(F.filter(grid, lambda r: a(r) | b(r))) >= 2)
            return ~F.exists(grid, lambda r: a(r) & b(r)) & two

        pairs = F.filter(_upto(_width(grid) - 1), lambda i: i >= state["at"])
        first = F.aggregate(pairs, F.lit(None).cast("int"), lambda found, i: F.coalesce(found, F.when(fits(i), i)))

        def merge(i: Column) -> Column:
            row = lambda r: F.filter(F.transform(r, lambda c, j: F.when((j != i) | (c != ""), c).otherwise(F.get(r, i + 1))), lambda c, j: j != i + 1)
            merged = F.when(i.isNull(), grid).otherwise(F.transform(grid, row))
            return F.struct(merged.alias("grid"), F.greatest(i - 1, F.lit(0)).alias("at"), i.isNull().alias("done"))

        return F.when(state["done"], state).otherwise(_let(first, merge))

    start = F.struct(g.alias("grid"), F.lit(0).alias("at"), F.lit(False).alias("done"))
    return F.aggregate(_upto(_width(g) - 1), start, lambda state, _: once(state), lambda state: state["grid"])


def looks_like_table(g: Column) -> Column:
    """Two rows and two columns or more, some text, and at most 30 % long cells."""
    cells = F.filter(F.flatten(g), lambda c: c != "")
    long = F.size(F.filter(cells, lambda c: F.char_length(c) > LONG_CELL))
    return (F.size(g) >= MIN_ROWS) & (_width(g) >= MIN_COLUMNS) & (F.size(cells) > 0) & (long <= F.size(cells) * LONG_SHARE)


def to_markdown(g: Column) -> Column:
    """A Markdown table, columns padded to their widest cell and at least MIN_WIDTH."""
    widths = F.transform(_upto(_width(g)), lambda i: F.greatest(F.lit(MIN_WIDTH), F.array_max(F.transform(g, lambda r: F.char_length(F.get(r, i))))))

    def table(w: Column) -> Column:
        row = lambda r: F.concat(F.lit("| "), F.array_join(F.zip_with(r, w, lambda c, n: F.rpad(c, n, F.lit(" "))), " | "), F.lit(" |"))
        rule = F.concat(F.lit("|"), F.array_join(F.transform(w, lambda n: F.repeat(F.lit("-"), n + 2)), "|"), F.lit("|"))
        return F.concat_ws("\n", row(F.get(g, F.lit(0))), rule, F.array_join(F.transform(F.slice(g, F.lit(2), F.size(g)), row), "\n"))

    return F.when(F.size(g) > 1, _let(widths, table)).when(F.size(g) == 1, F.regexp_replace(_let(widths, table), r"\n\z", ""))


def clean_grid(g: Column) -> Column:
    """T1-T6 in order; columns that a merge leaves empty go too."""
    for step in (normalise, drop_empty_rows, drop_empty_columns, merge_zebra_rows, drop_empty_columns, merge_exclusive_columns, drop_empty_columns):
        g = _let(g, step)
    return g


def clean_table(g: Column) -> Column:
    """The Markdown table of a raw grid, null if it is not a real table."""
    return _let(clean_grid(g), lambda x: F.when(looks_like_table(x), to_markdown(x)))
