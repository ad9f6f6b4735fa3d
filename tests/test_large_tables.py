"""What larger tables rest on: rows that travel without their payloads, tables without a step per row and column."""

import random
import re

from pyspark.sql import functions as F

from docflow.functions.text import WHITE
from docflow.operators import grid
from docflow.operators import media as M
from docflow.plans import catalogue

MEDIA = "doc_id long, ord int, entry_name string, content binary, ext string"


def test_images_travel_by_digest(spark):
    docs = spark.createDataFrame([(1, "a ![x](data:image/png;base64,aW1n)", "d"), (2, "b", None)], "doc_id long, text string, prefix string")
    none = spark.createDataFrame([], MEDIA).limit(0)
    for found in M.inline_to_files(docs, none):
        plan = found._jdf.queryExecution().executedPlan().toString()
        n = plan.count("Exchange hashpartitioning")
        assert n == 1
        sent = plan.split("Exchange hashpartitioning", 1)[1].split("\n")[1]
        columns = re.sub(r"#\d+L?", "", sent.split("Project [", 1)[1]).split(", CASE")[0].split(", ")
        assert not {"token", "payload"} & set(columns)


def test_images_of_odd_texts(spark):
    old = r"data:image/([A-Za-z0-9.+-]+);base64(?:,([A-Za-z0-9+/=\s]+?)(?=[)\s\"'])|\.\.\.)"
    one = "data:image/PNG;base64,"
    texts = [one + x for x in ("", ")", "aW1n", "aW1n)", " aW1n)", "\naW1n\n)", "  aW1n)", "a=W+/1n'", 'aW1n" x', "aW-1n)", "aW,1n)", "...", ".aW1n)")]
    texts += [f"({one}aW1n) é {one}... {one}aW1n", "data:image/png;base64... data:image/;base64,aa)", "data:image/a.b+c-d;base64,YQ==)", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    both = [F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in (old, M.INLINE_IMAGE)]
    assert all(r[0] == r[1] for r in df.select(*both).collect())
    told = {(r.doc_id, r.place): (r.kind, r.payload) for r in M.inline_images(df).collect() if r.token}
    assert told[3, 0] == ("png", "aW1n") and told[4, 0] == ("png", " aW1n") and (11, 0) not in told and told[14, 0] == ("png", None) and told[15, 0] == ("a.b+c-d", "YQ==")


def test_images_without_a_name_stay(spark):
    docs = spark.createDataFrame([(1, "a (data:image/png;base64,aW1n) b", None), (2, "(data:image/png;base64, aW1n)(data:image/gif;base64,aW1n)", "d")], "doc_id long, text string, prefix string")
    texts, files = M.inline_to_files(docs, spark.createDataFrame([], MEDIA))
    assert {r.doc_id: r.text for r in texts.collect()} == {1: docs.first().text, 2: "(images/d_image1.png)(images/d_image1.png)"}
    assert [(r.doc_id, r.name, bytes(r.content)) for r in files.collect()] == [(2, "d_image1.png", b"img")]


def _exclusive(grid):
    """T6, pair by pair from the left, each time from the start."""
    i = 0
    while grid and i + 1 < len(grid[0]):
        a, b = [r[i] for r in grid], [r[i + 1] for r in grid]
        if not any(x and y for x, y in zip(a, b, strict=True)) and sum(map(bool, a + b)) >= 2:
            grid = [[*r[:i], r[i] or r[i + 1], *r[i + 2 :]] for r in grid]
            i = 0
        else:
            i += 1
    return grid


def test_exclusive_columns_as_told(spark):
    rng = random.Random(5)
    shapes = [(rng.randint(0, 5), rng.randint(1, 7), rng.choice([0.1, 0.3, 0.6])) for _ in range(300)]
    grids = [[[f"{i}{j}" if rng.random() < p else "" for j in range(w)] for i in range(n)] for n, w, p in shapes]
    df = spark.createDataFrame(list(enumerate(grids)), "i int, g array<array<string>>")
    for r in df.select("g", grid.merge_exclusive_columns(F.col("g")).alias("m")).collect():
        assert r.m == _exclusive(r.g), r.g


def test_cells_of_all_kinds(spark):
    cells = [None, "", " ", "a", " a\n|\r", "   a   ", " \n", "é", " é\u0085", "a\r\nb", "|", "\x1fa\x1f\t", "a\x7f", "\x7f", "　a", "😀 ", "~", "!"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(cells)), "i int, c string").orderBy("i").select(grid.cell(F.col("c"))).collect()]
    assert got == [(c or "").translate({10: " ", 13: " "}).strip(WHITE).replace("|", "\\|") for c in cells]


def test_grids_without_slices(spark, sf_dir):
    """A cell is looked up among the words: slices of them were copied for each cell; complementary pairs are told once."""
    for query in (catalogue.table_exclusive, catalogue.table_zebra, catalogue.table_clean):
        plan = query(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(text") == 1 and "translate(" not in plan
        assert plan.count("slice(") <= (4 if query is catalogue.table_clean else 3), plan.count("slice(")


def test_rows_of_four_are_not_joined(spark, sf_dir):
    """A full row is one array; only the last, short one is cut."""
    plan = catalogue.table_clean(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "concat(array(" not in plan
