from pyspark.sql import functions as F

from docflow.operators import grid, layout

GRID = "g array<array<string>>"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], GRID).select(f(F.col("g")).alias("x")).first().x


def test_cells_and_padding(spark):
    assert one(spark, [["a|b", None], ["c\nd"], [" x ", "y", "z"]], grid.normalise) == [["a\\|b", "", ""], ["c d", "", ""], ["x", "y", "z"]]


def test_empty_rows_and_columns(spark):
    assert one(spark, [["", ""], ["a", ""]], grid.drop_empty_rows) == [["a", ""]]
    assert one(spark, [["a", "", "b"], ["c", "", ""]], grid.drop_empty_columns) == [["a", "b"], ["c", ""]]


def test_zebra_rows(spark):
    pair = [["a", ""], ["", "b"]]
    assert one(spark, pair + [["c", ""]], grid.merge_zebra_rows) == pair + [["c", ""]]  # three rows are too few
    assert one(spark, pair * 2 + [["c", ""]], grid.merge_zebra_rows) == [["a", "b"], ["a", "b"], ["c", ""]]
    clash = [["x", "y"], ["z", "w"]]
    assert one(spark, pair * 7 + clash * 3, grid.merge_zebra_rows) == [["a", "b"]] * 7 + [["x", "y"]] * 3  # 70 %: the left cell wins
    assert one(spark, pair * 2 + clash, grid.merge_zebra_rows) == pair * 2 + clash


def test_exclusive_columns(spark):
    assert one(spark, [["h", "", "k"], ["", "v", "1"]], grid.merge_exclusive_columns) == [["h", "k"], ["v", "1"]]
    assert one(spark, [["a", "", ""], ["", "b", ""], ["", "", "c"]], grid.merge_exclusive_columns) == [["a"], ["b"], ["c"]]
    assert one(spark, [["a", "b"], ["", "c"]], grid.merge_exclusive_columns) == [["a", "b"], ["", "c"]]


def test_real_tables(spark):
    long = "x" * 121
    assert one(spark, [["a", "b"], ["c", "d"]], grid.looks_like_table)
    assert not one(spark, [["a"], ["b"]], grid.looks_like_table)
    assert not one(spark, [["a", "b"]], grid.looks_like_table)
    assert one(spark, [[long] * 3 + ["y"] * 2, ["y"] * 5], grid.looks_like_table)  # 30 %
    assert not one(spark, [[long] * 4 + ["y"], ["y"] * 5], grid.looks_like_table)


def test_markdown(spark):
    assert one(spark, [["Name", "N"], ["a|b", None], [None, None]], grid.clean_table) == "| Name | N   |\n|------|-----|\n| a\\|b |     |"
    assert one(spark, [["only", ""], ["", ""]], grid.clean_table) is None
    assert one(spark, [], grid.clean_table) is None


def test_body_size_and_levels(spark):
    df = spark.createDataFrame([([10.0, 12.0, 12.0, 10.0, 0.0, None],), ([],), (None,)], "s array<double>")
    assert [r[0] for r in df.select(layout.body_size("s")).collect()] == [10.0, 0.0, 0.0]
    ratios = spark.createDataFrame([(x,) for x in (1.8, 1.79, 1.45, 1.2, 1.19)], "r double")
    assert [r[0] for r in ratios.select(layout.heading_level(F.col("r"))).collect()] == [1, 2, 2, 3, None]


def page(index=0, lines=(), tables=(), images=(), text="", sizes=(10.0, 10.0), height=100.0):
    return (1, index, 100.0, height, list(sizes), text, len(images), list(lines), list(tables), list(images))


def line(text, top, *sizes):
    return (text, top, top + 8.0, list(sizes or (10.0,)))


TABLE = [["a", "b"], ["1", "2"]]
MD = "| a   | b   |\n|-----|-----|\n| 1   | 2   |"


def test_pages(spark):
    rows = [
        page(0, [line("Big", 5.0, 18.0), line("plain", 20.0), line("after", 60.0)], [(0.0, 30.0, 9.0, 50.0, TABLE)], [(7, 30.0, 10, 20)]),
        page(1, text="  only plain text "),
        page(2, [line("in", 10.0), line("low", 90.0)], [(0.0, 20.0, 9.0, 80.0, TABLE), (0.0, 30.0, 9.0, 40.0, TABLE)]),
    ]
    df = spark.createDataFrame(rows, layout.PAGE_STRUCT)
    got = [r.markdown for r in layout.page_markdown(df, markers=True).orderBy("page_index").collect()]
    assert got[0] == f"# Big\n\nplain\n\n{MD}\n\n<!--image:x7:w10:h20-->\n\nafter"
    assert got[1] == "only plain text"
    assert got[2] == f"in\n\n{MD}\n\n{MD}\n\nlow"
    assert layout.document_markdown(layout.page_markdown(df)).first().markdown.count("\n\n" + MD) == 3


def test_bands(spark):
    lines = F.array(F.struct(F.lit("x").alias("text"), F.lit(0.0).alias("top"), F.lit(1.0).alias("bottom"), F.array(F.lit(10.0)).alias("sizes")))
    thin, wide = spark.range(1).select(layout.band(lines, F.lit(0.0), F.lit(1.9), F.lit(10.0)), layout.band(lines, F.lit(0.0), F.lit(2.0), F.lit(10.0))).first()
    assert (thin, wide) == ("", "x")


def test_scanned(spark):
    rows = [("a", "", 1)] * 4 + [("a", "t" * 60, 1)] + [("b", "", 1)] * 3 + [("b", "", 0)] + [("c", None, 1)]
    got = {r.doc_id: r.is_scanned for r in layout.scanned(spark.createDataFrame(rows, "doc_id string, text string, n_images int")).collect()}
    assert got == {"a": True, "b": False, "c": True}


def test_images(spark):
    rows = [page(0, images=[(3, 1.0, 9, 9), (0, 1.0, 9, 9), (4, None, 9, 9), (5, 1.0, 3, 9)]), page(1, images=[(3, 2.0, 9, 9), (6, 2.0, 4, 4)])]
    df = spark.createDataFrame(rows, layout.PAGE_STRUCT)
    assert sorted((r.page_index, r.placeholder) for r in layout.image_markers(df).collect()) == [(0, "<!--image:x3:w9:h9-->"), (1, "<!--image:x3:w9:h9-->"), (1, "<!--image:x6:w4:h4-->")]
    assert sorted((r.xref, r.page_index) for r in layout.unique_images(df).collect()) == [(0, 0), (3, 0), (4, 0), (5, 0), (6, 1)]
