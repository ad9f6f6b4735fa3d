from docflow.operators import index as I
from docflow.operators import lines as L

PROSE = "this line of prose is long enough to count as running text, well over sixty characters"
TEXT = "\n".join([
    "# Title", "", "1. Overview", PROSE, "2. not after a blank", "3.6 Sekretess.", "1.2 12", "", "Chapter IV: The end.", "APPENDIX 2", "", "SYSTEM OVERVIEW A-B", "", "",
    "Heading Like Line Here", PROSE, "| A | B |", "Get method : /api/account/x1.", "GET /v2/items/7", "post /Items", "# Title", "x = y", "Page 3", "Page 3", "Page 3", "Page 3", "5. 7", "ABC(DEF)",
])


def lines(spark, text):
    return L.to_lines(spark.createDataFrame([("d", text)], "doc_id string, text string"))


def test_headings(spark):
    got = [tuple(r)[1:] for r in I.headings(lines(spark, TEXT)).orderBy("line_no").collect()]
    assert got == [
        (1, "Title", 1, "atx"),
        (1, "1 Overview", 3, "numbered"),
        (2, "3.6 Sekretess", 6, "numbered"),
        (1, "Chapter IV — The end", 9, "named"),
        (1, "Appendix 2", 10, "named"),
        (2, "System Overview A-B", 12, "caps"),
        (3, "Heading Like Line Here", 15, "title"),
        (1, "Title", 21, "atx"),
    ]


def test_dedupe(spark):
    rows = [("d", 1, t, i + 1, "atx") for i, t in enumerate(["a", "a", "b", "a"] + ["c", "d"] * 11)]
    got = I.dedupe_headings(spark.createDataFrame(rows, "doc_id string, level int, title string, line_no int, kind string"))
    assert [r.title for r in got.orderBy("line_no").collect()] == ["a", "b", "a", "c", "d"]


def test_endpoints(spark):
    got = [tuple(r)[1:] for r in I.endpoints(lines(spark, TEXT)).orderBy("line_no").collect()]
    assert got == [("GET", "/api/account/x1", 18, "account"), ("GET", "/v2/items/7", 19, "items"), ("POST", "/Items", 20, "Items")]
    groups = I.endpoint_groups(I.endpoints(lines(spark, TEXT))).orderBy("place").collect()
    assert [r.grp for r in groups] == ["account", "items", "Items"]


def test_render(spark):
    text = TEXT + "\n" * 500
    docs = spark.createDataFrame([("d", "spec", text), ("e", "short", TEXT), ("f", "", "\n" * 499)], "doc_id string, source string, text string")
    got = {r.doc_id: r["index"] for r in I.render_index(docs).collect()}
    assert set(got) == {"d", "f"}
    head = "# Index of spec\n\nAuto-generated navigation index. 8 sections, 3 endpoints. Line numbers refer to the main file.\n\n## Sections\n\n- Title (line 1)\n"
    assert got["d"].startswith(head)
    assert "\n  - System Overview A-B (line 12)\n" in got["d"]
    assert got["d"].endswith("## Endpoints\n\n### account\n\n- `GET /api/account/x1` (line 18)\n\n### items\n\n- `GET /v2/items/7` (line 19)\n\n### Items\n\n- `POST /Items` (line 20)\n")
    assert got["f"] == "# Index\n\nAuto-generated navigation index. no structured sections detected. Line numbers refer to the main file.\n\n_No headings, sections, or endpoint patterns were detected._\n"
