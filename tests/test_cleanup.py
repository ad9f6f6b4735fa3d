import random

from pyspark.sql import functions as F

from docflow.functions import text as T
from docflow.operators import cleanup as C
from docflow.operators import lines as L

from . import fold

PARTS = [
    "", "", " ", "text", "more text here", "text.", "# A", "#B", "## C.", "##", "####### seven", "# ...", "```", "~~~ py", "---", "title: x", "- a", "- item ends.",
    "* b", "1. one", "1. uno", "2. two", "3) three", "7. seven", "  4. deep", "   cont", "\tt", "x  ", "x   ", "5", "Page 5 of 20", "- 5 -", "3.6 Sekretess", "1. Tjänsteutbud",
    "3.5.1 Uppkommer tvist skall avgöras av domstol.", "• glyph", "●  dot", "12)", "> q", "| a | b |", "<x>", "see https://e.com/a. and (https://e.com/b)", "[t](https://e.com) `https://c.d` https://f.g",
    "\x0c3.5 Tvister", "a\x0cb", "\xa0", "Banner Text", "Banner Text", "  - sub", "+ plus", "0. zero", "01. one", "1.", "#", " # X", "　# wide",
]


def documents(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lines = [r.choice(PARTS) for _ in range(r.randint(1, 14))]
        if r.random() < 0.3:
            lines = ["---", r.choice(["title: T", "x: 1"]), *(["- a"] if r.random() < 0.5 else []), "---", *lines]
        out.append((i, "\n".join(lines)))
    return [*out, (n, ""), (n + 1, "\n\n"), (n + 2, "x")]


def test_lint_against_folds(spark):
    docs = documents(1500, 7)
    got = {r.doc_id: (r.text, r.fixes) for r in C.lint(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    bad = [(t, fold.lint(t), got[i]) for i, t in docs if got[i] != fold.lint(t)]
    assert not bad, bad[0]


def test_single_rules_against_folds(spark):
    docs = documents(400, 11)
    lines = L.to_lines(spark.createDataFrame(docs, "doc_id long, text string")).cache()
    for rule, f in fold.RULES:
        got = {r.doc_id: r.text for r in L.from_lines(C.one_rule(lines, rule)).collect()}
        bad = [(rule, t, "\n".join(f(t.split("\n"))[0]), got[i]) for i, t in docs if got[i] != "\n".join(f(t.split("\n"))[0])]
        assert not bad, bad[0]


def test_very_long_lists_and_islands(spark):
    """One document of thousands of items, and an item that thousands of lines continue: no more than linear in their number."""
    items = "\n".join(f"{i % 7}. item {i}" + ("\n   more" if i % 5 == 0 else "\n" if i % 11 == 0 else "") for i in range(6000))
    island = "- item\n" + "\n".join(f"line {i}" for i in range(6000)) + "\n\n" + "\n".join(f"prose {i}" for i in range(6000))
    docs = [(1, items), (2, island)]
    lines = L.to_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    for rule in ("md029", "rejoin"):
        got = {r.doc_id: r.text for r in L.from_lines(C.one_rule(lines, rule)).collect()}
        assert all(got[i] == "\n".join(dict(fold.RULES)[rule](t.split("\n"))[0]) for i, t in docs)


def test_lint_is_one_shuffle_without_python(spark):
    docs = spark.createDataFrame(documents(3, 1), "doc_id long, text string")
    out = C.lint_lines(L.to_lines(docs))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan


def test_white_space_is_python_white_space(spark):
    points = [c for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c, chr(c)) for c in points], "c int, s string").select("c", T.is_blank("s").alias("b"), T.strip(F.concat("s", F.lit("x"), "s")).alias("t")).collect()
    assert {r.c for r in rows if r.b} == {c for c in points if chr(c).isspace()}
    assert all(r.t == (chr(r.c) + "x" + chr(r.c)).strip() for r in rows)


def test_round_trip(spark):
    docs = documents(200, 3)
    back = L.from_lines(L.to_lines(spark.createDataFrame(docs, "doc_id long, text string"))).collect()
    assert sorted(map(tuple, back)) == sorted(docs)


def test_empty_headings(spark):
    cases = {"# \n## ![a](u)\n# x\n": ("![a](u)\n# x\n", 2), "a\r\nb\x85c": ("a\nb\nc", 0), "##\n": ("\n", 1), "": ("", 0), "```\n#\n```": ("```\n```", 1), "a\x0cb\x1cc d": ("a\nb\nc\nd", 0)}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.altered) for r in C.strip_empty_headings(docs).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_running_lines(spark):
    text = "\n".join(["Confidential report", "a", "Confidential report ", "# Heading once more", "# Heading once more", "# Heading once more", "b", "Confidential report", "Ja", "Ja", "Ja", "| --- | --- |", "| --- | --- |", "| --- | --- |"])
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    out = L.from_lines(C.strip_headers_footers(L.to_lines(docs))).first().text
    assert out.split("\n") == ["a", "# Heading once more", "# Heading once more", "# Heading once more", "b", "Ja", "Ja", "Ja"]


def test_page_numbers(spark):
    text = "5\n\na\n\n- 5 -\n\n5/20\n\nPage 5 of 20\n\n5 of 20\n\n12345\n\nx\n7\n\n```\n\n8\n\n```\n\n9"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    left = L.from_lines(C.strip_page_numbers(L.to_lines(docs))).first().text.split("\n")
    assert [x for x in left if x] == ["a", "12345", "x", "7", "```", "8", "```"]


def test_form_feeds_are_breaks_before_the_rules(spark):
    docs = spark.createDataFrame([(1, "a\x0c# b")], "doc_id long, text string")
    assert C.lint(docs).first().fixes.get("formfeed") == 1
    assert "formfeed" not in C.lint(C.strip_empty_headings(docs)).first().fixes
