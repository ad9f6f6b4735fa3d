import base64

from pyspark.sql import functions as F

from docflow.operators import media as M
from docflow.operators import queue as Q
from docflow.sources import sinks

MEDIA = "doc_id long, ord int, entry_name string, content binary, ext string"
PNG = base64.b64encode(b"one").decode()


def test_order_and_names(spark):
    names = ["word/media/image10.png", "word/media/logo.png", "word/media/image2.png", "a/Image1.PNG"]
    df = spark.createDataFrame([(1, i, n, b"x", ".png") for i, n in enumerate(names)], MEDIA)
    assert [r.entry_name for r in M.ordinal_media(df).orderBy("nth").collect()] == [names[3], names[2], names[0], names[1]]
    assert [spark.range(1).select(M.safe_stem(F.lit(x))).first()[0] for x in ("a b/c", "..", "", "x-1.")] == ["a_b_c", "image", "image", "x-1"]


def test_zip_names_fold(spark):
    rows = [(1, 0, "a/x.png"), (1, 1, "b/x.png"), (1, 2, "b/x_2.png"), (1, 3, "c/x.png"), (2, 0, "x.png")]
    df = spark.createDataFrame([(*r, ".png", "d") for r in rows], "doc_id long, ord int, entry_name string, ext string, prefix string")
    got = {(r.doc_id, r.ord): r.name for r in M.zip_file_names(df).collect()}
    assert got == {(1, 0): "d_x.png", (1, 1): "d_x_2.png", (1, 2): "d_x_2_2.png", (1, 3): "d_x_3.png", (2, 0): "d_x.png"}


def test_inline_images(spark):
    cut = "![i](data:image/png;base64...)"
    text = f"a ![x](data:image/jpeg;base64,{PNG}) {cut} {cut} {cut} ![bad](data:image/png;base64,YWI) ![y](data:image/png;base64,{PNG})"
    docs = spark.createDataFrame([(1, text, "My doc"), (2, cut, "n"), (3, "plain", "p"), (4, None, "q")], "doc_id long, text string, prefix string")
    media = spark.createDataFrame([(1, 0, "m/image2.png", b"two", ".png"), (1, 1, "m/image1.png", b"one", ".png")], MEDIA)
    texts, files = M.inline_to_files(docs, media)
    got = {r.doc_id: (r.text, r.n_images) for r in texts.collect()}
    first, second = "images/My_doc_image1.jpg", "images/My_doc_image2.png"
    assert got[1] == (f"a ![x]({first}) ![i]({first}) ![i]({second}) ![i]({second}) ![bad](data:image/png;base64,YWI) ![y]({first})", 2)
    assert got[2] == ("![i]()", 0) and got[3] == ("plain", 0)
    assert sorted((r.name, bytes(r.content)) for r in files.collect()) == [("My_doc_image1.jpg", b"one"), ("My_doc_image2.png", b"two")]
    whole = {r.doc_id: r.text for r in M.truncated_to_base64(docs, media).collect()}
    assert whole[2] == cut and whole[1].count(f"data:image/png;base64,{PNG}") == 2


def test_markers(spark):
    text = "<!--image:x3:w9:h9--> and <!--image:x4:w1:h1--> and <!--image:x3:w9:h9-->"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = spark.createDataFrame([(1, 3, "doc", b"x")], "doc_id long, xref int, prefix string, content binary")
    out = M.substitute_markers(docs, M.marker_files(found)).first()
    assert (out.text, out.n_placed) == ("![image](images/doc_x3.png) and  and ![image](images/doc_x3.png)", 2)
    assert M.substitute_markers(docs, M.marker_uris(found)).first().text.startswith("![image](data:image/png;base64,eA==)")


def test_cascade(spark):
    pick = lambda placed, inline, section: spark.range(1).select(M.image_cascade(F.lit("t"), F.lit(placed), F.lit("p"), F.lit(inline), F.lit("i"), F.lit(section))).first()[0]
    assert [pick(1, 1, "s"), pick(0, 2, "s"), pick(0, 0, "s"), pick(0, 0, "")] == ["p", "i", "t\n\ns\n", "t"]


def test_content_numbers(spark):
    rows = spark.createDataFrame([(1, 0, b"a"), (1, 1, None), (1, 2, b"b"), (1, 3, b"a"), (2, 0, b"b")], "doc_id long, place int, content binary")
    got = {(r.doc_id, r.place): r.image_no for r in M.number_contents(rows, "content", "place").collect()}
    assert got == {(1, 0): 1, (1, 1): None, (1, 2): 2, (1, 3): 1, (2, 0): 1}


def test_model_ids(spark):
    rows = spark.createDataFrame([('{"data": [{"id": "b"}, {"id": "a"}, {"id": "b"}, {"x": 1}, {"id": ""}]}',), ("[]",), ("oops",), (None,)], "s string")
    assert [r[0] for r in rows.select(M.model_ids("s")).collect()] == [["a", "b"], [], [], []]


def test_destinations(spark):
    rows = [("/in/a/x.pdf",), ("/in/y.tar.GZ",), ("/other/x.docx",), ("/in/.hidden",)]
    df = spark.createDataFrame(rows, "s string")
    assert [r[0] for r in df.select(Q.destination("s", F.lit("/out/"))).collect()] == ["/out/x.md", "/out/y.tar.md", "/out/x.md", "/out/.hidden.md"]
    assert [r[0] for r in df.select(Q.destination("s", F.lit("/out"), F.lit("/in"))).collect()] == ["/out/a/x.md", "/out/y.tar.md", "/out/x.md", "/out/.hidden.md"]


def test_queue(spark):
    paths = spark.createDataFrame([("b", 0), ("a", 1), ("b", 2), ("c", 3)], "path string, pos int")
    q = Q.enqueue(paths)
    assert [(r.source, r.queue_pos) for r in q.orderBy("queue_pos").collect()] == [("b", 0), ("a", 1), ("c", 3)]
    assert Q.remove(q, q.filter("source = 'a'")).count() == 2
    rows = spark.createDataFrame([(0, "x"), (1, "x"), (2, "y")], "queue_pos int, destination string")
    there = spark.createDataFrame([("y",)], "destination string")
    assert [r.status for r in sinks.guard(rows, there).orderBy("queue_pos").collect()] == ["ok", "exists", "exists"]
    assert [r.status for r in sinks.guard(rows, there, True).orderBy("queue_pos").collect()] == ["replaced", "ok", "ok"]


def test_routing_table(spark):
    for ocr, scanned, want in ((True, True, "OCR"), (True, False, "text"), (False, True, "text"), (False, False, "text")):
        assert spark.range(1).select(Q.route(F.lit(ocr), F.lit(scanned))).first()[0] == want


def test_endpoints_and_errors(spark):
    cases = {"http://localhost:1234": "http://localhost:1234/v1", "http://localhost:1234/": "http://localhost:1234/v1", "http://h/api/": "http://h/api", "": "", "///": "", "https://h?x=1": "https://h?x=1/v1"}
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert [r[0] for r in df.select(Q.normalise_endpoint("u")).collect()] == list(cases.values())
    errors = [("CUDA out of memory; connection", "X", "memory"), ("x", "APIConnectionError", "connection"), ("HTTP 401", "X", "auth"), ("x", "AuthError", "auth"), ("does not exist", "X", "not_found"), ("x", "ReadTimeout", "timeout"), ("x", "X", "default"), (None, None, "default")]
    df = spark.createDataFrame([e[:2] for e in errors], "m string, c string")
    assert [r[0] for r in df.select(Q.diagnose("m", "c")).collect()] == [e[2] for e in errors]


def test_vision(spark):
    df = spark.createDataFrame([("GPT-4o-mini",), ("",), (None,), ("mistral-7b",), ("Llama-3.2-Vision",)], "m string")
    assert [r[0] for r in df.select(Q.is_vision_model("m")).collect()] == [True, False, False, False, True]
    assert len(Q.VISION_PATTERNS) == 49 and Q.providers(spark).count() == 9


def test_near_empty_counts_white_space(spark):
    df = spark.createDataFrame([("x" * 49,), ("x" * 49 + "\n",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(Q.near_empty("t")).collect()] == [True, False, True, None]


def test_image_modes_and_credentials(spark):
    mode = lambda a, b: spark.range(1).select(Q.image_mode(a, b)).first()[0]
    assert [mode(True, True), mode(True, False), mode(False, True), mode(False, False)] == ["embed", "embed", "extract", "none"]
    missing = lambda a, b: spark.range(1).select(Q.check_credentials(F.lit(a), F.lit(b))).first()[0]
    assert missing("k", None) is None and missing(" ", "http://h") is None and "API key" in missing(" ", "")


def test_many_entries_of_one_name(spark):
    rows = [(1, i, f"a{i}/x.png", ".png", "doc") for i in range(20000)] + [(2, 0, "x_2.png", ".png", "doc"), (2, 1, "a/x.png", ".png", "doc"), (2, 2, "b/x.png", ".png", "doc"), (2, 3, "c/x.png", ".jpg", "doc")]
    named = M.zip_file_names(spark.createDataFrame(rows, "doc_id long, ord int, entry_name string, ext string, prefix string")).collect()
    got = {(r.doc_id, r.ord): r.name for r in named}
    assert got[1, 0] == "doc_x.png" and got[1, 1] == "doc_x_2.png" and got[1, 19999] == "doc_x_20000.png" and len(set(got.values())) >= 20000
    assert [got[2, i] for i in range(4)] == ["doc_x_2.png", "doc_x.png", "doc_x_3.png", "doc_x.jpg"]


def test_sinks_refuse_what_executors_do_not_share(tmp_path):
    assert sinks.put(f"file:{tmp_path}/a/b.md", b"x") == 1 and (tmp_path / "a" / "b.md").read_bytes() == b"x"
    for path, local in ((f"{tmp_path}/c.md", False), ("nosuch://host/c.md", True)):
        try:
            sinks.put(path, b"x", local)
        except (ValueError, OSError, ImportError):
            continue
        raise AssertionError(path)
    assert not (tmp_path / "c.md").exists()
