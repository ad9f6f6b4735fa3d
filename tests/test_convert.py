from pyspark.sql import Observation, SparkSession

from docflow.plans import convert, samples
from docflow.sources import files

from . import fold


def test_conversion_end_to_end(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    (folder / "sub").mkdir(parents=True)
    long = "\n".join(["# Title", "", "GET /api/v1/x"] + [f"line number {i} of the text" for i in range(600)])
    (folder / "sub" / "long.md").write_text(long)
    (folder / "a.md").write_text("#Head.\n\ttext")
    (folder / "b.txt").write_text("5\n\nRunning banner\nx\nRunning banner\ny\nRunning banner")
    (folder / "bad.docx").write_bytes(b"no archive")
    (folder / "skip.bin").write_bytes(b"x")
    (folder / "there.md").write_text("old")
    scanned = files.scan_folder(spark, f"file:{folder}")
    options = convert.Options(f"file:{out}", f"file:{folder}")
    existing = spark.createDataFrame([(f"file:{out}/there.md",)], "destination string")
    seen = Observation("totals")
    results = convert.convert_corpus(scanned, options, existing=existing, observation=seen)
    got = {r.source.rpartition("/")[2]: r for r in results.collect()}
    assert seen.get == {"succeeded": 3, "failed": 1}
    assert {k: v.status for k, v in got.items()} == {"long.md": "ok", "a.md": "ok", "b.txt": "ok", "bad.docx": "failed", "there.md": "exists"}
    assert got["a.md"].text == "# Head\n\n    text\n" and got["a.md"].fixes == {"md010": 1, "md018": 1, "md026": 1, "md022": 1, "md047": 1}
    assert got["b.txt"].text.startswith("5\n\nRunning banner")  # running lines and page numbers go from PDF and DOCX only
    assert got["long.md"].text == fold.lint(long)[0] and got["long.md"].destination == f"file:{out}/sub/long.md"
    assert got["long.md"]["index"].startswith("# Index of long.md\n") and "- `GET /api/v1/x` (line 3)" in got["long.md"]["index"]
    assert got["a.md"].near_empty and got["a.md"]["index"] is None
    written = {r.path.rpartition("/out/")[2]: r.error for r in convert.write_corpus(results).collect()}
    assert written == {"sub/long.md": None, "sub/long.index.md": None, "a.md": None, "b.md": None}
    assert (out / "sub" / "long.index.md").read_text().startswith("# Index of long.md")


def test_running_lines_leave_documents_of_these_kinds(spark):
    text = "5\n\nRunning banner\nx\n\nRunning banner\ny\n\nRunning banner"
    docs = spark.createDataFrame([(f"a.{k}", text) for k in ("pdf", "docx", "md")], "doc_id string, text string")
    options = convert.Options("/o", lint=False)
    got = {r.doc_id: r.text for r in convert.clean(docs, options).collect()}
    assert "banner" not in got["a.pdf"] and "5" not in got["a.pdf"]
    assert "banner" not in got["a.docx"] and "5" in got["a.docx"]
    assert got["a.md"] == text


def test_discovery_keeps_its_order(spark):
    rows = files.discover(spark, 0.3).orderBy("place").collect()
    assert [r.name for r in rows] == [s[0] for s in files.LOCAL_SERVERS]


def test_each_file_is_converted_once(spark, tmp_path):
    folder, log = tmp_path / "in", tmp_path / "calls"
    folder.mkdir()
    log.mkdir()
    for i in range(6):
        (folder / f"{i}.md").write_text("\n".join(f"line {k}" for k in range(600)))
    (folder / "s.pdf").write_bytes(samples.pdf([{"images": [(0, 0, 500, 700, 1)]}]))  # a picture and no text: scanned
    (folder / "t.pdf").write_bytes(samples.text_pdf("a text of more than fifty characters, so that the page is not taken as scanned"))
    where = str(log)

    def noted(raw, name):
        import uuid

        with open(f"{where}/{name}-{uuid.uuid4().hex}", "w"):
            return name

    known = files.Registry()
    known.register((".md",), lambda raw: noted(raw, "md") + raw.decode())
    results = convert.convert_corpus(files.scan_folder(spark, f"file:{folder}"), convert.Options(f"file:{tmp_path}/out"), known, ocr=lambda raw: noted(raw, "ocr"))
    rows = {r.source.rpartition("/")[2]: r for r in results.collect()}
    results.count()
    assert all(r.error is None for r in convert.write_corpus(results).collect())
    calls = sorted(x.name.partition("-")[0] for x in log.iterdir())
    assert calls == ["md"] * 6 + ["ocr"]
    assert rows["s.pdf"].route == "OCR" and rows["s.pdf"].text == "ocr\n" and rows["t.pdf"].route == "text"


PNG = b"\x89PNG one"


def image_folder(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    page = {"lines": [("words above", 20, 20, 10), ("words below", 20, 120, 10)], "images": [(20, 50, 40, 40, 3)]}
    (folder / "marked.pdf").write_bytes(samples.pdf([page, page]))
    (folder / "doc.docx").write_bytes(samples.docx(["first {image}", "second {image}"], [("word/media/image2.png", b"two"), ("word/media/image1.png", PNG)]))
    (folder / "slides.pptx").write_bytes(samples.archive_of({"ppt/slides/slide1.xml": "<p:sld xmlns:p='p' xmlns:a='a'><a:p><a:r><a:t>Title</a:t></a:r></a:p></p:sld>", "ppt/media/image1.png": PNG, "ppt/media/sub/image1.png": b"other"}))
    (folder / "plain.txt").write_text("no images")
    return files.scan_folder(SparkSession.getActiveSession(), f"file:{folder}")


def test_images_are_embedded(spark, tmp_path):
    found = image_folder(tmp_path)
    done = convert.convert_all(found, convert.Options(f"file:{tmp_path}/out", images="embed", lint=False))
    got = {r.source.rpartition("/")[2]: r.text for r in done.rows.collect()}
    assert done.media is None
    assert got["marked.pdf"].count("![image](data:image/png;base64,iVBORw0K") == 2 and got["marked.pdf"].startswith("words above\n\n![image]")
    one, two = "iVBORyBvbmU=", "dHdv"
    assert got["doc.docx"] == f"first ![](data:image/png;base64,{one})\n\nsecond ![](data:image/png;base64,{two})"
    assert got["slides.pptx"] == f"<!-- Slide number: 1 -->\nTitle\n\n## Embedded images\n\n![image 1](data:image/png;base64,{one})\n\n![image 2](data:image/png;base64,b3RoZXI=)\n"
    assert got["plain.txt"] == "no images"


def test_images_are_extracted(spark, tmp_path):
    found = image_folder(tmp_path)
    done = convert.convert_all(found, convert.Options(f"file:{tmp_path}/out", images="extract", lint=False))
    got = {r.source.rpartition("/")[2]: r.text for r in done.rows.collect()}
    assert got["marked.pdf"].split("\n\n") == ["words above", "![image](images/marked_x10.png)", "words below"] * 2
    assert got["doc.docx"] == "first ![](images/doc_image1.png)\n\nsecond ![](images/doc_image2.png)"
    assert got["slides.pptx"].endswith("## Embedded images\n\n![image 1](images/slides_image1.png)\n\n![image 2](images/slides_image1_2.png)\n")
    assert all(r.error is None for r in convert.write_corpus(done.rows, done.media).collect())
    names = {p.name for p in (tmp_path / "out" / "images").iterdir()}
    assert names == {"marked_x10.png", "doc_image1.png", "doc_image2.png", "slides_image1.png", "slides_image1_2.png"}
    assert (tmp_path / "out" / "images" / "doc_image2.png").read_bytes() == b"two"


def test_pdf_images_without_a_place_go_to_the_end(spark, tmp_path):
    """Where a registered converter replaces the page operators there are no markers, so SNK4's section is used."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.pdf").write_bytes(samples.pdf([{"images": [(0, 0, 9, 9, 5)]}, {"images": [(0, 0, 9, 9, 6)]}]))
    known = files.Registry()
    known.register((".pdf",), lambda raw: "own")
    found = files.scan_folder(spark, f"file:{folder}")
    done = convert.convert_all(found, convert.Options(f"file:{tmp_path}/out", images="extract", lint=False), known)
    assert done.rows.first().text == "own\n\n## Embedded images\n\n### Page 1\n\n![Page 1 image 10 (8x8)](images/a_p1_10.png)\n\n### Page 2\n\n![Page 2 image 11 (8x8)](images/a_p2_11.png)\n"
    assert {r.destination.rpartition("/")[2] for r in done.media.collect()} == {"a_p1_10.png", "a_p2_11.png"}


def test_damaged_pdf_is_a_failed_row(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.4 nothing")
    (tmp_path / "empty.pdf").write_bytes(samples.pdf([]))
    got = {r.source.rpartition("/")[2]: (r.status, r.text) for r in convert.convert_corpus(files.scan_folder(spark, f"file:{tmp_path}"), convert.Options("/o")).collect()}
    assert got == {"x.pdf": ("failed", None), "empty.pdf": ("ok", "")}
