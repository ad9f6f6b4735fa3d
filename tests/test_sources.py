import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docflow.sources import files, sinks
from docflow.streaming import arrivals


def archive(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name.replace("__", "/"), data)
    return out.getvalue()


W = 'xmlns:w="http://x/w"'
DOCX = archive(**{
    "word__document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Some </w:t></w:r><w:r><w:t>text</w:t></w:r></w:p></w:body></w:document>',
    "word__media__image1.png": b"\x89one", "word__media__image2.TXT": b"no", "word__media__empty.png": b"", "other__image3.png": b"x",
})
XLSX = archive(**{
    "xl__workbook.xml": '<workbook><sheets><sheet name="S1"/></sheets></workbook>',
    "xl__sharedStrings.xml": "<sst><si><t>a</t></si><si><t>b</t></si></sst>",
    "xl__worksheets__sheet1.xml": '<worksheet><sheetData><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row><row><c><v>1</v></c><c><v>2</v></c></row></sheetData></worksheet>',
})
PPTX = archive(**{f"ppt__slides__slide{i}.xml": f"<p:sld xmlns:p='p' xmlns:a='a'><a:p><a:r><a:t>slide {i}</a:t></a:r></a:p></p:sld>" for i in (10, 2)})
EPUB = archive(**{"OEBPS__a.xhtml": "<html><body><h1>T</h1><p>x</p></body></html>", "cover.jpg": b"img", "x__y.gif": b"g"})


@pytest.fixture()
def folder(tmp_path):
    inner = tmp_path / "in" / "deep"
    inner.mkdir(parents=True)
    data = {
        "a.TXT": b"\xef\xbb\xbfplain", "b.csv": b"h,k\n1,a|b\n", "c.tsv": b"h\tk\n1\t2\n", "d.html": b"<h2>Hi</h2><p>a <b>c</b></p>", "e.json": b'{"a":[1]}', "f.xml": b"<a>1</a>",
        "g.rtf": rb"{\rtf1\ansi Hello\par W\'f6rld}", "h.docx": DOCX, "i.xlsx": XLSX, "j.pptx": PPTX, "k.epub": EPUB, "l.docx": b"broken", "m.mp3": b"x", "n.exe": b"x",
    }
    for name, content in data.items():
        (inner / name).write_bytes(content)
    return tmp_path / "in"


def test_scan_and_convert(spark, folder):
    found = files.scan_folder(spark, str(folder))
    assert found.count() == 13
    got = {r.path.rpartition("/")[2]: r for r in files.convert(found).collect()}
    text = {k: v.text for k, v in got.items()}
    assert text["a.TXT"] == "plain"
    assert text["b.csv"] == "| h | k |\n| --- | --- |\n| 1 | a\\|b |" and text["c.tsv"].endswith("| 1 | 2 |")
    assert text["d.html"] == "## Hi\n\na **c**"
    assert text["e.json"].startswith("```json\n{") and text["f.xml"] == "```xml\n<a>1</a>\n```"
    assert text["g.rtf"] == "Hello\nWörld"
    assert text["h.docx"] == "## Head\n\nSome text"
    assert text["i.xlsx"] == "## S1\n\n| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert text["j.pptx"].index("slide 2") < text["j.pptx"].index("slide 10")
    assert text["k.epub"] == "# T\n\nx"
    assert text["l.docx"] is None and "BadZipFile" in got["l.docx"].error
    assert got["m.mp3"].error == "ValueError: not an audio file of a known kind"


def test_content_is_read_only_where_used(spark, folder):
    plan = files.scan_folder(spark, str(folder)).select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan


def test_registry_priority_and_ocr(spark, folder):
    known = files.Registry()
    known.register([".txt"], lambda b: "mine")
    known.register([".txt"], lambda b: "later, lower", 5.0)
    rows = files.scan_folder(spark, str(folder), [".txt"])
    assert files.convert(rows, known).first().text == "mine"
    assert not known.has_ocr()

    def fail(content):
        raise TimeoutError("no answer")

    out = files.convert(rows.withColumn("is_scanned", F.lit(True)), known, fail).first()
    assert (out.route, out.text) == ("OCR", "*[OCR failed: no answer]*") and "TimeoutError" in out.error


def test_zip_media(spark, folder):
    got = sorted((r.path.rpartition("/")[2], r.entry_name, bytes(r.content), r.ext) for r in files.media(files.scan_folder(spark, str(folder))).collect())
    assert got == [("h.docx", "word/media/image1.png", b"\x89one", ".png"), ("k.epub", "cover.jpg", b"img", ".jpg"), ("k.epub", "x/y.gif", b"g", ".gif")]


def test_pdf_predicate_and_fallback(spark):
    df = spark.createDataFrame([("a.PDF", None, ""), ("b", "application/pdf; x", "t"), ("c.txt", "text/plain", None)], "p string, m string, t string")
    assert [r[0] for r in df.select(files.accepts_pdf("p", "m")).collect()] == [True, True, False]
    assert [r[0] for r in df.select(files.with_fallback("t", F.lit("f"))).collect()] == ["f", "t", "f"]


def test_settings(spark, tmp_path):
    df = spark.createDataFrame([('{"a": 1}', None), ("{bad", '{"a": 2}'), (None, '{"a": 3}'), (None, None)], "s string, old string")
    got = [r[0] for r in df.select(F.coalesce(files.settings("s", "a int", "old")["a"], F.lit(0))).collect()]
    assert got[0] == 1 and got[2:] == [3, 0]
    path = tmp_path / "x" / "s.json"
    assert sinks.save_settings(str(path), {"b": 1, "a": {"c": 2}})
    assert list(json.loads(path.read_text())) == ["a", "b"]
    assert not sinks.save_settings("/proc/none/s.json", {})


def test_probe_reports_errors_as_data(spark):
    df = spark.createDataFrame([("local", "http://127.0.0.1:9/v1/")], "name string, base_url string")
    out = files.probe(df, 0.5).first()
    assert out.models == [] and out.error


def test_write_files(spark, tmp_path):
    rows = spark.createDataFrame([(str(tmp_path / "o" / "a.md"), "text"), ("/proc/none/b.md", "x")], "destination string, text string")
    got = {r.path.rpartition("/")[2]: r for r in sinks.write_files(rows).collect()}
    assert (tmp_path / "o" / "a.md").read_text() == "text" and got["a.md"].error is None and got["b.md"].error
    assert spark.range(1).select(F.lit("/o/a.b.md").alias("d")).select(sinks.index_path("d")).first()[0] == "/o/a.b.index.md"


def test_arrivals(spark, folder, tmp_path):
    table, checkpoint = str(tmp_path / "table"), str(tmp_path / "checkpoint")
    start = lambda: arrivals.run_available(arrivals.convert_arrivals(spark, str(folder), "/out"), table, checkpoint)
    start()
    assert spark.read.parquet(table).count() == 13
    (folder / "new.md").write_text("# later")
    start()
    rows = spark.read.parquet(table)
    assert rows.count() == 14 and rows.filter("destination = '/out/new.md'").first().text == "# later"


def test_html(spark):
    html = "<head><title>no</title></head><body><ul><li>a<ol><li>b</li><li>c</li></ol></li></ul><table><tr><th>h</th></tr><tr><td>1|2</td></tr></table><a href='u'>l</a><img src='s' alt='t'><script>x</script><pre>p\n q</pre></body>"
    out = files.html_markdown(html)
    assert "- a" in out and "  1. b" in out and "  2. c" in out and "| h |\n| --- |\n| 1\\|2 |" in out
    assert "[l](u)![t](s)" in out and "no" not in out and "```\np\n q\n```" in out
    assert files.html_markdown(None) == ""
