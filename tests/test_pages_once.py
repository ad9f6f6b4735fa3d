"""PDF files are read in one pass, by tasks whose number follows the input."""

from docflow.functions.shared import small_batches, spread
from docflow.plans import convert, samples
from docflow.sources import pdf


def test_pages_are_read_once(spark):
    made = [("a.pdf", samples.text_pdf("one\ntwo")), ("b.pdf", b"no pdf"), ("c.pdf", samples.text_pdf(""))]
    pages = pdf.read_pages(spark.createDataFrame(made, "path string, content binary"))
    texts = convert.pdf_texts(pages, False)
    assert texts._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = {r.path: (r.text, (r.error or "").partition(":")[0], r.route) for r in texts.collect()}
    assert got == {"a.pdf": ("one\ntwo", "", "text"), "b.pdf": (None, "Damaged", "text"), "c.pdf": ("", "", "text")}


def test_operands_that_touch():
    page = b"BT/F 10 Tf(abc)Tj<4142>Tj 0 -20 Td[(x)-3000(y)]TJ % c\n0 -20 Td 12abc (z)Tj<414>Tj ET"
    raw = b"%%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Kids [3 0 R] >> endobj 3 0 obj << /Contents 4 0 R /Resources << /Font << /F 5 0 R >> >> >> endobj 5 0 obj << /Subtype /Type1 >> endobj 4 0 obj << /Length %d >> stream\n" % len(page) + page + b"\nendstream endobj trailer << /Root 1 0 R >>"
    assert [r["text"].split("\n") for r in pdf.pages(raw)] == [["abcAB", "x y", "zA@"]]


def test_tasks_follow_the_input(spark, tmp_path):
    spark.createDataFrame([(i, f"text {i * 7919}", "s") for i in range(2000)], "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert spread(docs, 1000, "doc_id").rdd.getNumPartitions() > 10
    assert sorted(spread(docs, 1000, "doc_id").collect()) == sorted(docs.collect())
    small_batches(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 200
