"""The decorated view md_docs: documents given Markdown constructs by arithmetic on ids, in Spark and DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.functions.shared import spread

# What each residue of (doc_id * 7 + i * 5) % 41 does to line i.
DECORATION = """CASE (doc_id*7 + i*5) % 41
 WHEN 0 THEN '# ' || left(line,40)
 WHEN 1 THEN '## ' || left(line,30) || '.'
 WHEN 2 THEN '#' || left(line,20)
 WHEN 3 THEN '##'
 WHEN 4 THEN '## ![fig](img' || cast(i as string) || '.png)'
 WHEN 5 THEN repeat(chr(96), 3)
 WHEN 6 THEN chr(9) || line
 WHEN 7 THEN line || '   '
 WHEN 8 THEN line || '  '
 WHEN 9 THEN 'see https://example.com/a' || cast(i as string) || '. and (https://example.com/b) https://example.com/d or [t](https://example.com/c)'
 WHEN 10 THEN '• ' || line
 WHEN 11 THEN '- ' || left(line,60)
 WHEN 12 THEN cast(i % 3 + 1 as string) || '. ' || left(line,25)
 WHEN 13 THEN '3.' || cast(i % 9 as string) || ' ' || left(line,25)
 WHEN 14 THEN cast(i % 9 + 1 as string) || ')'
 WHEN 15 THEN chr(10) || chr(10)
 WHEN 16 THEN chr(10) || cast(i % 900 as string) || chr(10)
 WHEN 17 THEN chr(10) || 'Page ' || cast(i % 900 as string) || ' of 950' || chr(10)
 WHEN 18 THEN chr(12) || line
 WHEN 19 THEN 'GET /api/v1/items/' || cast(i % 7 as string)
 WHEN 20 THEN 'Get method : /api/account/x' || cast(i % 7 as string) || '.'
 WHEN 21 THEN chr(10) || 'Chapter ' || cast(i % 9 + 1 as string) || ': ' || left(line,20)
 WHEN 22 THEN chr(10) || 'SYSTEM OVERVIEW ' || substr('ABCDEFG', cast(i % 7 + 1 as int), 1) || chr(10)
 WHEN 23 THEN 'Confidential Banner Text'
 WHEN 24 THEN '| a | b |'
 WHEN 25 THEN chr(160)
 WHEN 26 THEN '![i](data:image/png;base64...)'
 WHEN 27 THEN '1. first' || chr(10) || '3. second' || chr(10) || '   cont' || chr(10) || '7. third'
 WHEN 28 THEN chr(10) || 'Heading Like Line Here' || chr(10) || line || line
 WHEN 29 THEN '<!--image:x' || cast(i % 5 as string) || ':w10:h20-->'
 ELSE line END"""

FRONT_MATTER = """CASE WHEN doc_id % 5 = 0 THEN '---' || chr(10) || 'title: T' || chr(10) || 'tags:' || chr(10) || '- a' || chr(10) || '- b' || chr(10) || '---' || chr(10) ELSE '' END"""

SQL = f"""l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
md_docs AS (SELECT doc_id, source, {FRONT_MATTER} || string_agg({DECORATION}, chr(10) ORDER BY i) AS text FROM l GROUP BY doc_id, source)"""


#: Bytes of the documents table whose lines one task holds: they take some hundred times as much in the sorts of a chain of rules.
LINES_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def md_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, text."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    spread(docs, LINES_BYTES, "doc_id").createOrReplaceTempView("docflow_documents")  # lines, rules and texts stay where that puts them
    return spark.sql(f"""WITH l AS (SELECT doc_id, source, i, line FROM docflow_documents LATERAL VIEW posexplode(split(text, '\\n', -1)) p AS i, line)
      SELECT doc_id, source, {FRONT_MATTER} || listagg({DECORATION}, chr(10)) WITHIN GROUP (ORDER BY i) AS text FROM l GROUP BY doc_id, source""")


#: Fixed value: documents of a source and of this many ids in a row make one long document.
PER_VOLUME = 1000


def volume(doc_id: str = "doc_id", source: str = "source"):
    """A source's documents of PER_VOLUME ids in a row: long enough for an index, and bounded whatever the source holds."""
    return F.concat(F.col(source), F.lit("-"), F.floor(F.col(doc_id) / PER_VOLUME).cast("string"))


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long documents: doc_id (the volume), source (the same), text, the documents in order of their ids."""
    rows = md_docs(spark, sf_dir).withColumn("volume", volume())
    parts = F.sort_array(F.collect_list(F.struct("doc_id", "text")))
    joined = rows.groupBy("volume").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"))
    return joined.select(F.col("volume").alias("doc_id"), F.col("volume").alias("source"), "text")
