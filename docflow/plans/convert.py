"""The batch conversion from files to Markdown with images, clean-up, index and result rows.

files (path, content and, if known, is_scanned) -> convert -> images -> C1 -> C2 -> C3 ->
lint -> one row per file. Converting is dear, and a model's answers differ from call to call:
what a file converts to is written to the shared folder once, and all else reads that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from docflow.functions.shared import written
from docflow.operators import cleanup as C
from docflow.operators import index, layout, media, queue
from docflow.operators import lines as L
from docflow.sources import files as S
from docflow.sources import pdf, sinks


@dataclass(frozen=True)
class Options:
    """What the conversion does; the defaults do everything but overwrite."""

    out_root: str
    in_root: str | None = None  # mirror folders below it; None: all in out_root
    overwrite: bool = False
    drop_empty_headings: bool = True
    strip_headers_footers: bool = True
    strip_page_numbers: bool = True
    lint: bool = True
    images: str = "none"  # none, embed (as data URIs) or extract (to files); see queue.image_mode
    make_index: bool = True
    index_on: str = "raw"  # or final: line numbers of the text that is written


def plan_queue(files: DataFrame, options: Options, existing: DataFrame | None = None) -> DataFrame:
    """source, destination, queue_pos (by path), status before conversion: ok, exists or replaced."""
    root = F.lit(options.in_root) if options.in_root else None
    rows = files.filter(queue.supported("path")).select(F.col("path").alias("source"), queue.destination("path", F.lit(options.out_root), root).alias("destination"), F.col("path").alias("queue_pos"))
    there = existing if existing is not None else rows.select("destination").limit(0)
    return sinks.guard(rows, there, options.overwrite)


def clean(texts: DataFrame, options: Options) -> DataFrame:
    """C1-C3 and R18 on (doc_id the path, text): doc_id, text, fixes (rule -> count over 0)."""
    docs, counts = texts.select("doc_id", "text"), []
    if options.drop_empty_headings:
        docs = C.strip_empty_headings(docs).withColumnRenamed("altered", "c_empty_headings")
        counts.append("c_empty_headings")
    before = L.to_lines(docs)
    rows = C.running_lines(before).drop("in_fence") if options.strip_headers_footers else before.withColumn("boiler", F.lit(False))
    rows = rows.withColumn("boiler", F.col("boiler") & queue.strips_running_lines("doc_id"))
    kept = L.renumber(rows.filter(~F.col("boiler")).drop("boiler"))
    if options.strip_page_numbers:
        kept = C.page_number_lines(kept).filter(~(F.col("page_no") & queue.strips_page_numbers("doc_id"))).drop("page_no", "in_fence")
        kept = L.renumber(kept)
    if options.lint:
        out = C.lint(L.from_lines(kept))
    else:
        out = L.from_lines(kept).withColumn("fixes", F.create_map().cast("map<string,bigint>"))
    if not counts:
        return out
    first = docs.select("doc_id", F.col("c_empty_headings").cast("long").alias("n"))
    fixes = F.when(F.col("n") > 0, F.map_concat("fixes", F.create_map(F.lit("empty_headings"), F.col("n")))).otherwise(F.col("fixes"))
    return out.join(first, "doc_id", "left").select("doc_id", "text", fixes.alias("fixes"))


def scanned_files(pages: DataFrame) -> DataFrame:
    """P8 on page rows: path, is_scanned."""
    return layout.scanned(pages.filter("page_index >= 0"), "path").select("path", "is_scanned")


def detect_scanned(files: DataFrame) -> DataFrame:
    """P8 on files: path, is_scanned of each PDF."""
    return scanned_files(pdf.read_pages(files.filter(S.accepts_pdf("path"))))


def pdf_texts(pages: DataFrame, markers: bool) -> DataFrame:
    """SRC6, SRC8: path, text, error, route of page rows. A page without layout has its plain text, and so has a
    document whose layout is empty; a file that cannot be read has an error and no text."""
    # one pass over the pages: reading them is what costs. The row of a file that cannot be read has no page.
    marked = layout.page_markdown(pages.withColumnRenamed("path", "doc_id"), markers, F.coalesce("text", F.lit("")).alias("t"), F.when(F.col("page_index") < 0, F.col("error")).alias("error"))
    plain = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_index", "t"))), lambda x: x["t"]), "\n\n")
    out = layout.document_markdown(marked, plain.alias("plain"), F.max("error").alias("error")).withColumnRenamed("doc_id", "path")
    text = F.when(F.col("error").isNull(), S.with_fallback("markdown", "plain"))
    return out.select("path", text.alias("text"), "error", F.lit("text").alias("route"))


def convert_files(files: DataFrame, options: Options, registry: S.Registry | None = None, ocr: S.Convert | None = None) -> DataFrame:
    """path, text, error, route of each file. Every file is read and converted once: the rows are a written table."""
    registry = registry or S.Registry()
    told = "is_scanned" in files.columns
    own = registry.pick("x.pdf")
    if own is not None and own.priority <= 0:  # U1: a registered converter goes before the page operators
        if ocr is not None and not told:
            files = files.join(written(detect_scanned(files), "scanned"), "path", "left")
        return written(S.convert(files, registry, ocr), "converted")
    is_pdf = S.accepts_pdf("path")
    read = is_pdf & ~F.coalesce(F.col("is_scanned"), F.lit(False)) if ocr is not None and told else is_pdf
    pages = written(pdf.read_pages(files.filter(read)), "pages")
    if ocr is not None and not told:
        files = files.join(written(scanned_files(pages), "scanned"), "path", "left")
    laid_out = is_pdf & ~(F.coalesce(F.col("is_scanned"), F.lit(False)) if ocr is not None else F.lit(False))
    paths = files.filter(laid_out).select("path")
    texts = pdf_texts(pages.join(paths, "path", "left_semi"), options.images != "none")
    without = paths.join(pages.select("path"), "path", "left_anti")  # PDFs without pages
    texts = texts.unionByName(without.select("path", F.lit("").alias("text"), F.lit(None).cast("string").alias("error"), F.lit("text").alias("route")))
    return written(texts.unionByName(S.convert(files.filter(~laid_out), registry, ocr)), "converted")


def place_images(files: DataFrame, texts: DataFrame, options: Options) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text with its images in place; files to write: doc_id, name, content, None where none are).

    texts has doc_id (the path), text and prefix (the start of file names). Images stand
    where markers are; if none does, where the text has inline images; if it has none, in a
    section at the end.
    """
    if options.images == "none":
        return texts.select("doc_id", "text"), None
    embed = options.images == "embed"
    names = texts.select("doc_id", "prefix")
    of_pdf = written(pdf.read_images(files.filter(S.accepts_pdf("path"))).withColumnRenamed("path", "doc_id"), "pdf_images").join(names, "doc_id")
    least = of_pdf.filter("width >= 4 and height >= 4")
    of_zip = written(S.media(files).withColumnRenamed("path", "doc_id"), "zip_media")
    rendered = media.marker_uris(least) if embed else media.marker_files(least)
    marked = written(media.substitute_markers(texts, rendered.select("doc_id", "xref", "link")), "marked")
    bare = marked.filter("n_placed = 0").select("doc_id", "text").join(names, "doc_id")
    if embed:
        inline = media.truncated_to_base64(bare, of_zip).withColumn("n_inline", F.contains("text", F.lit("data:image/")).cast("int"))
        pdf_part, zip_part = media.pdf_image_section(least), media.zip_image_section(of_zip)
        made = None
    else:
        inline, inline_files = media.inline_to_files(bare, of_zip)
        inline = inline.withColumnRenamed("n_images", "n_inline")
        folder = F.lit(f"{media.SUBFOLDER}/")
        named_pdf = media.pdf_file_names(least)
        named_zip = of_zip.join(names, "doc_id")
        named_zip = named_zip.join(media.zip_file_names(named_zip), ["doc_id", "ord"])
        pdf_part = media.image_section(named_pdf, F.concat(folder, "name"), "page_index", "pos")
        zip_part = media.image_section(named_zip.drop("page_index"), F.concat(folder, "name"), "ord")
    inline = written(inline.select("doc_id", F.col("text").alias("inline"), "n_inline"), "inline")
    section = pdf_part.unionByName(zip_part)
    out = marked.join(inline, "doc_id", "left").join(section, "doc_id", "left")
    text = media.image_cascade(F.col("text"), F.col("n_placed"), F.col("text"), F.col("n_inline"), F.col("inline"), F.col("section"))
    if not embed:
        placed = marked.filter("n_placed > 0").select("doc_id")
        at_end = inline.filter("n_inline = 0").select("doc_id")
        made = rendered.select("doc_id", "name", "content").join(placed, "doc_id", "left_semi")
        made = made.unionByName(inline_files.select("doc_id", "name", "content"))
        for named in (named_pdf, named_zip):
            made = made.unionByName(named.select("doc_id", "name", "content").join(at_end, "doc_id", "left_semi"))
    return out.select("doc_id", text.alias("text")), made


@dataclass(frozen=True)
class Converted:
    """rows: source, destination, status, error, route, text, index, n_chars, near_empty, fixes, a row per file.
    media: destination, content of the image files that the texts link to; None where there are none."""

    rows: DataFrame
    media: DataFrame | None


def convert_all(files: DataFrame, options: Options, registry: S.Registry | None = None, ocr: S.Convert | None = None, existing: DataFrame | None = None, observation: Observation | None = None) -> Converted:
    """Convert a queue of files.

    A file that fails, or whose destination exists, has a status that says so and no text.
    An observation, if given, counts succeeded and failed rows as the result is produced.
    """
    todo = plan_queue(files, options, existing)
    chosen = files.join(todo.filter("status = 'ok'").select(F.col("source").alias("path")), "path", "left_semi")
    made = convert_files(chosen, options, registry, ocr)
    prefix = todo.select(F.col("source").alias("doc_id"), media.stem("destination").alias("prefix"), F.regexp_replace("destination", r"[^/]*\z", "").alias("folder"))
    raw = made.filter("text is not null").select(F.col("path").alias("doc_id"), "text")
    with_images, image_files = place_images(chosen, raw.join(prefix.drop("folder"), "doc_id"), options)
    final = written(clean(with_images, options), "cleaned")
    out = todo.join(made.select(F.col("path").alias("source"), "error", "route", F.col("text").isNotNull().alias("_made")), "source", "left")
    out = out.join(final.select(F.col("doc_id").alias("source"), "text", "fixes"), "source", "left")
    if options.make_index:
        on = raw if options.index_on == "raw" else final.select("doc_id", "text")
        pages = index.render_index(on.withColumn("_name", F.element_at(F.split("doc_id", "/"), -1)), "_name")
        out = out.join(pages.withColumnRenamed("doc_id", "source"), "source", "left")
    else:
        out = out.withColumn("index", F.lit(None).cast("string"))
    status = F.when(F.col("status") != "ok", F.col("status")).when(F.coalesce("_made", F.lit(False)), "ok").otherwise("failed")
    out = out.select("source", "destination", status.alias("status"), "error", "route", "text", "index", F.char_length("text").alias("n_chars"), queue.near_empty("text").alias("near_empty"), "fixes")
    if observation is not None:
        out = out.observe(observation, F.count_if(F.col("status") == "ok").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"))
    if image_files is not None:
        image_files = image_files.join(prefix, "doc_id").select(F.concat("folder", F.lit(f"{media.SUBFOLDER}/"), "name").alias("destination"), "content").dropDuplicates(["destination"])
    return Converted(out, image_files)


def convert_corpus(files: DataFrame, options: Options, registry: S.Registry | None = None, ocr: S.Convert | None = None, existing: DataFrame | None = None, observation: Observation | None = None) -> DataFrame:
    """The rows of convert_all."""
    return convert_all(files, options, registry, ocr, existing, observation).rows


def write_corpus(results: DataFrame, images: DataFrame | None = None, mounted: bool = False) -> DataFrame:
    """Write texts, their sidecar indexes and images to their destinations: path, n_bytes, error."""
    binary = lambda c: F.col(c).cast("binary").alias("content")
    every = results.filter("status = 'ok'").select("destination", binary("text"))
    every = every.unionByName(results.filter("status = 'ok' and index is not null").select(sinks.index_path("destination").alias("destination"), binary("index")))
    if images is not None:
        every = every.unionByName(images)
    return sinks.write_files(every, "destination", "content", mounted)
