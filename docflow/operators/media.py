"""Embedded media: names, placeholders, inline images and content-addressed files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docflow.functions import text as T

# Fixed values.
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tif", ".tiff", ".webp")
MEDIA_PREFIX = {".docx": "word/media/", ".pptx": "ppt/media/", ".xlsx": "xl/media/"}
ZIP_DOCUMENTS = (*MEDIA_PREFIX, ".epub")
MIME = {".jpg": "jpeg", ".tif": "tiff"}
FILE_EXTENSION = {"jpeg": "jpg", "tiff": "tif", "svg+xml": "svg"}
#: A payload ends before the first bracket, quote or white space, but its first character may be white space.
INLINE_IMAGE = rf"data:image/([A-Za-z0-9.+-]+);base64(?:,([{T.BASE64_CHARS}=\s][{T.BASE64_CHARS}=]*)(?=[)\s\"'])|\.\.\.)"
MARKER = r"<!--image:x(\d+):w(\d+):h(\d+)-->"
SUBFOLDER = "images"


def _case(c: Column, table: dict[str, str], other: Column) -> Column:
    out = other
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def safe_stem(c: Column | str) -> Column:
    """M1: other characters than letters, digits, dot, underscore and hyphen become underscores."""
    bare = F.btrim(F.regexp_replace(T.col(c), r"[^A-Za-z0-9._-]+", "_"), F.lit("._-"))
    return F.when(bare == "", "image").otherwise(bare)


def stem(path: Column | str) -> Column:
    """A path's last part without its last suffix."""
    name = F.element_at(F.split(T.col(path), "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*\z", "")


def suffix(path: Column | str) -> Column:
    """A path's last suffix in lower case, with its dot."""
    return F.lower(F.regexp_extract(F.element_at(F.split(T.col(path), "/"), -1), r"(?<=.)(\.[^.]+)\z", 1))


def mime(ext: Column | str) -> Column:
    """M2: the image type of an extension."""
    return _case(T.col(ext), MIME, F.ltrim(T.col(ext), F.lit(".")))


def file_extension(kind: Column | str) -> Column:
    """M2, back: the extension of an image type."""
    low = F.lower(T.col(kind))
    return F.concat(F.lit("."), _case(low, FILE_EXTENSION, low))


def data_uri(content: Column | str, ext: Column | str) -> Column:
    return F.concat(F.lit("data:image/"), mime(ext), F.lit(";base64,"), T.base64_plain(content))


def image_section(images: DataFrame, target: Column, *order: str) -> DataFrame:
    """M3, M4 and the sections of SNK4, SNK5: doc_id, section of a document's images, linked to target.

    Images with page_index are told by page, xref and size, and grouped by page; others by number.
    """
    paged = "page_index" in images.columns
    w = Window.partitionBy("doc_id").orderBy(*order)
    if paged:
        alt = F.concat(F.lit("Page "), F.col("page_index") + 1, F.lit(" image "), F.col("xref"), F.lit(" ("), F.col("width"), F.lit("x"), F.col("height"), F.lit(")"))
    else:
        alt = F.concat(F.lit("image "), F.row_number().over(w))
    link = F.concat(F.lit("!["), alt, F.lit("]("), target, F.lit(")"))
    rows = images.withColumns({"_link": link, "_at": F.row_number().over(w)})
    joined = lambda name, s: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(name, s))), lambda x: x[s]), "\n\n")
    if paged:
        pages = rows.groupBy("doc_id", "page_index").agg(joined("_at", "_link").alias("_md"))
        rows = pages.select("doc_id", F.col("page_index").alias("_at"), F.concat(F.lit("### Page "), F.col("page_index") + 1, F.lit("\n\n"), "_md").alias("_link"))
    return rows.groupBy("doc_id").agg(F.concat(F.lit("## Embedded images\n\n"), joined("_at", "_link")).alias("section"))


def pdf_image_section(images: DataFrame) -> DataFrame:
    """M3: (doc_id, page_index, pos, xref, width, height, content, ext) to one section of base64 images by page."""
    return image_section(images, data_uri("content", "ext"), "page_index", "pos")


def zip_image_section(media: DataFrame) -> DataFrame:
    """M4: (doc_id, ord, content, ext) to a section of base64 images."""
    return image_section(media, data_uri("content", "ext"), "ord")


def pdf_file_names(images: DataFrame, prefix: str = "prefix") -> DataFrame:
    """SNK4: adds name, {stem}_p{page}_{xref} with the picture's suffix."""
    return images.withColumn("name", F.concat(safe_stem(prefix), F.lit("_p"), F.col("page_index") + 1, F.lit("_"), "xref", "ext"))


def media_route(path: Column | str) -> Column:
    """M5: pdf, zip or null."""
    ext = suffix(path)
    return F.when(ext == ".pdf", "pdf").when(ext.isin(*ZIP_DOCUMENTS), "zip")


def media_order(entry: Column | str) -> Column:
    """M6: a sort key: imageN by number, then others by stem."""
    s = F.lower(stem(entry))
    n = F.nullif(F.regexp_extract(s, r"^image(\d+)\z", 1), F.lit(""))
    return F.struct(n.isNull().alias("other"), F.coalesce(n.try_cast("decimal(38,0)"), F.lit(0)).alias("n"), F.when(n.isNull(), s).otherwise("").alias("stem"))


def tokens(docs: DataFrame, pattern: str, key: str = "doc_id", text: str = "text", *more: Column) -> DataFrame:
    """Text cut at matches: (key, place, piece, token, more), token null after the last piece."""
    found, between = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), F.split(F.col(text), pattern, -1)
    pairs = F.arrays_zip(between.alias("piece"), found.alias("token"))
    rows = docs.select(key, F.posexplode(pairs).alias("place", "x"), *more)
    return rows.select(key, "place", "x.piece", "x.token", *rows.columns[3:])


def join_tokens(rows: DataFrame, new: Column, key: str = "doc_id", *extra: Column) -> DataFrame:
    """Inverse of tokens, with new in place of each token."""
    return _joined(rows, F.when(F.col("token").isNotNull(), new), key, *extra)


def _joined(rows: DataFrame, new: Column, key: str, *extra: Column) -> DataFrame:
    """Pieces by place, each with new after it, if not null."""
    part = F.concat(F.coalesce("piece", F.lit("")), F.coalesce(new, F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct("place", part.alias("s"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["s"]), "").alias("text"), *extra)


def _images(docs: DataFrame, key: str, text: str = "text", *more: Column) -> DataFrame:
    """Tokens with kind (image type) and payload (null: cut short), neither of which has a comma or a semicolon in it."""
    payload = F.nullif(F.substring_index("token", ",", -1), F.lit(""))
    kind = F.lower(F.substr(F.substring_index("token", ";", 1), F.lit(len("data:image/") + 1)))
    rows = tokens(docs, INLINE_IMAGE, key, text, *more)
    return rows.withColumns({"kind": kind, "payload": F.when(F.contains("token", F.lit(",")), payload)})


def _nth(rows: DataFrame, cut: Column, key: str) -> DataFrame:
    """Adds nth, the count of the images cut short so far, null for other rows."""
    n = F.sum(cut.cast("int")).over(Window.partitionBy(key).orderBy("place"))
    return rows.withColumn("nth", n).withColumn("nth", F.when(cut, F.col("nth")))


def inline_images(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """M7: tokens with kind (image type), payload (null: cut short) and nth, the count of those cut short so far."""
    return _nth(_images(docs, key, text), F.col("token").isNotNull() & F.col("payload").isNull(), key)


def ordinal_media(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Media in M6 order with nth from 1, and n_media."""
    w = Window.partitionBy(key)
    return media.withColumn("nth", F.row_number().over(w.orderBy(media_order("entry_name"), "ord"))).withColumn("n_media", F.count("*").over(w))


def place_media(cut: DataFrame, media: DataFrame, key: str = "doc_id") -> DataFrame:
    """M8: each token cut short with the medium of its ordinal; those beyond the last get the last."""
    ranked = ordinal_media(media, key)
    n = ranked.groupBy(key).agg(F.max("n_media").alias("n_media"))
    asked = cut.join(n, key, "left").withColumn("nth", F.least("nth", "n_media")).drop("n_media")
    return asked.join(ranked.drop("n_media"), [key, "nth"], "left")


def _number(rows: DataFrame, first: str, key: str) -> DataFrame:
    """Adds image_no, the rank of the place at which a digest was first found."""
    rank = F.dense_rank().over(Window.partitionBy(key).orderBy(F.col(first).asc_nulls_last()))
    return rows.withColumn("image_no", F.when(F.col("digest").isNotNull(), rank))


def number_contents(rows: DataFrame, content: str, order: str, key: str = "doc_id") -> DataFrame:
    """M9: digest and image_no, equal contents of a document sharing the number of the first."""
    out = rows.withColumn("digest", F.when(F.col(content).isNotNull(), F.sha2(content, 256)))
    first = F.when(F.col("digest").isNotNull(), F.min(order).over(Window.partitionBy(key, "digest")))
    return _number(out.withColumn("_first", first), "_first", key)


def inline_to_files(docs: DataFrame, media: DataFrame, key: str = "doc_id", prefix: str = "prefix", folder: str = SUBFOLDER) -> tuple[DataFrame, DataFrame]:
    """(documents with inline images as links and n_images, files to write: key, name, content).

    docs has key, text and prefix (the file name's start). Whole images that do not decode
    stay; images cut short go where their document has no media. Rows meet media and are
    sorted without their tokens: texts by digests alone, files by one content each.
    """
    rows = _images(docs.filter(F.col(key).isNotNull()), key, "text", safe_stem(prefix).alias("_stem")).withColumn("whole", T.base64_strict("payload"))
    rows = rows.select(
        key, "place", "piece", "_stem", "whole",
        (F.col("token").isNotNull() & F.col("payload").isNull()).alias("cut"),
        F.when(F.col("payload").isNotNull() & (F.col("whole").isNull() | F.col("_stem").isNull()), F.col("token")).alias("kept"),
        F.when(F.col("payload").isNotNull(), F.col("kind")).alias("kind"),
        F.sha2("whole", 256).alias("digest"),
    )
    given = media.select(key, "ord", "entry_name", F.col("content").alias("media"), F.sha2("content", 256).alias("_given"), F.ltrim("ext", F.lit(".")).alias("_ext"))
    of_media = lambda theirs, own: F.when(F.col("cut"), F.col(theirs)).otherwise(F.col(own))
    taken = place_media(_nth(rows, F.col("cut"), key), given, key)
    taken = taken.withColumns({"content": of_media("media", "whole"), "kind": of_media("_ext", "kind"), "digest": of_media("_given", "digest")})
    same = Window.partitionBy(key, "digest").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def named(some: DataFrame, firsts: bool) -> DataFrame:
        told = some.repartition(key).withColumns({"_kind": F.first("kind", True).over(same), "_first": F.first("place").over(same)})
        told = told.withColumn("_first", F.when(F.col("digest").isNotNull(), F.col("_first")))
        told = told.filter("place = _first") if firsts else told
        name = F.concat("_stem", F.lit("_image"), "image_no", file_extension("_kind"))
        return _number(told, "_first", key).withColumn("name", F.when(F.col("image_no").isNotNull(), name))

    link = F.coalesce(F.concat(F.lit(f"{folder}/"), "name"), "kept")
    whole = named(taken.select(key, "place", "piece", "_stem", "kept", "kind", "digest"), False)
    texts = _joined(whole, link, key, F.coalesce(F.max("image_no"), F.lit(0)).alias("n_images"))
    files = named(taken.select(key, "place", "_stem", "kind", "digest", "content"), True)
    return texts, files.filter("name is not null").select(key, "name", "content")


def truncated_to_base64(docs: DataFrame, media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Images cut short become whole data URIs; without media they stay as they are."""
    rows = place_media(inline_images(docs, key), media.select(key, "ord", "entry_name", F.col("content").alias("media"), "ext"), key)
    whole = F.when(F.col("media").isNotNull(), data_uri("media", "ext"))
    return join_tokens(rows, F.when(F.col("payload").isNull(), F.coalesce(whole, F.col("token"))).otherwise(F.col("token")), key)


def model_ids(body: Column | str) -> Column:
    """The distinct ids of a model list in JSON, sorted; empty where there are none."""
    parsed = F.from_json(T.col(body), "data array<struct<id: string>>")
    ids = F.filter(F.transform(parsed["data"], lambda m: m["id"]), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.array_sort(F.array_distinct(ids)), F.array().cast("array<string>"))


def marker(xref: Column, width: Column, height: Column) -> Column:
    """M14."""
    return F.concat(F.lit("<!--image:x"), xref.cast("string"), F.lit(":w"), width.cast("string"), F.lit(":h"), height.cast("string"), F.lit("-->"))


def markers(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """M14, back: tokens with xref, width and height."""
    rows = tokens(docs, MARKER, key, text)
    number = lambda i: F.nullif(F.regexp_extract("token", MARKER, i), F.lit("")).try_cast("int")
    return rows.withColumns({"xref": number(1), "width": number(2), "height": number(3)})


def substitute_markers(docs: DataFrame, rendered: DataFrame, key: str = "doc_id") -> DataFrame:
    """Markers become what rendered (key, xref, link) has for them, or go. Adds n_placed."""
    rows = markers(docs, key).join(rendered.dropDuplicates([key, "xref"]), [key, "xref"], "left")
    return join_tokens(rows, F.col("link"), key, F.count_if(F.col("token").isNotNull() & F.col("link").isNotNull()).alias("n_placed"))


def marker_files(contents: DataFrame, key: str = "doc_id", prefix: str = "prefix", folder: str = SUBFOLDER) -> DataFrame:
    """Of (key, prefix, xref, content and, but for PNG, ext) one file per xref: key, xref, name, content, link."""
    once = contents.filter("content is not null").dropDuplicates([key, "xref"])
    name = F.concat(safe_stem(prefix), F.lit("_x"), F.col("xref"), F.col("ext") if "ext" in contents.columns else F.lit(".png"))
    return once.select(key, "xref", name.alias("name"), "content", F.concat(F.lit("![image]("), F.lit(f"{folder}/"), name, F.lit(")")).alias("link"))


def marker_uris(contents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of (key, xref, content and, but for PNG, ext) one data URI per xref: key, xref, link."""
    once = contents.filter("content is not null").dropDuplicates([key, "xref"])
    ext = F.col("ext") if "ext" in contents.columns else F.lit(".png")
    return once.select(key, "xref", F.concat(F.lit("![image]("), data_uri("content", ext), F.lit(")")).alias("link"))


def image_cascade(text: Column, n_placed: Column, placed: Column, n_inline: Column, inline: Column, section: Column) -> Column:
    """Markers if any was placed, or else inline images if any was written, or else a section at the end."""
    end = F.when(F.coalesce(section, F.lit("")) == "", text).otherwise(F.concat(T.rstrip(text), F.lit("\n\n"), section, F.lit("\n")))
    return F.when(F.coalesce(n_placed, F.lit(0)) > 0, placed).when(F.coalesce(n_inline, F.lit(0)) > 0, inline).otherwise(end)


def zip_file_names(media: DataFrame, key: str = "doc_id", prefix: str = "prefix") -> DataFrame:
    """SNK5's names: {prefix}_{stem}{ext}, and _2, _3 ... where a document has used the name already: key, ord, name.

    A generated name can meet a real one later, so names are a walk over a document's
    entries; a set and the next number of each name keep it linear.
    """
    base = F.concat(safe_stem(prefix), F.lit("_"), safe_stem(stem("entry_name")))
    rows = media.select(F.col(key).alias("key"), "ord", base.alias("base"), "ext")

    def walk(entries: pa.Table) -> pa.Table:
        entries = entries.sort_by([("ord", "ascending")])
        used: set[str] = set()
        following: dict[tuple[str, str], int] = {}
        names = []
        for stem_of, ext in zip(entries.column("base").to_pylist(), entries.column("ext").to_pylist(), strict=True):
            n = following.get((stem_of, ext), 1)
            while (name := f"{stem_of}{f'_{n}' if n > 1 else ''}{ext}") in used:
                n += 1
            following[stem_of, ext] = n + 1
            used.add(name)
            names.append(name)
        return pa.table([entries.column("key"), entries.column("ord"), pa.array(names, pa.string())], names=["key", "ord", "name"])

    kinds = dict(rows.dtypes)
    out = rows.groupBy("key").applyInArrow(walk, f"key {kinds['key']}, ord {kinds['ord']}, name string")
    return out.withColumnRenamed("key", key)
