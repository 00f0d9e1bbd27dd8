"""The driver's tables in the shape of the operators' inputs."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexferry.functions import text as T
from codexferry.operators.identity import identity_map
from codexferry.operators.notebooks import merge_notebooks, notebook_rows
from codexferry.plans.manifest import Extracted, Manifest, extract, merge
from codexferry.storage import spread

DEFAULT_OWNER = "default@old.example"
STAGE_ROOT = "/stage"


# Tables of long texts: work on them is worth all cores.
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows, TEXT_TABLES[name]) if name in TEXT_TABLES else rows


def user(number: Column) -> Column:
    digits = number.cast("string")
    return F.concat(F.lit("user"), F.lpad(digits, F.greatest(F.lit(3), F.length(digits)), "0"))


def text_of(number: Column) -> Column:
    return number.cast("string")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as an export: 40 are an owner, 20 a copy, 4 a notebook of a copy."""
    doc = F.col("doc_id")
    book = text_of(F.floor(doc % 20 / 4))
    copy = F.floor(doc / 20) % 2
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return (
        rows.withColumn("owner", F.concat(user(F.floor(doc / 40)), F.lit("@old.example")))
        .withColumn("copy", copy)
        .withColumn("book_dir", F.concat(F.lit("Book "), book))
        .withColumn(
            "book_title",
            F.concat(F.when(copy == 1, "BOOK ").otherwise("Book "), book, F.lit(": é")),
        )
        .withColumn("base", F.concat("lang", text_of(doc % 4)))
        .withColumn(
            "kind",
            F.when(F.col("lang") == "en", "URL")
            .when(F.col("lang") == "fr", "YOUTUBE_VIDEO")
            .when(F.col("lang") == "de", "PDF")
            .otherwise("POWERPOINT"),
        )
        .withColumn("broken", doc % 17 == 3)
        .withColumn("pageless", doc % 23 == 5)
        .withColumn(
            "root_path",
            F.concat(
                F.lit("export"), text_of(copy), F.lit("/"), "owner", F.lit("/Export/"), "book_dir"
            ),
        )
    )


def text_line_blocks(text: Column) -> Column:
    """Paragraph blocks from plain text: one per line that is not blank."""
    lines = F.transform(F.split(text, T.LINE_END, -1), T.strip_space)
    return F.transform(
        F.filter(lines, lambda x: x != ""),
        lambda x: F.struct(
            F.lit("paragraph").alias("type"),
            F.lit(None).cast("int").alias("level"),
            x.alias("text"),
        ),
    )


def blockless_html(text: Column) -> Column:
    """A page that has the text but no block around it."""
    return F.concat(F.lit("<div>"), _escaped(text), F.lit("</div>"))


def paragraph_html(text: Column) -> Column:
    """A page with a paragraph for each line, empty ones too."""
    lines = F.transform(
        F.split(text, "\n", -1), lambda x: F.concat(F.lit("<p>"), _escaped(x), F.lit("</p>"))
    )
    return F.array_join(lines, "")


def _escaped(text: Column) -> Column:
    for char, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]:
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def notebook_json(d: DataFrame) -> DataFrame:
    """``root_path, nb_file, metadata``: one row per notebook copy."""
    return d.select(
        "root_path",
        F.concat("book_dir", F.lit(" metadata.json")).alias("nb_file"),
        F.to_json(F.struct(F.col("book_title").alias("title"))).alias("metadata"),
    ).distinct()


def source_json() -> Column:
    video = F.struct(
        F.concat(F.lit("v"), text_of(F.col("doc_id"))).alias("videoId"),
        F.col("source").alias("channelName"),
    )
    inner = F.struct(
        F.concat(F.lit("SOURCE_CONTENT_TYPE_"), "kind").alias("originalSourceContentType"),
        F.concat(F.lit("T"), text_of(F.col("doc_id"))).alias("sourceAddedTimestamp"),
        F.when(F.col("lang") == "fr", video).alias("youtubeMetadata"),
    )
    whole = F.to_json(F.struct(inner.alias("metadata")))
    # A broken file ends early or goes on after its end.
    broken = F.when(F.col("doc_id") % 2 == 0, F.substring(whole, 1, 30)).otherwise(
        F.concat(whole, F.lit(" {}"))
    )
    return F.when(F.col("broken"), broken).otherwise(whole)


def source_html() -> Column:
    """Heading, the whole text, a blocked link and the address of the page."""
    return F.concat(
        F.lit("<h1>"), "base", F.lit("</h1><p>"), _escaped(F.col("text")),
        F.lit('</p><a href="https://twitter.com/share">share</a><a href="https://'),
        "source", F.lit(".example/"), "lang", F.lit("/"), text_of(F.col("doc_id")),
        F.lit('/?utm_source=feed#top">page</a>'),
    )


def note_html() -> Column:
    return F.concat(
        F.lit("<p>"), _escaped(F.col("text")), F.lit("</p><p>"), "lang", F.lit("</p>")
    )


def artifact_json() -> Column:
    french = F.to_json(
        F.struct(F.lit("APP_TYPE_FR").alias("appType"), F.col("source").alias("title"))
    )
    spanish = F.to_json(F.struct(F.lit("ARTIFACT_TYPE_ES").alias("artifactType")))
    return (
        F.when(F.col("lang") == "fr", french)
        .when(F.col("broken") & (F.col("doc_id") % 2 == 0), F.lit("[1"))
        .when(F.col("broken"), F.concat(spanish, F.lit("]")))
        .otherwise(spanish)
    )


def export_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as the files of an export."""
    d = docs(spark, sf_dir)
    number = text_of(F.col("doc_id"))

    def files(rows: DataFrame, folder: str, name: Column, content: Column) -> DataFrame:
        path = F.concat("root_path", F.lit(folder), name)
        return rows.select(path.alias("entry_path"), content.alias("content"))

    meta = F.lit(" metadata.json")
    note, art = F.concat(F.lit("Note "), number), F.concat(F.lit("Art "), number)
    pages = d.where(~F.col("pageless"))
    books = notebook_json(d)
    # No notebook: text follows the object.
    tailed = books.select(
        F.concat("root_path", F.lit("/Tail metadata.json")).alias("entry_path"),
        F.concat("metadata", F.lit(" x")).alias("content"),
    )
    tree = (
        books.select(
            F.concat("root_path", F.lit("/"), "nb_file").alias("entry_path"),
            F.col("metadata").alias("content"),
        )
        .unionByName(tailed)
        .unionByName(files(d, "/Sources/", F.concat("base", meta), source_json()))
        .unionByName(files(pages, "/Sources/", F.concat("base", F.lit(".html")), source_html()))
        .unionByName(
            files(d.where("lang = 'de'"), "/Notes/", F.concat(note, F.lit(".html")), note_html())
        )
        .unionByName(
            files(d.where("lang in ('fr', 'es')"), "/Artifacts/", F.concat(art, meta), artifact_json())
        )
    )
    return tree.select(
        F.lit("export").alias("archive"),
        "entry_path",
        F.lit(0).cast("long").alias("entry_no"),
        F.encode("content", "UTF-8").alias("content"),
        F.lit(None).cast("string").alias("entry_error"),
    )


def extracted(spark: SparkSession, sf_dir: str) -> Extracted:
    return extract(export_tree(spark, sf_dir), DEFAULT_OWNER)


def manifest(spark: SparkSession, sf_dir: str) -> Manifest:
    return merge(extracted(spark, sf_dir))


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notebook copies straight from their metadata."""
    return notebook_rows(notebook_json(docs(spark, sf_dir)), DEFAULT_OWNER)


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_notebooks(copies(spark, sf_dir))


def raw_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as identity rows with untidy headers and values, some written twice."""
    customer = table(spark, sf_dir, "customer")
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    name = user(key)
    first = customer.select(
        key.alias("line_no"),
        F.when(segment == "MACHINERY", " ")
        .otherwise(F.concat(F.lit(" User"), F.substring(name, 5, 20), F.lit("@OLD.example ")))
        .alias(" Source_Email"),
        F.when(segment == "BUILDING", "")
        .otherwise(F.concat(name, F.lit("@new.example")))
        .alias("TARGET_UPN "),
        F.when(segment == "FURNITURE", F.concat(F.lit(" "), name, F.lit("@cloud.example"))).alias(
            "ge_target_email"
        ),
        F.when(segment == "HOUSEHOLD", F.concat(F.lit("https://site.example/"), text_of(key)))
        .otherwise("")
        .alias("SharePoint_Site_URL"),
    )
    last = customer.agg((F.max("c_custkey") + 1).alias("n")).scalar()
    none = F.lit(None).cast("string")
    late = customer.where((F.col("c_nationkey") == 7) & (segment != "MACHINERY")).select(
        key + last,
        F.concat(name, F.lit("@old.example")),
        F.concat(name, F.lit("@late.example")),
        none,
        none,
    )
    return first.union(late)


def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity_map(raw_identity(spark, sf_dir))


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with absolute links and a link to themselves; ``title`` is the page's."""
    origin = F.regexp_extract("url", r"^[a-z]+://[^/?#]*", 0)
    return table(spark, sf_dir, "pages").select(
        "page_id",
        "url",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.concat(
            F.replace("html", F.lit('href="/'), F.concat(F.lit('href="'), origin, F.lit("/"))),
            F.lit('<a href="'), "url", F.lit('">'),
        ).alias("html"),
    )


# --- archives made by Spark ----------------------------------------------------


def zipped(files: DataFrame, flagged: bool = True) -> DataFrame:
    """``archive, names array, contents array`` as ``archive, content``, one ZIP each.

    Without ``flagged`` names are raw UTF-8 bytes and bit 11 is unset.
    """

    def pack(names: list[str], contents: list[bytes]) -> bytes:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as zf:
            for name, data in zip(names, contents):
                info = zipfile.ZipInfo(name)
                info.compress_type = zipfile.ZIP_DEFLATED
                zf.writestr(info, data)
        raw = bytearray(buffer.getvalue())
        if not flagged:
            with zipfile.ZipFile(io.BytesIO(raw)) as zf:
                heads = [i.header_offset for i in zf.infolist()]
                at = zf.start_dir
            for head in heads:
                raw[head + 7] &= 0xF7
            for _ in heads:
                raw[at + 9] &= 0xF7
                sizes = [int.from_bytes(raw[at + k : at + k + 2], "little") for k in (28, 30, 32)]
                at += 46 + sum(sizes)
        return bytes(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A batch goes out in pieces: packed archives do not pile up beside it.
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                archives, names, contents = batch.slice(start, 256).columns
                packed = [pack(n.as_py(), c.as_py()) for n, c in zip(names, contents)]
                yield pa.RecordBatch.from_arrays(
                    [archives, pa.array(packed, pa.binary())], names=["archive", "content"]
                )

    return files.select("archive", "names", "contents").mapInArrow(
        run, "archive string, content binary"
    )


def archive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One archive per document: a page, and an archive with its note inside."""
    d = docs(spark, sf_dir)
    number = text_of(F.col("doc_id"))
    body = F.encode("text", "UTF-8")
    inner = zipped(
        d.select(
            number.alias("archive"),
            F.array(F.concat(F.lit("Notes/n"), number, F.lit(".txt"))).alias("names"),
            F.array(body).alias("contents"),
        )
    ).withColumnRenamed("content", "inner")
    joined = d.withColumn("archive", number).join(inner, "archive")
    return zipped(
        joined.select(
            F.concat(F.lit("in/"), number, F.lit("-"), "owner", F.lit("/t.zip")).alias("archive"),
            F.array(
                F.concat(F.lit("Página/é"), number, F.lit(".txt")),
                F.concat(F.lit("more/part-"), "lang", F.lit("@nested.example.zip")),
                F.concat(F.lit("broken"), number, F.lit(".zip")),
            ).alias("names"),
            F.array(body, F.col("inner"), F.encode(F.lit("no archive"), "UTF-8")).alias("contents"),
        ),
        flagged=False,
    )
