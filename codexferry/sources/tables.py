"""Tables: identity maps, manifests, ledgers, transfer lists, staged files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexferry import constants as C
from codexferry.operators.provision import ledger_latest
from codexferry.sinks.commits import commits, newest
from codexferry.sources.archives import binary_files, relative_path

LEDGER_SCHEMA = (
    "checkpoint_key string, chunk int, status string, entry string, version long, seq long"
)

#: A notebook with its nested children, as ``write_nested_manifest`` writes it.
MANIFEST_JSON_SCHEMA = (
    "nb_key string, owner_email string, root_path string, nb_file string, metadata string, "
    "title string, emoji string, folder string, sharepoint_folder string, m365_upn string, "
    "ge_target_email string, sharepoint_site_url string, chunk int, "
    "sources array<struct<title:string,source_type:string,added_timestamp:string,"
    "source_url:string,youtube_url:string,youtube_channel:string,word_count:bigint,"
    "docx_path:string,relative_sharepoint_path:string>>, "
    "notes array<struct<title:string,content_text:string,docx_path:string,"
    "relative_sharepoint_path:string>>, artifacts array<struct<title:string,artifact_type:string>>"
)


def read_identity_map(spark: SparkSession, uri: str) -> DataFrame:
    """Identity CSV as it is; ``line_no`` orders rows by file name, then by line."""
    return (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(uri)
        # A multi-line file is one split, so the number follows its lines; Spark packs files into
        # tasks by size, so the file's path goes first.
        .select(
            "*",
            F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.monotonically_increasing_id().alias("line"),
            ).alias("line_no"),
        )
    )


def read_manifest(spark: SparkSession, uri: str) -> dict[str, DataFrame]:
    """Tables of a written manifest by name."""
    base = uri.rstrip("/")
    return {
        name: spark.read.parquet(f"{base}/{name}")
        for name in ("notebooks", "sources", "notes", "artifacts")
    }


def read_manifest_json(
    spark: SparkSession, uri: str, multi_line: bool = False, schema: str = MANIFEST_JSON_SCHEMA
) -> DataFrame:
    """The JSON form of a manifest: one row per line; with ``multi_line`` a document per file.

    The schema is stated, so that the text is read once and an empty list keeps its columns.
    """
    return spark.read.schema(schema).option("multiLine", multi_line).json(uri)


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER_SCHEMA)


def ledger_version(spark: SparkSession, uri: str) -> int:
    """Number of a ledger's newest commit, 0 if there is none."""
    return newest(spark, uri.rstrip("/"))


def ledger_state(spark: SparkSession, uri: str, version: int | None = None) -> tuple[str | None, dict[str, int]]:
    """The folder of the snapshot that counts (none if there is none or it was cleared), and the
    deltas on top of it with their commits' numbers; as of a commit if one is named.

    The driver gets the commits on top of the snapshot only: few, since many are compacted.
    """
    log = commits(spark, uri.rstrip("/"))
    if log is None:
        return None, {}
    if version is not None:
        log = log.where(F.col("version") <= version)
    whole = log.where("kind != 'delta'").orderBy(F.desc("upto"), F.desc("version")).first()
    upto = whole.upto if whole else 0
    deltas = log.where((F.col("kind") == "delta") & (F.col("version") > upto)).collect()
    return whole.folder if whole else None, {r.folder: r.version for r in deltas}


def read_ledger(spark: SparkSession, uri: str, version: int | None = None) -> DataFrame:
    """The latest entry of each key of a ledger, as of its newest or the named commit; empty if there is none.

    Entries of one version and sequence are those of the later commit.
    """
    base = uri.rstrip("/")
    snapshot, deltas = ledger_state(spark, base, version)
    folders = [*([snapshot] if snapshot else []), *deltas]
    if not folders:
        return empty_ledger(spark)
    rows = spark.read.schema(LEDGER_SCHEMA).parquet(*(f"{base}/entries/{f}" for f in folders))
    if not deltas:
        return rows
    numbers = F.create_map(*(x for f, n in deltas.items() for x in (F.lit(f), F.lit(n))))
    folder = F.regexp_extract(F.col("_metadata.file_path"), "/entries/([^/]+)/", 1)
    rows = rows.withColumn("commit", F.coalesce(F.try_element_at(numbers, folder), F.lit(0)))
    return ledger_latest(rows, ("version", "seq", "commit"))


def read_transfer_manifest(spark: SparkSession, uri: str) -> DataFrame:
    """The columns of a transfer list by the names in its header, in any order."""
    rows = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("multiLine", True)
        .csv(uri)
    )
    missing = [c for c in C.TRANSFER_COLUMNS if c not in rows.columns]
    if missing:
        raise ValueError(f"columns missing in {uri}: {', '.join(missing)}")
    return rows.select(*C.TRANSFER_COLUMNS)


def list_staged_files(spark: SparkSession, uri: str) -> DataFrame:
    """Path and length of staged files; their content is never read."""
    rel_path = relative_path(F.col("path"), uri).alias("rel_path")
    return binary_files(spark, uri).select("path", rel_path, "length")


def wave_rows(
    users: DataFrame, index: Column, source_domain: str, target_domain: str, site_prefix: str
) -> DataFrame:
    """Identity rows ``user001`` and up, one for each row's index."""
    digits = index.cast("string")
    name = F.concat(F.lit("user"), F.lpad(digits, F.greatest(F.lit(3), F.length(digits)), "0"))
    old, new = F.concat(name, F.lit("@" + source_domain)), F.concat(name, F.lit("@" + target_domain))
    return users.select(
        old.alias("gws_email"),
        new.alias("m365_upn"),
        old.alias("ge_target_email"),
        F.concat(F.lit(site_prefix), new).alias("sharepoint_site_url"),
    )


def generate_wave(
    spark: SparkSession,
    count: int,
    source_domain: str,
    target_domain: str,
    site_prefix: str = C.SITE_URL_PREFIX,
) -> DataFrame:
    """Identity rows for a wave of ``count`` users."""
    return wave_rows(
        spark.range(1, count + 1), F.col("id"), source_domain, target_domain, site_prefix
    )
