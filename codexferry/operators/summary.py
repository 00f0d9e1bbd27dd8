"""Manifest outputs: indexes, nested rows, transfer rows, summaries, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexferry import constants as C
from codexferry.functions import text as T
from codexferry.functions.labels import origin_cell
from codexferry.operators.ordering import CHUNK_ITEMS, chunk_of, nest_chunks, number_rows

SOURCE_ITEM = [
    "title", "source_type", "added_timestamp", "source_url", "youtube_url", "youtube_channel",
    "word_count", "docx_path", "relative_sharepoint_path",
]
NOTE_ITEM = ["title", "content_text", "docx_path", "relative_sharepoint_path"]
ARTIFACT_ITEM = ["title", "artifact_type"]
NOTEBOOK_ITEM = [
    "owner_email", "m365_upn", "ge_target_email", "sharepoint_site_url", "title", "emoji",
    "metadata", "sharepoint_folder",
]


def index_lines(notebooks: DataFrame, sources: DataFrame) -> DataFrame:
    """Lines of each notebook's index, numbered; ``sources`` carry a position."""
    counts = sources.groupBy("nb_key").agg(F.count(F.lit(1)).alias("n_sources"))
    head = notebooks.join(counts, "nb_key", "left").select(
        "nb_key",
        "sharepoint_folder",
        F.posexplode(
            F.array(
                F.concat(F.lit("# "), F.coalesce("emoji", F.lit("None")), F.lit(" "), "title"),
                F.lit(""),
                F.concat(F.lit(C.INDEX_OWNER), "owner_email", F.lit("`")),
                F.concat(F.lit(C.INDEX_LIBRARY_OWNER), "m365_upn", F.lit("`")),
                F.concat(
                    F.lit(C.INDEX_TARGET_USER), "ge_target_email", F.lit("`")
                ),
                F.concat(
                    F.lit(C.INDEX_TOTAL),
                    F.coalesce("n_sources", F.lit(0)).cast("string"),
                ),
                F.lit(""),
                F.lit(C.INDEX_SECTION),
                F.lit(""),
                F.lit(C.INDEX_HEADER),
                F.lit(C.INDEX_RULE),
            )
        ).alias("line_no", "line"),
    )
    rows = sources.select(
        "nb_key",
        T.join_path(F.col("owner_email"), F.col("folder")).alias("sharepoint_folder"),
        (F.col("position") + 10).alias("line_no"),
        F.concat(
            F.lit("| "), F.col("position").cast("string"),
            F.lit(" | "), F.col("title"),
            F.lit(" | `"), F.col("source_type"),
            F.lit("` | "), origin_cell(F.col("source_url")),
            F.lit(" | `Sources/"), T.file_name(F.col("relative_sharepoint_path")), F.lit("` |"),
        ).alias("line"),
    )
    return head.withColumn("line_no", F.col("line_no").cast("long")).unionByName(rows)


def index_files(lines: DataFrame, size: int = 10_000) -> DataFrame:
    """Index lines as ``path, part, content``.

    An ordinary index is one part; a very long one has several, and its parts in
    order make the file.
    """
    part = F.floor(F.col("line_no") / size).cast("int")
    text = F.transform(
        F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]
    )
    return (
        lines.groupBy("sharepoint_folder", part.alias("part"))
        .agg(F.concat(F.array_join(text, "\n"), F.lit("\n")).alias("content"))
        .select(
            T.join_path(F.col("sharepoint_folder"), F.lit(C.INDEX_FILE)).alias("path"),
            "part",
            "content",
        )
    )


def nest_children(
    children: DataFrame, fields: list[str], name: str, size: int = CHUNK_ITEMS
) -> DataFrame:
    """Ordered children per notebook in chunks of bounded length."""
    return nest_chunks(children, ["nb_key"], F.struct(*fields), name=name, size=size)


def attach_children(
    notebooks: DataFrame,
    sources: DataFrame,
    notes: DataFrame,
    artifacts: DataFrame,
    size: int = CHUNK_ITEMS,
) -> DataFrame:
    """Notebooks with their nested children.

    One row per notebook and chunk: an ordinary notebook has one row, a very large
    one has several, each with at most ``size`` children of a kind. The three kinds
    share one shuffle. Children carry a position within their notebook.
    """
    kinds = [
        ("sources", sources, SOURCE_ITEM),
        ("notes", notes, NOTE_ITEM),
        ("artifacts", artifacts, ARTIFACT_ITEM),
    ]
    types = {
        name: df.select(F.struct("position", *fields).alias("x")).schema["x"].dataType.simpleString()
        for name, df, fields in kinds
    }
    rows = None
    for name, df, fields in kinds:
        part = df.select(
            "nb_key",
            chunk_of(F.col("position"), size).alias("chunk"),
            *[
                F.struct("position", *fields).alias(other)
                if other == name
                else F.lit(None).cast(types[other]).alias(other)
                for other, _, _ in kinds
            ],
        )
        rows = part if rows is None else rows.unionByName(part)

    def strip_position(fields):
        return lambda x: F.struct(*[x[f].alias(f) for f in fields])

    nested = rows.groupBy("nb_key", "chunk").agg(
        *[
            F.transform(F.array_sort(F.collect_list(name)), strip_position(fields)).alias(name)
            for name, _, fields in kinds
        ]
    )
    joined = notebooks.join(nested, "nb_key", "left").withColumn(
        "chunk", F.coalesce("chunk", F.lit(0))
    )
    for name, _, _ in kinds:
        joined = joined.withColumn(name, F.coalesce(name, F.array()))
    return joined


def transfer_manifest(notebooks: DataFrame, stage_root: str) -> DataFrame:
    """The seven columns that the transfer tools read, one row per notebook."""
    values = [
        T.join_path(F.lit(stage_root.rstrip("/")), F.col("sharepoint_folder")),
        F.lit(C.TRANSFER_LIBRARY),
        T.join_path(F.lit(C.TRANSFER_ROOT), T.sanitize_filename(F.col("title"))),
        F.col("sharepoint_site_url"),
        F.col("owner_email"),
        F.col("m365_upn"),
        F.col("ge_target_email"),
    ]
    return notebooks.select(*[v.alias(n) for v, n in zip(values, C.TRANSFER_COLUMNS)])


def package_entries(files: DataFrame, owners: DataFrame, path: str = "path") -> DataFrame:
    """Names of staged files in the package: the transfer list, the script, then the tree.

    With at most one owner the first path component goes.
    """
    several = owners.agg(
        F.coalesce(F.min("owner_email") != F.max("owner_email"), F.lit(False)).alias("several")
    ).scalar()
    own = F.col(path).isin(C.TRANSFER_FILE, C.SCRIPT_FILE)
    shorter = F.regexp_replace(F.col(path), r"(?s)\A[^/]*/", "")
    tree = files.where(~own).select(
        F.lit(2).alias("part"),
        F.when(several, F.col(path)).otherwise(shorter).alias("arcname"),
        F.col(path).alias("path"),
    )
    names = F.array(F.lit(C.TRANSFER_FILE), F.lit(C.SCRIPT_FILE))
    first = files.sparkSession.range(1).select(F.posexplode(names).alias("part", "path"))
    return first.select("part", F.col("path").alias("arcname"), "path").unionByName(tree)


def user_counts(notebooks: DataFrame, sources: DataFrame) -> DataFrame:
    """Counts per owner; both sides are aggregated before they meet."""
    per_owner = notebooks.groupBy(F.col("owner_email").alias("gws_email")).agg(
        # The identity columns depend on the owner alone.
        F.min("m365_upn").alias("m365_upn"),
        F.min("ge_target_email").alias("ge_target_email"),
        F.min("sharepoint_site_url").alias("sharepoint_site_url"),
        F.count(F.lit(1)).alias("notebook_count"),
    )
    per_source = sources.groupBy(F.col("owner_email").alias("gws_email")).agg(
        F.count(F.lit(1)).alias("source_count"),
        F.count_if(F.col("source_url") != "").alias("url_count"),
    )
    zero = F.lit(0).cast("long")
    return (
        per_owner.join(per_source, "gws_email", "left")
        .withColumn("source_count", F.coalesce("source_count", zero))
        .withColumn("url_count", F.coalesce("url_count", zero))
    )


def user_summary(
    notebooks: DataFrame,
    sources: DataFrame,
    order: list[str] | None = None,
    size: int = CHUNK_ITEMS,
) -> DataFrame:
    """Counts and notebook titles per owner.

    The title list comes in chunks of ``size``: an owner with more notebooks has
    several rows, with the same counts and the next titles.
    """
    order = order or ["root_path", "nb_file", "nb_key"]
    numbered = number_rows(
        notebooks.select(F.col("owner_email").alias("gws_email"), *order, "title"),
        ["gws_email"],
        order,
    )
    titles = nest_chunks(numbered, ["gws_email"], F.col("title"), name="notebooks", size=size)
    return user_counts(notebooks, sources).join(titles, "gws_email")


def distinct_users(notebooks: DataFrame) -> DataFrame:
    """Owners in order, one per row."""
    return notebooks.select("owner_email").distinct().orderBy("owner_email")


def manifest_totals(
    notebooks: DataFrame,
    sources: DataFrame,
    notes: DataFrame,
    artifacts: DataFrame,
    errors: DataFrame | None = None,
) -> DataFrame:
    """One row of counts over the whole manifest, and of what could not be read."""
    one = F.count(F.lit(1))
    unread = F.lit(0).cast("long") if errors is None else errors.agg(one.alias("n")).scalar()
    with_url = F.count_if(F.col("source_url") != "")
    return notebooks.agg(
        F.greatest(F.count_distinct("owner_email"), F.lit(1)).alias("user_count"),
        one.alias("notebook_count"),
    ).select(
        "user_count",
        "notebook_count",
        sources.agg(one.alias("n")).scalar().alias("total_sources"),
        sources.agg(with_url.alias("n")).scalar().alias("total_urls_recovered"),
        notes.agg(one.alias("n")).scalar().alias("total_notes"),
        artifacts.agg(one.alias("n")).scalar().alias("total_artifacts"),
        unread.alias("total_errors"),
    )


def preview_notebooks(
    notebooks: DataFrame, order: list[str], limit: int = C.PREVIEW_LIMIT
) -> DataFrame:
    """First notebooks for display, each with the full count."""
    total = notebooks.agg(F.count(F.lit(1)).alias("n")).scalar()
    return notebooks.orderBy(*order).limit(limit).withColumn("notebook_total", total)
