"""Archives, trees, identity and the notebook model."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codexferry import constants as C
from codexferry.bindings import adapters as A
from codexferry.bindings import sqltext as Q
from codexferry.bindings.registry import query
from codexferry.functions import text as T
from codexferry.operators import identity as I
from codexferry.operators import notebooks as N
from codexferry.operators.ordering import number_rows
from codexferry.plans.manifest import extract, merge
from codexferry.sinks.writers import export_files
from codexferry.sources import archives as R
from codexferry.sources import tables as S
from codexferry.storage import shared_dir

OWNER = f"'{A.DEFAULT_OWNER}'"

# --- archives ------------------------------------------------------------------

PACKED = f"""{Q.DOCS},
packed AS (SELECT *, 'in/' || doc_id::VARCHAR || '-' || owner || '/t.zip' AS archive FROM docs)"""

REPAIRED = f"""{PACKED},
entries AS (
  SELECT archive, {OWNER} || '/Página/é' || doc_id::VARCHAR || '.txt' AS entry_path, md5(text) AS content_md5, false AS failed FROM packed
  UNION ALL SELECT archive, {OWNER} || '/part-' || lang || '@nested.example/Notes/n' || doc_id::VARCHAR || '.txt', md5(text), false FROM packed
  UNION ALL SELECT archive, {OWNER} || '/broken' || doc_id::VARCHAR || '.zip', md5('no archive'), true FROM packed)"""


def _entries(df, uri=None):
    archive = F.col("archive") if uri is None else R.relative_path(F.col("archive"), uri)
    return df.select(
        archive.alias("archive"),
        "entry_path",
        F.md5("content").alias("content_md5"),
        F.col("entry_error").isNotNull().alias("failed"),
    )


def _archives(spark, sf):
    """Archives with their place: several archives, so each goes below its owner."""
    rows = A.archive_rows(spark, sf)
    count = A.table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.withColumn("dest", R.archive_dest(F.col("archive"), count, A.DEFAULT_OWNER))


def _files(spark, rows, name):
    """The contents of rows as files of a new shared folder."""
    uri = f"{shared_dir(spark)}/out-{uuid.uuid4().hex}"
    export_files(rows.select(F.col(name).alias("path"), "content"), uri)
    return uri


@query(
    "read_archives",
    f"WITH {REPAIRED} SELECT archive, entry_path, content_md5, failed FROM entries",
)
def read_archives(spark, sf):
    """Archives as files, read where they lie."""
    uri = _files(spark, A.archive_rows(spark, sf), "archive")
    return _entries(R.read_archives(spark, uri, A.DEFAULT_OWNER), uri)


@query(
    "archive_errors",
    f"""WITH {REPAIRED} SELECT archive, entry_path FROM entries WHERE failed
    UNION ALL SELECT archive || '.cut.zip', NULL FROM packed WHERE doc_id % 10 = 0""",
)
def archive_errors(spark, sf):
    """What an extraction could not read: damaged entries, and archives that end early."""
    rows = A.archive_rows(spark, sf)
    number = F.regexp_extract("archive", "^in/([0-9]+)-", 1).cast("long")
    cut = rows.where(number % 10 == 0).select(
        F.concat("archive", F.lit(".cut.zip")).alias("archive"),
        F.substring("content", 1, 20).alias("content"),
    )
    uri = _files(spark, rows.unionByName(cut), "archive")
    tree = R.read_archives(spark, uri, A.DEFAULT_OWNER)
    errors = extract(tree, A.DEFAULT_OWNER, allow_unreadable=True).errors
    return errors.select(R.relative_path(F.col("archive"), uri).alias("archive"), "entry_path")


@query(
    "repair_entry_name",
    f"WITH {PACKED} SELECT archive, 'Página/é' || doc_id::VARCHAR || '.txt' AS entry_name FROM packed",
)
def repair_entry_name(spark, sf):
    flat = _archives(spark, sf).withColumn("dest", F.lit(""))
    entries = R.unzip(flat, A.DEFAULT_OWNER, nested=False)
    return entries.where(~F.col("entry_path").endswith(".zip")).select(
        "archive", F.col("entry_path").alias("entry_name")
    )


@query(
    "unnest_archives",
    f"""WITH {REPAIRED} SELECT archive, entry_path, content_md5 FROM entries
    WHERE entry_path LIKE '%@nested.example/%'""",
)
def unnest_archives(spark, sf):
    entries = _entries(R.unzip(_archives(spark, sf), A.DEFAULT_OWNER))
    return entries.where(F.col("entry_path").contains("@nested.example/")).drop("failed")


@query(
    "read_export_bucket",
    f"""WITH {PACKED},
    named AS (SELECT *, {Q.owner_in('archive', OWNER)} AS dest FROM packed)
    SELECT 'loose/' || doc_id::VARCHAR || '.txt' AS archive, 'loose/' || doc_id::VARCHAR || '.txt' AS entry_path, false AS failed FROM packed
    UNION ALL SELECT archive, dest || '/more/part-' || lang || '@nested.example.zip' AS entry_path, false AS failed FROM named
    UNION ALL SELECT archive, dest || '/broken' || doc_id::VARCHAR || '.zip', false FROM named
    UNION ALL SELECT archive, dest || '/P├ígina/├⌐' || doc_id::VARCHAR || '.txt', false FROM named""",
)
def read_export_bucket(spark, sf):
    """Names stay as the archive gives them and inner archives stay files."""
    loose = A.docs(spark, sf).select(
        F.concat(F.lit("loose/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("archive"),
        F.encode("text", "UTF-8").alias("content"),
    )
    uri = _files(spark, A.archive_rows(spark, sf).unionByName(loose), "archive")
    return _entries(R.read_export_bucket(spark, uri, A.DEFAULT_OWNER), uri).drop("content_md5")


TREE = f"""{Q.DOCS.replace('WITH', '')},
tree AS (
  SELECT DISTINCT root_path || '/' || book_dir || ' metadata.json' AS entry_path FROM rooted
  UNION ALL SELECT DISTINCT root_path || '/Tail metadata.json' FROM rooted
  UNION ALL SELECT root_path || '/Sources/' || base || ' metadata.json' FROM rooted
  UNION ALL SELECT root_path || '/Sources/' || base || '.html' FROM rooted WHERE NOT pageless
  UNION ALL SELECT root_path || '/Notes/Note ' || doc_id::VARCHAR || '.html' FROM rooted WHERE lang = 'de'
  UNION ALL SELECT root_path || '/Artifacts/Art ' || doc_id::VARCHAR || ' metadata.json' FROM rooted
    WHERE lang IN ('fr', 'es')),
split_tree AS (
  SELECT entry_path, regexp_extract(entry_path, '^(.*)/[^/]*$', 1) AS dir,
         regexp_extract(entry_path, '([^/]*)/[^/]*$', 1) AS dir_name,
         regexp_extract(entry_path, '[^/]*$') AS file FROM tree)"""


@query(
    "list_export_tree",
    f"WITH {TREE} SELECT entry_path, dir, dir_name, file FROM split_tree",
)
def list_export_tree(spark, sf):
    """The files of an export on storage."""
    uri = _files(spark, A.export_tree(spark, sf), "entry_path")
    tree = R.list_export_tree(spark, uri)
    return N.split_tree(tree).select("entry_path", "dir", "dir_name", "file")


@query(
    "skip_child_dirs",
    f"""WITH {TREE} SELECT dir, file FROM split_tree
    WHERE dir_name NOT IN ({Q.quoted(C.CHILD_DIRS)})""",
)
def skip_child_dirs(spark, sf):
    files = N.split_tree(A.export_tree(spark, sf))
    return files.where(N.skip_child_dirs(F.col("dir_name"))).select("dir", "file")


# --- identity ------------------------------------------------------------------


@query(
    "normalize_identity",
    f"""WITH {Q.IDENTITY} SELECT line_no, gws_email, m365_upn, ge_target_email, sharepoint_site_url FROM normalized""",
)
def normalize_identity(spark, sf):
    return I.normalize_identity(A.raw_identity(spark, sf))


@query(
    "mapped_rows_only",
    f"WITH {Q.IDENTITY} SELECT line_no, gws_email FROM normalized WHERE gws_email IS NOT NULL",
)
def mapped_rows_only(spark, sf):
    rows = I.normalize_identity(A.raw_identity(spark, sf))
    return I.mapped_rows_only(rows).select("line_no", "gws_email")


@query("identity_last_wins", f"WITH {Q.IDENTITY} SELECT * FROM identity")
def identity_last_wins(spark, sf):
    return A.identity(spark, sf)


@query(
    "map_identity",
    f"""WITH {Q.BOOKS}, {Q.IDENTITY}, {Q.mapped('copies')}
    SELECT root_path, owner_email, m365_upn, ge_target_email, sharepoint_site_url FROM mapped""",
)
def map_identity(spark, sf):
    mapped = I.map_identity(A.copies(spark, sf), A.identity(spark, sf))
    return mapped.select(
        "root_path", "owner_email", "m365_upn", "ge_target_email", "sharepoint_site_url"
    )


@query(
    "generate_wave",
    f"""SELECT {Q.user('c_custkey + 1')} || '@old.example' AS gws_email,
    {Q.user('c_custkey + 1')} || '@new.example' AS m365_upn,
    {Q.user('c_custkey + 1')} || '@old.example' AS ge_target_email,
    'https://site.example/' || {Q.user('c_custkey + 1')} || '@new.example' AS sharepoint_site_url FROM customer""",
)
def generate_wave(spark, sf):
    customers = A.table(spark, sf, "customer")
    return S.wave_rows(
        customers, F.col("c_custkey") + 1, "old.example", "new.example", "https://site.example/"
    )


# --- notebook model --------------------------------------------------------------


@query(
    "read_notebook_meta",
    f"""WITH {Q.BOOKS} SELECT root_path, nb_file, owner_email, title, '📓' AS emoji, folder, nb_key,
    '{{"title":"' || title || '"}}' AS metadata FROM copies""",
)
def read_notebook_meta(spark, sf):
    return N.discover_notebooks(A.export_tree(spark, sf), A.DEFAULT_OWNER).drop("sharepoint_folder")


@query(
    "attach_html",
    f"""WITH {Q.DOCS} SELECT root_path || '/Sources' AS dir, base, pageless AS no_page, broken AS unreadable
    FROM rooted""",
)
def attach_html(spark, sf):
    files = N.split_tree(A.export_tree(spark, sf)).where("dir_name = 'Sources'")
    unreadable = N.json_object(N.json_text(F.col("metadata")), N.NOTEBOOK_JSON).isNull()
    return N.attach_html(files).select(
        "dir", "base", F.col("html").isNull().alias("no_page"), unreadable.alias("unreadable")
    )


@query(
    "read_source_meta",
    f"""WITH {Q.SOURCES} SELECT root_path, file, title, source_type, added_timestamp, youtube_url,
    youtube_channel, source_url, word_count FROM all_sources""",
)
def read_source_meta(spark, sf):
    """Sources of every copy with address and word count, read from the files."""
    return N.parse_sources(N.discover_sources(A.export_tree(spark, sf))).drop("blocks")


@query(
    "read_artifact_meta",
    f"WITH {Q.CHILDREN} SELECT root_path, file, title, artifact_type FROM raw_artifacts",
)
def read_artifact_meta(spark, sf):
    return N.discover_artifacts(A.export_tree(spark, sf))


@query(
    "read_notes",
    f"WITH {Q.CHILDREN} SELECT root_path, file, title, content_text FROM raw_notes",
)
def read_notes(spark, sf):
    return N.discover_notes(A.export_tree(spark, sf)).drop("blocks")


@query(
    "merge_notebooks",
    f"""WITH {Q.BOOKS} SELECT nb_key, root_path, nb_file, title, sharepoint_folder FROM books""",
)
def merge_notebooks(spark, sf):
    return A.books(spark, sf).select("nb_key", "root_path", "nb_file", "title", "sharepoint_folder")


def _merged_sources(spark, sf):
    found = A.extracted(spark, sf)
    return N.merge_sources(found.sources.drop("blocks"), found.copies)


@query(
    "merge_sources",
    f"""WITH {Q.SOURCES} SELECT nb_key, title, source_type, source_url, word_count, copy_path, file,
    owner_email, notebook_title, from_later_copy, relative_sharepoint_path FROM sources""",
)
def merge_sources(spark, sf):
    return _merged_sources(spark, sf).select(
        "nb_key", "title", "source_type", "source_url", "word_count", "copy_path", "file",
        "owner_email", "notebook_title", "from_later_copy", "relative_sharepoint_path",
    )


@query(
    "merge_new_titles",
    f"WITH {Q.SOURCES} SELECT nb_key, title, copy_path FROM sources WHERE from_later_copy",
)
def merge_new_titles(spark, sf):
    found = A.extracted(spark, sf)
    return N.merge_new_titles(found.sources.drop("blocks"), found.copies).select(
        "nb_key", "title", "copy_path"
    )


@query(
    "number_sources",
    f"WITH {Q.SOURCES} SELECT nb_key, title, position FROM sources",
)
def number_sources(spark, sf):
    return number_rows(
        _merged_sources(spark, sf), ["nb_key"], ["copy_path", "copy_file", "file"]
    ).select("nb_key", "title", "position")


@query(
    "path_collisions",
    f"""WITH {Q.DOCS} SELECT owner AS nb_key, owner || '/' || {Q.sanitize('source')} || '.docx' AS relative_sharepoint_path, count(*) AS n
    FROM docs GROUP BY 1, 2 HAVING count(*) > 1""",
)
def path_collisions(spark, sf):
    staged = A.docs(spark, sf).select(
        F.col("owner").alias("nb_key"),
        T.join_path(
            F.col("owner"), F.concat(T.sanitize_filename(F.col("source")), F.lit(".docx"))
        ).alias("relative_sharepoint_path"),
    )
    return N.path_collisions(staged)


@query(
    "first_copy_children",
    f"""WITH {Q.CHILDREN}
    SELECT nb_key, 'note' AS kind, position, title, content_text AS detail FROM notes
    UNION ALL SELECT nb_key, 'artifact', position, title, artifact_type FROM artifacts""",
)
def first_copy_children(spark, sf):
    m = merge(A.extracted(spark, sf))
    notes = m.notes.select(
        "nb_key", F.lit("note").alias("kind"), "position", "title",
        F.col("content_text").alias("detail"),
    )
    artifacts = m.artifacts.select(
        "nb_key", F.lit("artifact").alias("kind"), "position", "title",
        F.col("artifact_type").alias("detail"),
    )
    return notes.unionByName(artifacts)
