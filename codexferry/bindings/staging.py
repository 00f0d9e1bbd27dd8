"""Manifest outputs and fan-out."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codexferry import constants as C
from codexferry.bindings import adapters as A
from codexferry.bindings import sqltext as Q
from codexferry.bindings.registry import query
from codexferry.functions import text as T
from codexferry.operators import fanout as X
from codexferry.operators import identity as I
from codexferry.operators import notebooks as N
from codexferry.operators import summary as S
from codexferry.operators.ordering import nest_chunks, number_rows
from codexferry.plans import manifest as M
from codexferry.sinks import writers as K
from codexferry.sources.archives import unzip
from codexferry.storage import shared_dir

STAGE = A.STAGE_ROOT
BOOK_ORDER = ["root_path", "nb_file"]


def mapped_manifest(spark, sf):
    return M.map_owners(A.manifest(spark, sf), A.identity(spark, sf), STAGE)


MAPPED = f"{Q.CHILDREN}, {Q.IDENTITY}, {Q.mapped()}"


@query(
    "nest_children",
    f"""WITH {Q.SOURCES}
    SELECT nb_key, ((position - 1) // 3)::INTEGER AS chunk,
           string_agg(title || ' ' || source_type || ' ' || source_url, '|' ORDER BY position) AS items
    FROM sources GROUP BY 1, 2""",
)
def nest_children(spark, sf):
    """Sources per notebook, at most three per row here."""
    sources = A.manifest(spark, sf).sources
    nested = S.nest_children(sources, ["title", "source_type", "source_url"], "items", size=3)
    line = F.transform(
        "items", lambda x: F.concat_ws(" ", x["title"], x["source_type"], x["source_url"])
    )
    return nested.select("nb_key", "chunk", F.array_join(line, "|").alias("items"))


@query(
    "attach_children",
    f"""WITH {MAPPED}
    SELECT m.nb_key, 0 AS chunk, m.owner_email, m.m365_upn, m.title, m.emoji,
      coalesce((SELECT string_agg(s.title || '=' || s.word_count::VARCHAR, '|' ORDER BY position) FROM sources s WHERE s.nb_key = m.nb_key), '') AS sources,
      coalesce((SELECT string_agg(n.title || '=' || n.content_text, '|' ORDER BY position) FROM notes n WHERE n.nb_key = m.nb_key), '') AS notes,
      coalesce((SELECT string_agg(a.title || '=' || a.artifact_type, '|' ORDER BY position) FROM artifacts a WHERE a.nb_key = m.nb_key), '') AS artifacts
    FROM (SELECT *, '📓' AS emoji FROM mapped) m""",
)
def attach_children(spark, sf):
    nested = mapped_manifest(spark, sf).nested()

    def lines(name, *fields):
        return F.array_join(
            F.transform(name, lambda x: F.concat_ws("=", *[x[f].cast("string") for f in fields])), "|"
        ).alias(name)

    return nested.select(
        "nb_key", "chunk", "owner_email", "m365_upn", "title", "emoji",
        lines("sources", "title", "word_count"),
        lines("notes", "title", "content_text"),
        lines("artifacts", "title", "artifact_type"),
    )


INDEX = f"""numbers AS (SELECT nb_key, count(*) AS n FROM sources GROUP BY 1),
lines AS (
  SELECT m.nb_key, m.sharepoint_folder, unnest(range(11)) AS line_no, unnest([
    '# 📓 ' || m.title, '', '{C.INDEX_OWNER}' || m.owner_email || '`',
    '{C.INDEX_LIBRARY_OWNER}' || m.m365_upn || '`',
    '{C.INDEX_TARGET_USER}' || m.ge_target_email || '`',
    '{C.INDEX_TOTAL}' || coalesce(n, 0)::VARCHAR, '', '{C.INDEX_SECTION}', '',
    '{C.INDEX_HEADER}', '{C.INDEX_RULE}']) AS line
  FROM mapped m LEFT JOIN numbers USING (nb_key)
  UNION ALL
  SELECT nb_key, owner_email || '/' || folder, position + 10,
    '| ' || position::VARCHAR || ' | ' || title || ' | `' || source_type || '` | '
    || CASE WHEN source_url <> '' THEN '[' || source_url || '](' || source_url || ')' ELSE '_Uploaded File_' END
    || ' | `Sources/' || regexp_extract(relative_sharepoint_path, '[^/]*$') || '` |' FROM sources)"""


@query(
    "index_lines",
    f"WITH {MAPPED}, {INDEX} SELECT nb_key, sharepoint_folder, line_no, line FROM lines",
)
def index_lines(spark, sf):
    m = mapped_manifest(spark, sf)
    return S.index_lines(m.notebooks, m.sources)


TRANSFER = f"""transfer AS (
  SELECT '{STAGE}/' || sharepoint_folder AS "SourcePath", '{C.TRANSFER_LIBRARY}' AS "TargetDocumentLibrary",
    '{C.TRANSFER_ROOT}/' || folder AS "TargetSubFolder", sharepoint_site_url AS "TargetWebUrl",
    owner_email AS "GWS_Owner_Email", m365_upn AS "M365_SharePoint_UPN", ge_target_email AS "GE_Target_Email"
  FROM mapped)"""


@query(
    "transfer_manifest",
    f"WITH {Q.BOOKS}, {Q.IDENTITY}, {Q.mapped()}, {TRANSFER} SELECT * FROM transfer",
)
def transfer_manifest(spark, sf):
    return S.transfer_manifest(I.map_identity(A.books(spark, sf), A.identity(spark, sf)), STAGE)


LISTING = f"""listing AS (
  SELECT relative_sharepoint_path AS path FROM sources UNION SELECT relative_sharepoint_path FROM notes
  UNION SELECT sharepoint_folder || '/{C.INDEX_FILE}' FROM mapped)"""


@query(
    "package_entries",
    f"""WITH {MAPPED}, {LISTING}, owners AS (SELECT count(DISTINCT owner_email) AS n FROM books)
    SELECT 0 AS part, '{C.TRANSFER_FILE}' AS arcname, '{C.TRANSFER_FILE}' AS path
    UNION ALL SELECT 1, '{C.SCRIPT_FILE}', '{C.SCRIPT_FILE}'
    UNION ALL SELECT 2, CASE WHEN n <= 1 THEN regexp_replace(path, '^[^/]*/', '') ELSE path END, path
    FROM listing, owners""",
)
def package_entries(spark, sf):
    m = mapped_manifest(spark, sf)
    return S.package_entries(M.staged_listing(m), m.notebooks)


@query(
    "package_entries_single",
    f"""WITH {Q.DOCS}, files AS (SELECT DISTINCT 'solo@old.example/' || book_title || '/Sources/' || base || doc_id::VARCHAR || '.docx' AS path FROM docs)
    SELECT 0 AS part, '{C.TRANSFER_FILE}' AS arcname, '{C.TRANSFER_FILE}' AS path
    UNION ALL SELECT 1, '{C.SCRIPT_FILE}', '{C.SCRIPT_FILE}'
    UNION ALL SELECT 2, substr(path, length('solo@old.example/') + 1), path FROM files""",
)
def package_entries_single(spark, sf):
    """All documents as the staged files of one owner: the owner's folder is left out."""
    parts = F.concat(
        F.lit("solo@old.example/"), "book_title", F.lit("/Sources/"), "base",
        F.col("doc_id").cast("string"), F.lit(".docx"),
    )
    files = A.docs(spark, sf).select(parts.alias("path")).distinct()
    return S.package_entries(files, files.select(F.lit("solo@old.example").alias("owner_email")))


@query(
    "staging_copies",
    f"""WITH {Q.IDENTITY},
    book AS (SELECT DISTINCT source AS title, {Q.sanitize('source')} AS folder FROM documents),
    file AS (
      SELECT folder, '/Sources/' || lang || (doc_id % 7)::VARCHAR || '.docx' AS path FROM documents JOIN book ON title = source
      UNION SELECT folder, '/Notes/n' || (doc_id % 3)::VARCHAR || '.docx' FROM documents JOIN book ON title = source
      UNION SELECT folder, '/{C.INDEX_FILE}' FROM book)
    SELECT 'template@old.example/' || folder || path AS copied_from, i.gws_email || '/' || folder || path AS path
    FROM file CROSS JOIN identity i""",
)
def staging_copies(spark, sf):
    """The whole folder of each template notebook for each user: sources, notes and index."""
    books = _template(spark, sf)
    owner, folder = F.lit("template@old.example"), T.sanitize_filename(F.col("source"))
    docs = A.table(spark, sf, "documents").select("source", "lang", "doc_id")

    def children(kind, name):
        file = F.concat(name, F.lit(".docx"))
        return docs.select(
            owner.alias("owner_email"),
            N.notebook_key(owner, folder).alias("nb_key"),
            F.col("source").alias("notebook_title"),
            file.alias("file"),
            T.join_path(owner, folder, F.lit(kind), file).alias("relative_sharepoint_path"),
        ).distinct()

    sources = children("Sources", F.concat("lang", (F.col("doc_id") % 7).cast("string")))
    notes = children("Notes", F.concat(F.lit("n"), (F.col("doc_id") % 3).cast("string")))
    manifest = M.Manifest(books, sources, notes, notes.limit(0))
    return M.staging_copies(manifest, A.identity(spark, sf))


COUNTS = """counts AS (
  SELECT m.owner_email AS gws_email, min(m.m365_upn) AS m365_upn, min(m.ge_target_email) AS ge_target_email,
    min(m.sharepoint_site_url) AS sharepoint_site_url, count(*) AS notebook_count,
    string_agg(m.title, '|' ORDER BY m.root_path, m.nb_file) AS notebooks
  FROM mapped m GROUP BY 1),
totals AS (
  SELECT owner_email AS gws_email, count(*) AS source_count,
    count(*) FILTER (WHERE source_url <> '') AS url_count FROM sources GROUP BY 1)"""


@query(
    "user_summary",
    f"""WITH {MAPPED}, {COUNTS}
    SELECT gws_email, m365_upn, ge_target_email, sharepoint_site_url, notebook_count,
      coalesce(source_count, 0) AS source_count, coalesce(url_count, 0) AS url_count, 0 AS chunk, notebooks
    FROM counts LEFT JOIN totals USING (gws_email)""",
)
def user_summary(spark, sf):
    m = mapped_manifest(spark, sf)
    return S.user_summary(m.notebooks, m.sources).withColumn(
        "notebooks", F.array_join("notebooks", "|")
    )


@query(
    "manifest_totals",
    f"""WITH {Q.CHILDREN}
    SELECT greatest((SELECT count(DISTINCT owner_email) FROM books), 1) AS user_count,
      (SELECT count(*) FROM books) AS notebook_count, (SELECT count(*) FROM sources) AS total_sources,
      (SELECT count(*) FROM sources WHERE source_url <> '') AS total_urls_recovered,
      (SELECT count(*) FROM notes) AS total_notes, (SELECT count(*) FROM artifacts) AS total_artifacts, 0::BIGINT AS total_errors""",
)
def manifest_totals(spark, sf):
    return A.manifest(spark, sf).totals()


@query("distinct_users", f"WITH {Q.DOCS} SELECT DISTINCT owner AS owner_email FROM docs")
def distinct_users(spark, sf):
    return S.distinct_users(A.copies(spark, sf))


@query(
    "preview_notebooks",
    f"""WITH {Q.BOOKS} SELECT nb_key, title, root_path, (SELECT count(*) FROM books) AS notebook_total
    FROM books ORDER BY root_path, nb_file LIMIT {C.PREVIEW_LIMIT}""",
)
def preview_notebooks(spark, sf):
    return S.preview_notebooks(A.books(spark, sf), BOOK_ORDER).select(
        "nb_key", "title", "root_path", "notebook_total"
    )


# The documents as notebooks of one template owner.
TEMPLATE = f"""template AS (
  SELECT 'template@old.example' AS owner_email, source AS title, {Q.sanitize('source')} AS folder,
    source || '.docx' AS file FROM (SELECT DISTINCT source FROM documents))"""


def _template(spark, sf):
    owner = F.lit("template@old.example")
    folder = T.sanitize_filename(F.col("source"))
    return A.table(spark, sf, "documents").select("source").distinct().select(
        owner.alias("owner_email"),
        owner.alias("m365_upn"),
        owner.alias("ge_target_email"),
        F.lit("").alias("sharepoint_site_url"),
        F.col("source").alias("title"),
        N.sharepoint_folder(owner, folder).alias("sharepoint_folder"),
        N.notebook_key(owner, folder).alias("nb_key"),
    )


@query(
    "fan_out_template",
    f"""WITH {TEMPLATE}, {Q.IDENTITY}
    SELECT i.gws_email AS owner_email, i.m365_upn, i.ge_target_email, i.sharepoint_site_url, t.title,
      i.gws_email || '/' || t.folder AS sharepoint_folder, i.gws_email || '::' || lower(t.folder) AS nb_key
    FROM template t CROSS JOIN identity i""",
)
def fan_out_template(spark, sf):
    return X.fan_out_template(_template(spark, sf), A.identity(spark, sf))


@query(
    "fan_out_unchanged",
    f"""WITH {Q.BOOKS}, {Q.IDENTITY}, {Q.mapped()} SELECT owner_email, nb_key, m365_upn, title FROM mapped""",
)
def fan_out_unchanged(spark, sf):
    """Several owners: the notebooks stay as they are."""
    mapped = I.map_identity(A.books(spark, sf), A.identity(spark, sf))
    return X.fan_out_template(mapped, A.identity(spark, sf)).select(
        "owner_email", "nb_key", "m365_upn", "title"
    )


@query(
    "fan_out_files",
    f"""WITH {TEMPLATE}, {Q.IDENTITY}
    SELECT i.gws_email AS owner_email, i.gws_email || '::' || lower(t.folder) AS nb_key,
      'template@old.example/' || t.folder || '/Sources/' || t.file AS copied_from,
      i.gws_email || '/' || t.folder || '/Sources/' || t.file AS relative_sharepoint_path
    FROM template t CROSS JOIN identity i""",
)
def fan_out_files(spark, sf):
    notebooks = _template(spark, sf)
    files = notebooks.select(
        "owner_email",
        "nb_key",
        F.col("title").alias("notebook_title"),
        F.concat("title", F.lit(".docx")).alias("file"),
        F.concat("sharepoint_folder", F.lit("/Sources/"), "title", F.lit(".docx")).alias(
            "relative_sharepoint_path"
        ),
    )
    identity = A.identity(spark, sf)
    template = X.is_template(notebooks, identity)
    return X.fan_out_files(files, identity, template, "Sources").select(
        "owner_email", "nb_key", "copied_from", "relative_sharepoint_path"
    )


STAGED = f"""staged AS (
      SELECT owner_email || '/' || folder || '/Sources/' || {Q.sanitize('title')} || '.docx' AS path,
        2 + (source_url <> '')::INTEGER + (youtube_channel <> '')::INTEGER
          + CASE WHEN pageless THEN 0 WHEN {Q.strip('text')} = '' THEN 1 ELSE 2 END AS n, root_path, nb_file
      FROM in_copies
      UNION ALL
      SELECT c.owner_email || '/' || c.folder || '/Notes/Note ' || r.doc_id::VARCHAR || '.docx',
        2 + CASE WHEN {Q.strip('r.text')} = '' THEN 1 ELSE 2 END, r.root_path, c.nb_file
      FROM rooted r JOIN copies c USING (root_path) WHERE r.lang = 'de')"""


@query(
    "write_documents",
    f"""WITH {Q.SOURCES}, {STAGED}
    SELECT path, n::INTEGER AS n_paragraphs FROM (
      SELECT *, row_number() OVER (PARTITION BY path ORDER BY root_path DESC, nb_file DESC) AS rk FROM staged)
    WHERE rk = 1""",
)
def write_documents(spark, sf):
    """Word documents of sources and notes, the last copy of each path, written and read back."""
    uri = f"{shared_dir(spark)}/out-{uuid.uuid4().hex}"
    K.write_documents(M.documents(A.extracted(spark, sf)), uri)
    packed = spark.read.parquet(uri).withColumnRenamed("path", "archive")
    parts = unzip(packed.withColumn("dest", F.lit("")), A.DEFAULT_OWNER)
    return parts.where("entry_path = 'word/document.xml'").select(
        F.col("archive").alias("path"),
        F.regexp_count(F.col("content").cast("string"), F.lit("<w:p[ >]")).alias("n_paragraphs"),
    )


@query(
    "staged_paths_complete",
    f"""WITH {MAPPED}, {STAGED}
    SELECT path, path IN (SELECT path FROM staged) AS has_document FROM (
      SELECT relative_sharepoint_path AS path FROM sources UNION SELECT relative_sharepoint_path FROM notes)""",
)
def staged_paths_complete(spark, sf):
    """Every path that the manifest names is the path of a document."""
    found = A.extracted(spark, sf)
    manifest = M.merge(found)
    path = F.col("relative_sharepoint_path").alias("path")
    named = manifest.sources.select(path).unionByName(manifest.notes.select(path)).distinct()
    made = M.document_rows(found).select("path", F.lit(True).alias("made"))
    return named.join(made, "path", "left").select(
        "path", F.coalesce("made", F.lit(False)).alias("has_document")
    )


# Ordered lists of a key that holds a third of all rows.
@query(
    "nest_hot_key",
    """WITH keyed AS (SELECT CASE WHEN l_orderkey % 3 = 0 THEN -1 ELSE l_suppkey END AS k,
      l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS position FROM keyed)
    SELECT k, ((position - 1) // 500)::INTEGER AS chunk, count(*) AS n,
      string_agg(l_orderkey::VARCHAR || ':' || l_linenumber::VARCHAR, ',' ORDER BY position) AS items
    FROM numbered GROUP BY 1, 2""",
)
def nest_hot_key(spark, sf):
    lines = A.table(spark, sf, "lineitem").select(
        F.when(F.col("l_orderkey") % 3 == 0, -1).otherwise(F.col("l_suppkey")).alias("k"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
    )
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    # The bound is low so that the hot key is split at every scale.
    numbered = number_rows(lines, ["k"], order, max_group=1000)
    item = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return nest_chunks(numbered, ["k"], item, size=500).select(
        "k",
        "chunk",
        F.size("items").cast("long").alias("n"),
        F.array_join("items", ",").alias("items"),
    )
