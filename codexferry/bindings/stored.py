"""Writers and readers: each query writes to the shared folder and reads back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codexferry import constants as C
from codexferry.bindings import adapters as A
from codexferry.bindings import sqltext as Q
from codexferry.bindings.columns import _styled, _xml_sql
from codexferry.bindings.provisioning import LEDGER, _ledger
from codexferry.bindings.registry import query
from codexferry.bindings.staging import INDEX, MAPPED, TRANSFER, mapped_manifest
from codexferry.functions import documents as D
from codexferry.operators import identity as I
from codexferry.operators import provision as P
from codexferry.operators import summary as S
from codexferry.operators.docx import render_docx
from codexferry.sinks import writers as K
from codexferry.sources import tables as R
from codexferry.sources.archives import unzip
from codexferry.storage import shared_dir


def _new_uri(spark) -> str:
    return f"{shared_dir(spark)}/out-{uuid.uuid4().hex}"


@query("read_identity_map", f"WITH {Q.IDENTITY} SELECT * FROM identity")
def read_identity_map(spark, sf):
    """Identity rows as several CSV files and back: the last row of an address wins."""
    uri = _new_uri(spark)
    raw = A.raw_identity(spark, sf).repartitionByRange(4, "line_no").sortWithinPartitions("line_no")
    raw.drop("line_no").write.option("header", True).option("emptyValue", "").csv(uri)
    return I.identity_map(R.read_identity_map(spark, uri))


@query(
    "read_transfer_manifest",
    f"WITH {Q.BOOKS}, {Q.IDENTITY}, {Q.mapped()}, {TRANSFER} SELECT * FROM transfer",
)
def read_transfer_manifest(spark, sf):
    """The transfer list as CSV files and back."""
    uri = _new_uri(spark)
    mapped = I.map_identity(A.books(spark, sf), A.identity(spark, sf))
    K.write_transfer_manifest(S.transfer_manifest(mapped, A.STAGE_ROOT), uri)
    return R.read_transfer_manifest(spark, uri)


@query(
    "read_manifest",
    f"""WITH {MAPPED}
    SELECT nb_key, position, title, word_count, source_url, '{A.STAGE_ROOT}/' || relative_sharepoint_path AS docx_path
    FROM sources""",
)
def read_manifest(spark, sf):
    """The manifest as tables and back: its sources."""
    uri = _new_uri(spark)
    m = mapped_manifest(spark, sf)
    K.write_manifest(m.tables(), m.totals(), uri)
    return R.read_manifest(spark, uri)["sources"].select(
        "nb_key", "position", "title", "word_count", "source_url", "docx_path"
    )


@query(
    "read_manifest_json",
    f"""WITH {MAPPED} SELECT m.nb_key, m.owner_email, m.sharepoint_site_url, m.title,
    (SELECT count(*) FROM sources s WHERE s.nb_key = m.nb_key) AS n_sources,
    (SELECT count(*) FROM notes n WHERE n.nb_key = m.nb_key) AS n_notes FROM mapped m""",
)
def read_manifest_json(spark, sf):
    """Nested notebooks as JSON lines and back."""
    uri = _new_uri(spark)
    K.write_nested_manifest(mapped_manifest(spark, sf).nested(), uri)
    return R.read_manifest_json(spark, uri).select(
        "nb_key",
        "owner_email",
        "sharepoint_site_url",
        "title",
        F.size("sources").cast("long").alias("n_sources"),
        F.size("notes").cast("long").alias("n_notes"),
    )


@query(
    "write_index",
    f"""WITH {MAPPED}, {INDEX}
    SELECT sharepoint_folder || '/{C.INDEX_FILE}' AS path, 0 AS part,
      string_agg(line, chr(10) ORDER BY line_no) || chr(10) AS content FROM lines GROUP BY sharepoint_folder""",
)
def write_index(spark, sf):
    """Indexes as a table and back."""
    uri = _new_uri(spark)
    m = mapped_manifest(spark, sf)
    K.write_index(S.index_files(S.index_lines(m.notebooks, m.sources)), uri)
    return spark.read.parquet(uri)


@query(
    "list_staged_files",
    """SELECT c_mktsegment AS folder, sum(length(c_name || chr(10)))::BIGINT AS n_bytes FROM customer GROUP BY 1""",
)
def list_staged_files(spark, sf):
    """Sizes of staged text files per folder; no file is opened for it."""
    uri = _new_uri(spark)
    customer = A.table(spark, sf, "customer").select("c_mktsegment", F.col("c_name").alias("value"))
    customer.write.partitionBy("c_mktsegment").text(uri)
    files = R.list_staged_files(spark, uri)
    folder = F.regexp_extract("rel_path", "^c_mktsegment=([^/]*)/", 1)
    return files.groupBy(folder.alias("folder")).agg(F.sum("length").alias("n_bytes"))


@query(
    "read_documents",
    f"""{_xml_sql()} SELECT doc_id, md5(xml) AS xml_md5 FROM joined""",
)
def read_documents(spark, sf):
    """Word documents as a table and back: the digest of their text part."""
    uri = _new_uri(spark)
    xml = D.document_xml(F.col("paragraphs")).alias("document_xml")
    K.write_documents(
        render_docx(_styled(spark, sf).select(F.col("doc_id").cast("string").alias("path"), xml)), uri
    )
    packed = spark.read.parquet(uri).withColumnRenamed("path", "archive")
    parts = unzip(packed.withColumn("dest", F.lit("")), A.DEFAULT_OWNER)
    return parts.where("entry_path = 'word/document.xml'").select(
        F.col("archive").cast("long").alias("doc_id"), F.md5("content").alias("xml_md5")
    )


@query("read_ledger", f"WITH {LEDGER} SELECT * FROM latest")
def read_ledger(spark, sf):
    """A ledger saved in two versions and read at the newest."""
    uri = _new_uri(spark)
    ledger = _ledger(spark, sf)
    odd = F.col("seq") % 2 == 1
    K.save_entries(ledger.where(~odd), uri, 1)
    K.save_entries(ledger.where(odd), uri, 2)
    return R.read_ledger(spark, uri)


@query("clear_ledger", f"WITH {LEDGER} SELECT count(*) AS before, 0::BIGINT AS after FROM latest")
def clear_ledger(spark, sf):
    uri = _new_uri(spark)
    K.save_entries(_ledger(spark, sf), uri, 1)
    before = R.read_ledger(spark, uri).agg(F.count(F.lit(1)).alias("n")).first()["n"]
    K.clear_ledger(spark, uri, 2)
    return R.read_ledger(spark, uri).agg(
        F.lit(before).cast("long").alias("before"), F.count(F.lit(1)).alias("after")
    )
