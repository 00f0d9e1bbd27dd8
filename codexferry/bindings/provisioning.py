"""Requests, outcomes, ledger and upload plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexferry import constants as C
from codexferry.bindings import adapters as A
from codexferry.bindings import sqltext as Q
from codexferry.bindings.registry import query
from codexferry.bindings.staging import MAPPED, mapped_manifest
from codexferry.functions import requests as R
from codexferry.operators import provision as P
from codexferry.operators import upload as U
from codexferry.storage import materialize

PROJECT, LOCATION = "123", "eu"
BASE = f"https://{LOCATION}-{C.SERVICE_HOST}"
PARENT = f"projects/{PROJECT}/locations/{LOCATION}"
BOOK_URL = f"{BASE}/v1alpha/{PARENT}/notebooks"


# --- columns -------------------------------------------------------------------


@query(
    "target_email",
    """SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'over@x.example' WHEN c_nationkey % 3 = 1 THEN lower(c_name)
      ELSE c_mktsegment END AS target_email FROM customer""",
)
def target_email(spark, sf):
    n = F.col("c_nationkey") % 3
    return A.table(spark, sf, "customer").select(
        "c_custkey",
        R.target_email(
            F.when(n == 0, " over@x.example ").otherwise(" "),
            F.when(n == 1, F.concat(F.lit("  "), F.lower("c_name"))),
            F.col("c_mktsegment"),
        ).alias("target_email"),
    )


@query(
    "checkpoint_key",
    "SELECT doc_id, CASE WHEN lang = 'en' THEN 'default_user' ELSE source END || '::' || text AS checkpoint_key FROM documents",
)
def checkpoint_key(spark, sf):
    owner = F.when(F.col("lang") != "en", F.col("source"))
    return A.table(spark, sf, "documents").select(
        "doc_id", R.checkpoint_key(owner, F.col("text")).alias("checkpoint_key")
    )


@query(
    "endpoint_parts",
    f"""WITH e AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'global' ELSE lower(c_mktsegment) END AS loc FROM customer),
    f AS (SELECT *, 'https://' || CASE WHEN loc = 'global' THEN '' ELSE loc || '-' END || '{C.SERVICE_HOST}' AS prefix,
      'projects/' || c_custkey::VARCHAR || '/locations/' || loc AS parent FROM e)
    SELECT c_custkey, prefix, parent, prefix || '/v1alpha/' || parent || '/notebooks?serviceAccountUser=true' AS create_url,
      prefix || '/v1alpha/' || parent || '/notebooks/nb' || c_custkey::VARCHAR || '/sources:batchCreate' AS batch_url,
      prefix || '/upload/v1alpha/' || parent || '/notebooks/nb' || c_custkey::VARCHAR || '/sources:uploadFile' AS upload_url,
      prefix || '/v1alpha/' || parent || '/notebooks/nb' || c_custkey::VARCHAR || '/notes' AS notes_url,
      prefix || '/v1alpha/' || parent || '/notebooks:share' AS share_url FROM f""",
)
def endpoint_parts(spark, sf):
    location = F.when(F.col("c_mktsegment") == "BUILDING", "global").otherwise(F.lower("c_mktsegment"))
    key = F.col("c_custkey").cast("string")
    return (
        A.table(spark, sf, "customer")
        .select("c_custkey", R.endpoint_parts(key, location, F.concat(F.lit("nb"), key)).alias("e"))
        .select("c_custkey", "e.*")
    )


STATUS = """CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 429 WHEN 'click' THEN 404
  WHEN 'view' THEN NULL ELSE 200 END"""


def _events(spark, sf):
    kind = F.col("event_type")
    status = (
        F.when(kind == "error", 503)
        .when(kind == "signup", 429)
        .when(kind == "click", 404)
        .when(kind == "view", F.lit(None).cast("int"))
        .otherwise(200)
    )
    return A.table(spark, sf, "events").withColumn("status", status)


@query(
    "retryable",
    f"""SELECT event_id, s IS NULL OR s IN (429, 500, 502, 503, 504) AS retryable
    FROM (SELECT event_id, {STATUS} AS s FROM events)""",
)
def retryable(spark, sf):
    return _events(spark, sf).select("event_id", R.retryable(F.col("status")).alias("retryable"))


@query(
    "http_ok",
    f"""SELECT event_id, coalesce(s IN (200, 201), false) AS http_ok
    FROM (SELECT event_id, {STATUS} AS s FROM events)""",
)
def http_ok(spark, sf):
    return _events(spark, sf).select("event_id", R.http_ok(F.col("status")).alias("http_ok"))


@query(
    "has_target",
    "SELECT doc_id, contains(text, '@') AS has_target, false AS without FROM documents",
)
def has_target(spark, sf):
    return A.table(spark, sf, "documents").select(
        "doc_id",
        R.has_target(F.col("text")).alias("has_target"),
        R.has_target(F.lit(None).cast("string")).alias("without"),
    )


# --- which notebooks -------------------------------------------------------------


@query(
    "select_indices",
    f"""WITH {Q.BOOKS}, numbered AS (SELECT *, row_number() OVER (ORDER BY root_path, nb_file) - 1 AS no FROM books)
    SELECT nb_key, root_path FROM numbered WHERE no IN (SELECT o_custkey FROM orders)""",
)
def select_indices(spark, sf):
    """Positions given as a table: the customers that have orders."""
    wanted = A.table(spark, sf, "orders").select(F.col("o_custkey").alias("index"))
    picked = P.select_indices(A.books(spark, sf), wanted, ["root_path", "nb_file"])
    return picked.select("nb_key", "root_path")


LEDGER = f"""ledger AS (
  SELECT {Q.user('user_id')} || '@old.example::Book ' || (event_id % 5)::VARCHAR || ': é' AS checkpoint_key,
    CASE WHEN event_type = 'purchase' THEN 'completed' ELSE 'failed' END AS status, props AS entry,
    epoch_us(ts) AS version, event_id AS seq FROM events),
latest AS (
  SELECT checkpoint_key, 0 AS chunk, status, entry, version, seq FROM (
    SELECT *, row_number() OVER (PARTITION BY checkpoint_key ORDER BY version DESC, seq DESC) AS rk FROM ledger)
  WHERE rk = 1)"""


def _ledger(spark, sf):
    """events as ledger entries of the documents' notebooks."""
    title = F.concat(F.lit("Book "), (F.col("event_id") % 5).cast("string"), F.lit(": é"))
    owner = F.concat(A.user(F.col("user_id")), F.lit("@old.example"))
    return A.table(spark, sf, "events").select(
        R.checkpoint_key(owner, title).alias("checkpoint_key"),
        F.lit(0).alias("chunk"),
        F.when(F.col("event_type") == "purchase", "completed").otherwise("failed").alias("status"),
        F.col("props").alias("entry"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("version"),
        F.col("event_id").alias("seq"),
    )


@query("ledger_latest", f"WITH {LEDGER} SELECT * FROM latest")
def ledger_latest(spark, sf):
    return P.ledger_latest(_ledger(spark, sf))


KEYED = f"""keyed AS (SELECT *, owner_email || '::' || title AS checkpoint_key FROM books)"""


def _keyed_books(spark, sf):
    return P.with_checkpoint_key(A.books(spark, sf), "title")


@query(
    "skip_completed",
    f"""WITH {Q.BOOKS}, {LEDGER}, {KEYED} SELECT checkpoint_key, nb_key FROM keyed
    WHERE checkpoint_key NOT IN (SELECT checkpoint_key FROM latest WHERE status = 'completed')""",
)
def skip_completed(spark, sf):
    ledger = P.ledger_latest(_ledger(spark, sf))
    return P.skip_completed(_keyed_books(spark, sf), ledger).select("checkpoint_key", "nb_key")


@query(
    "resumed_results",
    f"""WITH {Q.BOOKS}, {LEDGER}, {KEYED} SELECT checkpoint_key, chunk, status, entry, true AS resumed_from_checkpoint
    FROM keyed JOIN latest USING (checkpoint_key) WHERE status = 'completed'""",
)
def resumed_results(spark, sf):
    return P.resumed_results(_keyed_books(spark, sf), P.ledger_latest(_ledger(spark, sf)))


@query(
    "upsert_ledger",
    f"""WITH {LEDGER}, more AS (
      SELECT * FROM ledger UNION ALL
      SELECT checkpoint_key, 'completed', 'again', version + 1, 0 FROM latest WHERE status = 'failed')
    SELECT checkpoint_key, 0 AS chunk, status, entry, version, seq FROM (
      SELECT *, row_number() OVER (PARTITION BY checkpoint_key ORDER BY version DESC, seq DESC) AS rk FROM more)
    WHERE rk = 1""",
)
def upsert_ledger(spark, sf):
    """The failed entries of a ledger completed by a second run."""
    ledger = P.ledger_latest(_ledger(spark, sf))
    again = ledger.where("status = 'failed'").select(
        "checkpoint_key",
        "chunk",
        F.lit("completed").alias("status"),
        F.lit("again").alias("entry"),
        (F.col("version") + 1).alias("version"),
        F.lit(0).cast("long").alias("seq"),
    )
    return P.upsert_ledger(ledger, again)


# --- attempts --------------------------------------------------------------------


@query(
    "retry_outcome",
    f"""WITH attempts AS (
      SELECT user_id, CAST(ts AS DATE)::VARCHAR AS day, {STATUS} AS status,
        row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS no FROM events),
    four AS (SELECT *, status IS NULL OR status IN (429, 500, 502, 503, 504) AS again FROM attempts WHERE no <= 4)
    SELECT user_id, day, coalesce(arg_min(status, no) FILTER (WHERE NOT again),
      arg_max(status, no) FILTER (WHERE status IS NOT NULL)) AS status,
      coalesce(min(no) FILTER (WHERE NOT again), max(no))::INTEGER AS attempts FROM four GROUP BY 1, 2""",
)
def retry_outcome(spark, sf):
    events = _events(spark, sf).withColumn("day", F.to_date("ts").cast("string"))
    return P.retry_outcome(events, ["user_id", "day"], ["ts", "event_id"])


def _json(x: str) -> str:
    """A JSON string as Spark writes it."""
    return f"to_json({x})::VARCHAR"


PLAN = f"""plan AS (
  SELECT owner_email || '::' || title AS checkpoint_key, 'create' AS step, 0 AS step_no, 0::BIGINT AS seq,
    '{BOOK_URL}?serviceAccountUser=true' AS url, '{{"title":' || {_json('title')} || '}}' AS body, title,
    NULL AS link, NULL AS route, NULL AS file_path, NULL AS file_name, NULL AS depends_on FROM mapped
  UNION ALL
  SELECT owner_email || '::' || notebook_title, 'batchCreate', 1, position,
    '{BOOK_URL}/{P.NOTEBOOK_ID}/sources:batchCreate',
    '{{"userContents":[{{' || CASE WHEN youtube_url <> '' THEN '"videoContent":{{"youtubeUrl":' || {_json('youtube_url')}
      ELSE '"webContent":{{"url":' || {_json('source_url')} || ',"sourceName":' || {_json('title')} END || '}}}}]}}',
    title, source_url, CASE WHEN youtube_url <> '' THEN '{C.METHOD_VIDEO}' ELSE '{C.METHOD_WEB}' END, NULL, NULL, NULL
  FROM sources WHERE youtube_url <> '' OR (source_type = '{C.TYPE_URL}' AND source_url <> '')
  UNION ALL
  SELECT owner_email || '::' || notebook_title, 'uploadFile', 2, position,
    '{BASE}/upload/v1alpha/{PARENT}/notebooks/{P.NOTEBOOK_ID}/sources:uploadFile', NULL, title,
    nullif(source_url, ''), '{C.METHOD_FILE}', relative_sharepoint_path, {Q.sanitize('title')} || '.docx',
    CASE WHEN youtube_url <> '' OR (source_type = '{C.TYPE_URL}' AND source_url <> '') THEN 'batchCreate failed' END
  FROM sources
  UNION ALL
  SELECT owner_email || '::' || notebook_title, 'note', 3, position, '{BOOK_URL}/{P.NOTEBOOK_ID}/notes',
    md5(content_text), title, NULL, NULL, NULL, NULL, NULL FROM notes
  UNION ALL
  SELECT owner_email || '::' || title, 'share', 4, 0, '{BOOK_URL}:share',
    '{{"name":"{P.NOTEBOOK_NAME}","accountAndRoles":[{{"email":' || {_json('ge_target_email')}
      || ',"role":"{C.SHARE_ROLE}"}}],"notifyViaEmail":true}}', ge_target_email, NULL, NULL, NULL, NULL, NULL
  FROM mapped WHERE contains(ge_target_email, '@'))"""


def _plan(spark, sf):
    m = mapped_manifest(spark, sf)
    return P.request_plan(m.notebooks, m.sources, m.notes, PROJECT, LOCATION)


@query(
    "request_plan",
    f"""WITH {MAPPED}, {PLAN} SELECT checkpoint_key, step, step_no, seq, url, body, title, link, route, file_path,
    file_name, depends_on FROM plan""",
)
def request_plan(spark, sf):
    # The text of a note is compared by its digest.
    content = F.get_json_object("body", "$.content")
    body = F.when(F.col("step") == "note", F.md5(content)).otherwise(F.col("body"))
    return _plan(spark, sf).withColumn("body", body).drop(
        "method", "file_exists", "owner_email", "target_email"
    )


# Logged attempts: five per request, their answers from a digest of the request.
DIGEST = "md5(checkpoint_key || '/' || step || '/' || seq::VARCHAR)"

OUTCOMES = f"""tried AS (
  SELECT checkpoint_key, step, seq, attempt, substr({DIGEST}, attempt, 1) AS d
  FROM plan, LATERAL (SELECT unnest([1, 2, 3, 4, 5]) AS attempt)),
answered AS (
  SELECT *, CASE WHEN d IN ('0', '1', '2', '3') THEN 503 WHEN d IN ('4', '5') THEN NULL
    WHEN d IN ('6', '7') THEN 404 WHEN d = '8' THEN 201 ELSE 200 END AS status FROM tried),
outcomes AS (
  SELECT checkpoint_key, step, seq,
    coalesce(arg_min(status, attempt) FILTER (WHERE status IN (404, 200, 201)),
      arg_max(status, attempt) FILTER (WHERE status IS NOT NULL)) AS status
  FROM answered WHERE attempt <= 4 GROUP BY 1, 2, 3)"""


def _attempts(plan):
    number = F.explode(F.array(*[F.lit(i) for i in range(1, 6)]))
    digest = F.md5(F.concat_ws("/", "checkpoint_key", "step", F.col("seq").cast("string")))
    tried = plan.select(*P.PLAN_KEYS, digest.alias("digest"), number.alias("attempt"))
    d = F.substring("digest", F.col("attempt"), 1)
    status = (
        F.when(d.isin("0", "1", "2", "3"), 503)
        .when(d.isin("4", "5"), F.lit(None).cast("int"))
        .when(d.isin("6", "7"), 404)
        .when(d == "8", 201)
        .otherwise(200)
    )
    return tried.withColumn("status", status)


RESULTS = f"""results AS (
  SELECT p.*, o.status, CASE WHEN o.status IN (200, 201) THEN 'ok' ELSE 'failed' END AS result
  FROM plan p LEFT JOIN outcomes o USING (checkpoint_key, step, seq)
  WHERE p.step = 'create' OR (
    p.checkpoint_key IN (SELECT checkpoint_key FROM outcomes WHERE step = 'create' AND status IN (200, 201))
    AND NOT (p.step = 'uploadFile' AND p.depends_on IS NOT NULL AND (p.checkpoint_key, p.seq) IN (
      SELECT (checkpoint_key, seq) FROM outcomes WHERE step = 'batchCreate' AND status IN (200, 201)))))"""


def _results(spark, sf):
    plan = _plan(spark, sf)
    outcomes = materialize(P.retry_outcome(_attempts(plan), P.PLAN_KEYS, ["attempt"]))
    return P.apply_outcomes(plan, outcomes)


@query(
    "apply_outcomes",
    f"""WITH {MAPPED}, {PLAN}, {OUTCOMES}, {RESULTS}
    SELECT checkpoint_key, step, seq, status, result FROM results""",
)
def apply_outcomes(spark, sf):
    return _results(spark, sf).select("checkpoint_key", "step", "seq", "status", "result")


LOG = """log AS (
  SELECT checkpoint_key,
    max(CASE WHEN step = 'create' AND result = 'failed' THEN 'CreateNotebook HTTP ' || coalesce(status::VARCHAR, 'ERR') || ': No response' END) AS error,
    coalesce(string_agg(title || '>' || route || '>' || coalesce(link, ''), '|' ORDER BY seq)
      FILTER (WHERE step IN ('batchCreate', 'uploadFile') AND result = 'ok'), '') AS sources_uploaded,
    coalesce(string_agg(title || '>HTTP ' || coalesce(status::VARCHAR, 'ERR') || ': ', '|' ORDER BY seq)
      FILTER (WHERE step = 'uploadFile' AND result = 'failed'), '') AS sources_failed,
    coalesce(string_agg(title, '|' ORDER BY seq) FILTER (WHERE step = 'note' AND result = 'ok'), '') AS notes_created,
    max(CASE WHEN step = 'share' AND result = 'ok' THEN title END) AS shared_with,
    CASE WHEN max(CASE WHEN step = 'create' THEN result END) = 'failed' THEN 'failed' ELSE 'completed' END AS status
  FROM results GROUP BY 1),
who AS (SELECT owner_email || '::' || title AS checkpoint_key, owner_email, ge_target_email, title FROM mapped)"""


@query(
    "provision_log",
    f"""WITH {MAPPED}, {PLAN}, {OUTCOMES}, {RESULTS}, {LOG}
    SELECT log.*, owner_email, ge_target_email, title, 0 AS chunk,
      status = 'failed' OR sources_failed <> '' AS has_failures FROM log JOIN who USING (checkpoint_key)""",
)
def provision_log(spark, sf):
    log = P.provision_log(_results(spark, sf))

    def lines(name, *fields):
        item = lambda x: F.concat_ws(">", *[F.coalesce(x[f], F.lit("")) for f in fields])
        return F.array_join(F.transform(name, item), "|").alias(name)

    return log.select(
        "checkpoint_key", "chunk", "owner_email", "ge_target_email", "title", "error", "status",
        "shared_with", "has_failures",
        lines("sources_uploaded", "title", "method", "url"),
        lines("sources_failed", "title", "error"),
        F.array_join("notes_created", "|").alias("notes_created"),
    )


@query(
    "run_summary",
    f"""WITH {MAPPED}, {LEDGER}, {PLAN}, {OUTCOMES},
    done AS (SELECT checkpoint_key FROM mapped m JOIN latest l ON l.checkpoint_key = m.owner_email || '::' || m.title
      WHERE status = 'completed'),
    rows AS (
      SELECT CASE WHEN status IN (200, 201) THEN 'completed' ELSE 'failed' END AS status FROM outcomes
      WHERE step = 'create' AND checkpoint_key NOT IN (SELECT checkpoint_key FROM done)
      UNION ALL SELECT 'completed' FROM done)
    SELECT CASE WHEN count(*) = count(*) FILTER (WHERE status = 'completed') THEN 'success' ELSE 'partial_success' END AS status,
      true AS resume_checkpoint_enabled, count(*) AS total_processed,
      count(*) FILTER (WHERE status = 'completed') AS completed_count,
      count(*) FILTER (WHERE status <> 'completed') AS failed_count FROM rows""",
)
def run_summary(spark, sf):
    """A whole run: skip what the ledger holds, plan, apply the answers, count."""
    from codexferry.plans.provision import close_run, plan_requests

    m = mapped_manifest(spark, sf)
    ledger = P.ledger_latest(_ledger(spark, sf))
    plan = plan_requests(m, ledger, PROJECT, LOCATION)
    return close_run(m, plan, _attempts(plan), ledger, version=1 << 60).summary


# --- upload ----------------------------------------------------------------------


@query(
    "remote_path",
    f"""SELECT doc_id, replace(replace(url_encode('u@x.example/' || source || '/' || lang || '/' || text || '.docx'), '%2F', '/'), '+', '%20') AS path,
    '{C.TRANSFER_LIBRARY}/' || source || '/' || lang AS folder FROM documents""",
)
def remote_path(spark, sf):
    """Whole texts as file names: every character is encoded."""
    name = F.concat("text", F.lit(".docx"))
    return A.table(spark, sf, "documents").select(
        "doc_id",
        U.remote_path(F.lit("/u@x.example"), F.col("source"), F.col("lang"), name).alias("path"),
        U.library_folder(
            F.lit(C.TRANSFER_LIBRARY), F.col("source"), F.concat("lang", F.lit("/"))
        ).alias("folder"),
    )


@query(
    "upload_plan",
    f"""WITH transfer AS (
      SELECT '/stage/o' || o_custkey::VARCHAR || '/n' || o_orderkey::VARCHAR AS folder, {Q.user('o_custkey')} || '@new.example' AS upn,
        'Moved/n ' || o_orderkey::VARCHAR AS sub, 'https://site/' || o_custkey::VARCHAR AS web FROM orders),
    files AS (
      SELECT '/stage/o' || o_custkey::VARCHAR || '/n' || l_orderkey::VARCHAR AS folder,
        CASE WHEN l_linenumber = 1 THEN '' ELSE 'Sources' END AS rel_dir,
        l_linenumber::VARCHAR || '_' || l_partkey::VARCHAR || ' é.docx' AS file
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT folder, rel_dir, file, web AS "TargetWebUrl",
      upn || '/' || sub || CASE WHEN rel_dir = '' THEN '' ELSE '/' || rel_dir END AS remote_dir,
      '{C.DRIVE_URL_PREFIX}d1/root:/' || replace(replace(url_encode(upn || '/' || sub || CASE WHEN rel_dir = '' THEN '' ELSE '/' || rel_dir END || '/' || file), '%2F', '/'), '+', '%20') || ':/content' AS put_url,
      '{C.TRANSFER_LIBRARY}/' || sub || CASE WHEN rel_dir = '' THEN '' ELSE '/' || rel_dir END AS library_folder,
      left(file, length(file) - 5) AS item_title
    FROM transfer JOIN files USING (folder)""",
)
def upload_plan(spark, sf):
    """orders as folders, lineitem as their files; an order without lines drops out."""
    orders = A.table(spark, sf, "orders")
    owner = F.concat(F.lit("o"), F.col("o_custkey").cast("string"))
    none = F.lit("")
    transfer = orders.select(
        F.concat(F.lit("/stage/"), owner, F.lit("/n"), F.col("o_orderkey").cast("string")).alias(
            "SourcePath"
        ),
        F.lit(C.TRANSFER_LIBRARY).alias("TargetDocumentLibrary"),
        F.concat(F.lit("Moved/n "), F.col("o_orderkey").cast("string")).alias("TargetSubFolder"),
        F.concat(F.lit("https://site/"), F.col("o_custkey").cast("string")).alias("TargetWebUrl"),
        none.alias("GWS_Owner_Email"),
        F.concat(A.user(F.col("o_custkey")), F.lit("@new.example")).alias("M365_SharePoint_UPN"),
        none.alias("GE_Target_Email"),
    )
    number = F.col("l_linenumber").cast("string")
    lines = A.table(spark, sf, "lineitem").join(
        orders, F.col("l_orderkey") == F.col("o_orderkey")
    )
    files = lines.select(
        F.concat(
            owner, F.lit("/n"), F.col("l_orderkey").cast("string"),
            F.when(F.col("l_linenumber") == 1, "/").otherwise("/Sources/"),
            number, F.lit("_"), F.col("l_partkey").cast("string"), F.lit(" é.docx"),
        ).alias("rel_path")
    )
    return U.upload_plan(transfer, U.staged_files(files, A.STAGE_ROOT), "d1")
