"""Provisioning: which requests to send, what their answers mean, what is done."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codexferry import constants as C
from codexferry.functions import requests as R
from codexferry.functions import text as T
from codexferry.operators.ordering import CHUNK_ITEMS, number_rows

NOTEBOOK_ID = "{notebook_id}"
NOTEBOOK_NAME = "{notebook_name}"
PLAN_KEYS = ["checkpoint_key", "step", "seq"]
LEDGER_COLUMNS = ["checkpoint_key", "chunk", "status", "entry", "version", "seq"]


# --- which notebooks ---------------------------------------------------------


def select_indices(
    notebooks: DataFrame, indices: Sequence[int] | DataFrame | None, order: Sequence[str]
) -> DataFrame:
    """Notebooks at 0-based positions in the given order; None keeps all.

    Positions come from a distributed count, not from a single-task window.
    ``indices`` may be a DataFrame with the column ``index`` when they are many.
    """
    if indices is None:
        return notebooks
    numbered = number_rows(notebooks, [], order, "_no").withColumn("index", F.col("_no") - 1)
    if isinstance(indices, DataFrame):
        picked = numbered.join(indices.select(F.col("index").cast("long")), "index", "left_semi")
    else:
        picked = numbered.where(F.col("index").isin([int(i) for i in indices]))
    return picked.drop("_no", "index")


def with_checkpoint_key(df: DataFrame, title: str) -> DataFrame:
    return df.withColumn("checkpoint_key", R.checkpoint_key(F.col("owner_email"), F.col(title)))


def completed_entries(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("status") == "completed")


def skip_completed(df: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows whose ledger entry is not ``completed``; run it before planning requests."""
    done = completed_entries(ledger).where("chunk = 0").select("checkpoint_key")
    return df.join(done, "checkpoint_key", "left_anti")


def resumed_results(df: DataFrame, ledger: DataFrame) -> DataFrame:
    """The stored entries of the skipped notebooks, all chunks of each."""
    entries = completed_entries(ledger).select("checkpoint_key", "chunk", "status", "entry")
    return (
        df.select("checkpoint_key")
        .join(entries, "checkpoint_key")
        .withColumn("resumed_from_checkpoint", F.lit(True))
    )


# --- requests ----------------------------------------------------------------


def _plan_rows(
    df: DataFrame, step: str, step_no: int, seq: Column, url: Column, body: Column, **extra: Column
) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        "checkpoint_key",
        F.lit(step).alias("step"),
        F.lit(step_no).alias("step_no"),
        seq.cast("long").alias("seq"),
        F.lit("POST").alias("method"),
        url.alias("url"),
        body.alias("body"),
        extra.get("title", none).alias("title"),
        extra.get("link", none).alias("link"),
        extra.get("route", none).alias("route"),
        extra.get("file_path", none).alias("file_path"),
        extra.get("file_name", none).alias("file_name"),
        extra.get("depends_on", none).alias("depends_on"),
        extra.get("file_exists", F.lit(None).cast("boolean")).alias("file_exists"),
        # Only the create row has them: whose notebook it is, and whom it is for.
        extra.get("owner_email", none).alias("owner_email"),
        extra.get("target_email", none).alias("target_email"),
    )


def request_plan(
    notebooks: DataFrame,
    sources: DataFrame,
    notes: DataFrame,
    project: str,
    location: str = "global",
    override_target: str = "",
    native_urls: bool = True,
) -> DataFrame:
    """All requests, one per row: create, link or upload sources, notes, share.

    Children carry ``owner_email``, ``notebook_title`` and ``position``, so no join
    is needed. An upload of a source that can be linked is a fallback and says so in
    ``depends_on``. The notebook's id and name are placeholders until it exists.
    """
    at = R.endpoint_parts(F.lit(project), F.lit(location), F.lit(NOTEBOOK_ID))
    title = F.col("title")
    books = with_checkpoint_key(notebooks, "title").withColumn(
        "_target",
        R.target_email(override_target, F.col("ge_target_email"), F.col("owner_email")),
    )
    create = _plan_rows(
        books,
        "create",
        0,
        F.lit(0),
        at["create_url"],
        F.to_json(F.struct("title")),
        title=title,
        owner_email=F.col("owner_email"),
        target_email=F.col("_target"),
    )
    items = with_checkpoint_key(sources, "notebook_title").withColumn(
        "_native",
        F.lit(native_urls)
        & R.is_native_url(F.col("source_type"), F.col("source_url"), F.col("youtube_url")),
    )
    is_video = T.nonempty(F.col("youtube_url")).isNotNull()
    video = F.struct(
        F.array(
            F.struct(F.struct(F.col("youtube_url").alias("youtubeUrl")).alias("videoContent"))
        ).alias("userContents")
    )
    web = F.struct(
        F.array(
            F.struct(
                F.struct(F.col("source_url").alias("url"), title.alias("sourceName")).alias(
                    "webContent"
                )
            )
        ).alias("userContents")
    )
    link = _plan_rows(
        items.where("_native"),
        "batchCreate",
        1,
        F.col("position"),
        at["batch_url"],
        F.when(is_video, F.to_json(video)).otherwise(F.to_json(web)),
        title=title,
        link=F.when(is_video, F.col("youtube_url")).otherwise(F.col("source_url")),
        route=F.when(is_video, C.METHOD_VIDEO).otherwise(C.METHOD_WEB),
    )
    exists = (
        F.col("file_exists") if "file_exists" in sources.columns else F.lit(True)
    )
    upload = _plan_rows(
        items,
        "uploadFile",
        2,
        F.col("position"),
        at["upload_url"],
        F.lit(None).cast("string"),
        title=title,
        link=T.nonempty(F.col("source_url")),
        route=F.lit(C.METHOD_FILE),
        file_path=F.col("relative_sharepoint_path"),
        file_name=F.concat(T.sanitize_filename(title), F.lit(".docx")),
        depends_on=F.when(F.col("_native"), "batchCreate failed"),
        file_exists=exists,
    )
    note = _plan_rows(
        with_checkpoint_key(notes, "notebook_title"),
        "note",
        3,
        F.col("position"),
        at["notes_url"],
        F.to_json(F.struct("title", F.col("content_text").alias("content"))),
        title=title,
    )
    grant = F.struct(
        F.lit(NOTEBOOK_NAME).alias("name"),
        F.array(
            F.struct(F.col("_target").alias("email"), F.lit(C.SHARE_ROLE).alias("role"))
        ).alias("accountAndRoles"),
        F.lit(True).alias("notifyViaEmail"),
    )
    share = _plan_rows(
        books.where(R.has_target(F.col("_target"))),
        "share",
        4,
        F.lit(0),
        at["share_url"],
        F.to_json(grant),
        title=F.col("_target"),
    )
    return create.unionByName(link).unionByName(upload).unionByName(note).unionByName(share)


# --- outcomes ----------------------------------------------------------------


def retry_outcome(
    attempts: DataFrame, keys: Sequence[str], order: Sequence[str], status: str = "status"
) -> DataFrame:
    """Final status per request: the first answer that ends it, else the last answer.

    Only the first attempts count. Spark cuts each request to them before the
    shuffle (window group limit), so a request with very many logged attempts
    stays cheap.
    """
    by_order = W.partitionBy(*keys).orderBy(*order)
    counted = attempts.withColumn("_no", F.row_number().over(by_order)).where(
        F.col("_no") <= C.MAX_ATTEMPTS
    )
    final = ~R.retryable(F.col(status))
    answered = F.col(status).isNotNull()
    return counted.groupBy(*keys).agg(
        F.coalesce(
            F.min_by(status, F.when(final, F.col("_no"))),
            F.max_by(status, F.when(answered, F.col("_no"))),
        ).alias(status),
        F.coalesce(F.min(F.when(final, F.col("_no"))), F.max("_no")).alias("attempts"),
    )


def apply_outcomes(plan: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The plan with the status and result of each request.

    ``result`` is ok, failed or skipped (the file is missing). Requests that were
    never due are dropped: everything after a failed create, and an upload whose
    link request succeeded.
    """
    ok = R.http_ok(F.col("status"))
    created = outcomes.where((F.col("step") == "create") & ok).select(
        "checkpoint_key", F.lit(True).alias("_created")
    )
    linked = outcomes.where((F.col("step") == "batchCreate") & ok).select(
        "checkpoint_key", "seq", F.lit("uploadFile").alias("step"), F.lit(True).alias("_linked")
    )
    answers = outcomes.select(*PLAN_KEYS, "status", *_detail(outcomes))
    joined = (
        plan.join(answers, PLAN_KEYS, "left")
        .join(linked, PLAN_KEYS, "left")
        .join(created, "checkpoint_key", "left")
    )
    is_create = F.col("step") == "create"
    superseded = F.coalesce("_linked", F.lit(False)) & F.col("depends_on").isNotNull()
    due = is_create | (F.coalesce("_created", F.lit(False)) & ~superseded)
    missing = F.coalesce(~F.col("file_exists"), F.lit(False))
    return (
        joined.where(due)
        .withColumn("result", F.when(missing, "skipped").when(ok, "ok").otherwise("failed"))
        .drop("_linked", "_created")
    )


def _detail(outcomes: DataFrame) -> list[str]:
    return [c for c in ("response", "notebook_id", "notebook_name") if c in outcomes.columns]


def provision_log(results: DataFrame, size: int = CHUNK_ITEMS) -> DataFrame:
    """What happened to each notebook: lists of sources and notes, share, status.

    One row per notebook and chunk of ``size`` children; the chunk follows from the
    position that the plan already carries, so nothing is sorted for it.
    """
    def step(name: str) -> Column:
        return F.col("step") == name

    is_source = step("batchCreate") | step("uploadFile")
    ok, failed = F.col("result") == "ok", F.col("result") == "failed"
    chunk = F.when(
        step("create") | step("share"), F.lit(0)
    ).otherwise(F.floor((F.col("seq") - 1) / size).cast("int"))
    text = F.col("response") if "response" in results.columns else F.lit("")
    answer = F.coalesce(F.col("status").cast("string"), F.lit("ERR"))
    body = F.coalesce(text, F.lit(""))
    uploaded = F.struct("seq", "title", F.col("route").alias("method"), F.col("link").alias("url"))
    source_error = F.concat(F.lit("HTTP "), answer, F.lit(": "), F.substring(body, 1, 200))
    failure = F.struct("seq", "title", source_error.alias("error"))
    create_error = F.concat(
        F.lit("CreateNotebook HTTP "), answer, F.lit(": "),
        T.first_nonempty(F.substring(body, 1, 300), F.lit("No response")),
    )

    def listed(condition: Column, item: Column, fields: list[str]) -> Column:
        sorted_items = F.array_sort(F.collect_list(F.when(condition, item)))
        return F.transform(sorted_items, lambda x: F.struct(*[x[f].alias(f) for f in fields]))

    notes = F.array_sort(
        F.collect_list(F.when(step("note") & ok, F.struct("seq", "title")))
    )
    lists = results.groupBy("checkpoint_key", chunk.alias("chunk")).agg(
        listed(is_source & ok, uploaded, ["title", "method", "url"]).alias("sources_uploaded"),
        listed(step("uploadFile") & failed, failure, ["title", "error"]).alias("sources_failed"),
        F.transform(notes, lambda x: x["title"]).alias("notes_created"),
    )
    # What holds for a notebook as a whole is the same in all its chunks.
    of_create = {"owner_email": "owner_email", "target_email": "ge_target_email", "title": "title"}
    of_create |= {c: c for c in ("notebook_id", "notebook_name") if c in results.columns}
    whole = results.groupBy("checkpoint_key").agg(
        F.max(F.when(step("create"), F.col("result"))).alias("_create"),
        F.max(F.when(step("create") & failed, create_error)).alias("error"),
        *[F.max(F.when(step("create"), F.col(c))).alias(n) for c, n in of_create.items()],
        F.max(F.when(step("share") & ok, F.col("title"))).alias("shared_with"),
        F.coalesce(F.bool_or(step("uploadFile") & failed), F.lit(False)).alias("_failures"),
    )
    status = F.when(F.col("_create") == "failed", "failed").otherwise("completed")
    return (
        lists.join(whole, "checkpoint_key")
        .withColumn("status", status)
        .withColumn("has_failures", (F.col("status") == "failed") | F.col("_failures"))
        .drop("_create", "_failures")
    )


def run_summary(
    log: DataFrame, resumed: DataFrame | None = None, resume_enabled: bool = True
) -> DataFrame:
    """One row: how many notebooks were processed, completed and failed."""
    rows = log.where("chunk = 0").select("status")
    if resumed is not None:
        rows = rows.unionByName(resumed.where("chunk = 0").select("status"))
    done = F.count_if(F.col("status") == "completed")
    return rows.agg(
        F.count(F.lit(1)).alias("total_processed"), done.alias("completed_count")
    ).select(
        F.when(F.col("total_processed") == F.col("completed_count"), "success")
        .otherwise("partial_success")
        .alias("status"),
        F.lit(resume_enabled).alias("resume_checkpoint_enabled"),
        "total_processed",
        "completed_count",
        (F.col("total_processed") - F.col("completed_count")).alias("failed_count"),
    )


# --- ledger ------------------------------------------------------------------


def ledger_latest(ledger: DataFrame, stamp: Sequence[str] = ("version", "seq")) -> DataFrame:
    """Last entry per key, by version and sequence (or the named columns).

    An entry is one row, or several chunks written together; chunks of an older,
    longer entry do not survive.
    """
    own = F.struct(*stamp)
    last = F.struct("status", "entry", *dict.fromkeys(["version", "seq", *stamp]))
    rows = (
        ledger.groupBy("checkpoint_key", "chunk")
        .agg(F.max_by(last, own).alias("_last"))
        .select("checkpoint_key", "chunk", "_last.*")
    )
    newest = (
        ledger.groupBy("checkpoint_key")
        .agg(F.max(own).alias("_newest"))
        .select("checkpoint_key", "_newest.*")
    )
    return rows.join(newest, ["checkpoint_key", *stamp], "left_semi").select(*LEDGER_COLUMNS)


def ledger_entries(log: DataFrame, version: int) -> DataFrame:
    """Completed notebooks as ledger rows; a failed create runs again next time."""
    fields = [c for c in log.columns if c not in ("checkpoint_key", "chunk")]
    return log.where(F.col("status") == "completed").select(
        "checkpoint_key",
        "chunk",
        "status",
        F.to_json(F.struct(*fields)).alias("entry"),
        F.lit(version).cast("long").alias("version"),
        F.lit(0).cast("long").alias("seq"),
    )


def upsert_ledger(ledger: DataFrame, entries: DataFrame) -> DataFrame:
    """Old and new entries, the latest of each key."""
    return ledger_latest(
        ledger.select(*LEDGER_COLUMNS).unionByName(entries.select(*LEDGER_COLUMNS))
    )
