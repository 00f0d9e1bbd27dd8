import json
from concurrent.futures import ThreadPoolExecutor

import pytest

from codexferry.operators import provision as P
from codexferry.operators import upload as U
from codexferry.plans.manifest import Manifest
from codexferry.plans.provision import close_run, plan_requests
from codexferry.sinks import writers as K
from codexferry.sinks.commits import put_if_absent
from codexferry.sinks.writers import clear_ledger, save_entries
from codexferry.sources.tables import empty_ledger, ledger_state, read_ledger

OWNER = "ann@old.x"
BOOK_SCHEMA = "nb_key string, owner_email string, title string, ge_target_email string"
SOURCE_SCHEMA = (
    "nb_key string, owner_email string, notebook_title string, position long, title string, "
    "source_type string, source_url string, youtube_url string, relative_sharepoint_path string, "
    "file_exists boolean"
)
NOTE_SCHEMA = (
    "nb_key string, owner_email string, notebook_title string, position long, title string, "
    "content_text string"
)
ATTEMPT_SCHEMA = "checkpoint_key string, step string, seq long, attempt int, status int"


@pytest.fixture(scope="module")
def manifest(spark):
    books = [(f"k{i}", OWNER, f"N{i}", t) for i, t in enumerate([" ann@new.x ", "", "nobody"])]
    sources = []
    for i in range(3):
        rows = [
            ("Web", "SOURCE_CONTENT_TYPE_URL", "https://a.x/p", "", True),
            ("Video", "SOURCE_CONTENT_TYPE_YOUTUBE_VIDEO", "https://y/v", "https://y/v", True),
            ("File?", "SOURCE_CONTENT_TYPE_PDF", "", "", True),
            ("Gone", "SOURCE_CONTENT_TYPE_PDF", "", "", False),
            ("No link", "SOURCE_CONTENT_TYPE_URL", "", "", True),
        ]
        sources += [
            (f"k{i}", OWNER, f"N{i}", n, r[0], r[1], r[2], r[3], f"{OWNER}/N{i}/{r[0]}.docx", r[4])
            for n, r in enumerate(rows, 1)
        ]
    notes = [(f"k{i}", OWNER, f"N{i}", 1, "Note", 'a "b"\n\nc') for i in range(3)]
    return Manifest(
        spark.createDataFrame(books, BOOK_SCHEMA),
        spark.createDataFrame(sources, SOURCE_SCHEMA),
        spark.createDataFrame(notes, NOTE_SCHEMA),
        None,
    )


def test_request_plan(manifest):
    plan = plan_requests(manifest, None, "42", "us", override_target="  ")
    rows = {(r.checkpoint_key, r.step, r.seq): r for r in plan.collect()}
    key = f"{OWNER}::N0"
    assert sorted((s, q) for k, s, q in rows if k == key) == [
        ("batchCreate", 1), ("batchCreate", 2), ("create", 0), ("note", 1), ("share", 0),
        ("uploadFile", 1), ("uploadFile", 2), ("uploadFile", 3), ("uploadFile", 4), ("uploadFile", 5),
    ]
    create = rows[key, "create", 0]
    assert create.url == (
        "https://us-discoveryengine.googleapis.com/v1alpha/projects/42/locations/us/notebooks"
        "?serviceAccountUser=true"
    )
    assert json.loads(create.body) == {"title": "N0"}
    assert json.loads(rows[key, "batchCreate", 1].body) == {
        "userContents": [{"webContent": {"url": "https://a.x/p", "sourceName": "Web"}}]
    }
    assert json.loads(rows[key, "batchCreate", 2].body) == {
        "userContents": [{"videoContent": {"youtubeUrl": "https://y/v"}}]
    }
    assert json.loads(rows[key, "note", 1].body) == {"title": "Note", "content": 'a "b"\n\nc'}
    share = rows[key, "share", 0]
    assert json.loads(share.body)["accountAndRoles"] == [
        {"email": "ann@new.x", "role": "PROJECT_ROLE_WRITER"}
    ]
    assert rows[key, "uploadFile", 1].depends_on and not rows[key, "uploadFile", 3].depends_on
    assert rows[key, "uploadFile", 3].file_name == "File_.docx"
    # no mapped target: the owner; a target without @ is not shared with
    assert rows[f"{OWNER}::N1", "share", 0].title == OWNER
    assert (f"{OWNER}::N2", "share", 0) not in rows
    over = plan_requests(manifest, None, "42", override_target=" x@y.z ", native_urls=False)
    assert over.where("step = 'share' and title = 'x@y.z'").count() == 3
    assert over.where("step = 'batchCreate' or depends_on is not null").count() == 0
    assert over.where("url like 'https://discoveryengine%/locations/global/%'").count() > 0


def test_retry_outcome(spark):
    tries = {
        "first": [200], "last": [503, 429, 500, 201], "late": [503, 503, 503, 503, 200],
        "client": [503, 404, 200], "raised": [None, None, None, None], "mixed": [None, 502, None, None],
        "short": [503],
    }
    rows = [(k, i, s) for k, ss in tries.items() for i, s in enumerate(ss)]
    df = spark.createDataFrame(rows, "k string, attempt int, status int")
    got = {r.k: (r.status, r.attempts) for r in P.retry_outcome(df, ["k"], ["attempt"]).collect()}
    assert got == {
        "first": (200, 1), "last": (201, 4), "late": (503, 4), "client": (404, 2),
        "raised": (None, 4), "mixed": (502, 4), "short": (503, 1),
    }


def test_attempts_are_cut_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 2 as k", "id as attempt", "503 as status")
    plan = P.retry_outcome(df, ["k"], ["attempt"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def attempts(spark, answers, plan):
    rows = [
        (r.checkpoint_key, r.step, r.seq, 1, answers.get((r.checkpoint_key[-2:], r.step, r.seq), 200))
        for r in plan.collect()
    ]
    return spark.createDataFrame(rows, ATTEMPT_SCHEMA)


def test_run_log_and_resume(spark, manifest, tmp_path):
    uri = str(tmp_path / "ledger")
    assert read_ledger(spark, uri).count() == 0
    plan = plan_requests(manifest, read_ledger(spark, uri), "42")
    answers = {
        ("N0", "batchCreate", 2): 400, ("N0", "uploadFile", 3): 500, ("N0", "note", 1): 403,
        ("N0", "share", 0): 404, ("N1", "create", 0): None, ("N2", "create", 0): 201,
    }
    run = close_run(manifest, plan, attempts(spark, answers, plan), read_ledger(spark, uri), 1)
    log = {r.checkpoint_key[-2:]: r for r in run.log.collect()}
    n0 = log["N0"]
    assert [(s.title, s.method, s.url) for s in n0.sources_uploaded] == [
        ("Web", "batchCreate (webContent)", "https://a.x/p"),
        ("Video", "uploadFile (.docx)", "https://y/v"),
        ("No link", "uploadFile (.docx)", None),
    ]
    assert [(s.title, s.error) for s in n0.sources_failed] == [("File?", "HTTP 500: ")]
    assert (n0.notes_created, n0.shared_with, n0.status, n0.has_failures) == ([], None, "completed", True)
    assert (log["N1"].status, log["N1"].error) == ("failed", "CreateNotebook HTTP ERR: No response")
    assert (n0.owner_email, n0.title) == (OWNER, "N0") and n0.ge_target_email
    assert (log["N1"].owner_email, log["N1"].title) == (OWNER, "N1")
    assert log["N1"].sources_uploaded == [] and log["N1"].notes_created == []
    assert (log["N2"].notes_created, log["N2"].status, log["N2"].error) == (["Note"], "completed", None)
    results = P.apply_outcomes(plan, P.retry_outcome(attempts(spark, answers, plan), P.PLAN_KEYS, ["attempt"]))
    assert {r.result for r in results.where("title = 'Gone'").collect()} == {"skipped"}
    summary = run.summary.first().asDict()
    assert summary == {
        "status": "partial_success", "resume_checkpoint_enabled": True, "total_processed": 3,
        "completed_count": 2, "failed_count": 1,
    }
    save_entries(P.ledger_entries(run.log, 1), uri, 1)

    # The second run does exactly what the first did not complete.
    ledger = read_ledger(spark, uri)
    again = plan_requests(manifest, ledger, "42")
    assert {r.checkpoint_key for r in again.collect()} == {f"{OWNER}::N1"}
    second = close_run(manifest, again, attempts(spark, {}, again), ledger, 2)
    assert sorted(r.checkpoint_key[-2:] for r in second.resumed.collect()) == ["N0", "N2"]
    assert all(r.resumed_from_checkpoint for r in second.resumed.collect())
    stored = json.loads(second.resumed.where(f"checkpoint_key = '{OWNER}::N0'").first().entry)
    assert [s["title"] for s in stored["sources_uploaded"]] == ["Web", "Video", "No link"]
    assert (stored["owner_email"], stored["title"]) == (OWNER, "N0") and stored["ge_target_email"]
    assert second.summary.first().status == "success" and second.summary.first().total_processed == 3
    save_entries(P.ledger_entries(second.log, 2), uri, 2)
    assert read_ledger(spark, uri).count() == 3
    clear_ledger(spark, uri, 3)
    assert read_ledger(spark, uri).count() == 0


def test_log_chunks_are_whole(spark, manifest):
    plan = plan_requests(manifest, None, "42")
    failed = {("N0", "uploadFile", 4): 500}
    outcomes = P.retry_outcome(attempts(spark, failed, plan), P.PLAN_KEYS, ["attempt"])
    broken = P.provision_log(P.apply_outcomes(plan, outcomes), size=2)
    rows = broken.where(f"checkpoint_key = '{OWNER}::N0'").collect()
    assert len({(r.has_failures, r.shared_with, r.title, r.owner_email) for r in rows}) == 1
    outcomes = P.retry_outcome(attempts(spark, {}, plan), P.PLAN_KEYS, ["attempt"])
    log = P.provision_log(P.apply_outcomes(plan, outcomes), size=2)
    rows = log.where(f"checkpoint_key = '{OWNER}::N0'").orderBy("chunk").collect()
    assert [[s.title for s in r.sources_uploaded] for r in rows] == [
        ["Web", "Video"], ["File?"], ["No link"],
    ]
    assert [r.status for r in rows] == ["completed"] * 3
    assert P.run_summary(log).first().total_processed == 3


def test_ledger_keeps_the_newest_entry_of_all_chunks(spark):
    rows = [
        ("a", 0, "completed", "a0", 1, 0), ("a", 1, "completed", "a1", 1, 0),
        ("a", 0, "completed", "b0", 2, 0), ("c", 0, "failed", "c", 1, 5), ("c", 0, "completed", "d", 1, 6),
    ]
    ledger = spark.createDataFrame(
        rows, "checkpoint_key string, chunk int, status string, entry string, version long, seq long"
    )
    got = sorted((r.checkpoint_key, r.chunk, r.entry) for r in P.ledger_latest(ledger).collect())
    assert got == [("a", 0, "b0"), ("c", 0, "d")]
    assert P.upsert_ledger(empty_ledger(spark), ledger).count() == 2


def test_select_indices(spark, manifest):
    order = ["nb_key"]
    pick = lambda x: sorted(r.title for r in P.select_indices(manifest.notebooks, x, order).collect())
    assert pick(None) == ["N0", "N1", "N2"] and pick([0, 2, 9]) == ["N0", "N2"] and pick([]) == []
    assert pick(spark.createDataFrame([(1,), (1,)], "index int")) == ["N1"]


def test_upload_plan(spark):
    transfer = spark.createDataFrame(
        [("/stage/a@b.c/My Book", "Documents", "Moved/My Book", "https://site", "a@b.c", "a@n.x", "g"),
         ("/stage/a@b.c/Empty", "Documents", "Moved/Empty", "https://site", "a@b.c", "a@n.x", "g")],
        "SourcePath string, TargetDocumentLibrary string, TargetSubFolder string, TargetWebUrl string, "
        "GWS_Owner_Email string, M365_SharePoint_UPN string, GE_Target_Email string",
    )
    files = spark.createDataFrame(
        [("a@b.c/My Book/Index.md",), ("a@b.c/My Book/Sources/x y.v1.docx",), ("list.csv",),
         ("a@b.c/My Book 2/z.md",)], "rel_path string",
    )
    rows = {r.file: r for r in U.upload_plan(transfer, U.staged_files(files, "/stage/"), "D").collect()}
    assert set(rows) == {"Index.md", "x y.v1.docx"}
    deep = rows["x y.v1.docx"]
    assert deep.remote_dir == "a@n.x/Moved/My Book/Sources"
    assert deep.put_url == (
        "https://graph.microsoft.com/v1.0/drives/D/root:/a%40n.x/Moved/My%20Book/Sources/x%20y.v1.docx:/content"
    )
    assert (deep.library_folder, deep.item_title) == ("Documents/Moved/My Book/Sources", "x y.v1")
    assert rows["Index.md"].library_folder == "Documents/Moved/My Book"


def test_hot_folder_is_split_by_the_skew_join(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        transfer = spark.range(100).selectExpr(
            "concat('/stage/o/n', id) as SourcePath", "'L' as TargetDocumentLibrary",
            "'S' as TargetSubFolder", "'w' as TargetWebUrl", "'u' as M365_SharePoint_UPN",
        ).repartition(4)
        files = spark.range(60000).selectExpr(
            "concat('o/n', if(id % 3 = 0, 7, id % 100), '/Sources/f', id) as rel_path"
        ).repartition(8)
        plan = U.upload_plan(transfer, U.staged_files(files, "/stage"), "D")
        assert len(plan.collect()) == 60000
        assert "skew=true" in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_missing_documents_are_skipped(spark, manifest):
    path = manifest.sources.where("title = 'Web'").first().relative_sharepoint_path
    staged = spark.createDataFrame([(path,)], "rel_path string")
    plan = plan_requests(manifest, None, "42", staged=staged)
    uploads = plan.where("step = 'uploadFile'").collect()
    assert len(uploads) > 1
    assert {r.file_path for r in uploads if r.file_exists} == {path}


LEDGER_ROW = "checkpoint_key string, chunk int, status string, entry string, version long, seq long"


def ledger_rows(spark, *rows):
    return spark.createDataFrame([(k, 0, "completed", e, v, s) for k, e, v, s in rows], LEDGER_ROW)


def shown(spark, uri, version=None):
    return {r.checkpoint_key: r.entry for r in read_ledger(spark, uri, version).collect()}


def test_a_save_writes_its_own_entries_only(spark, tmp_path):
    uri = str(tmp_path / "l")
    save_entries(ledger_rows(spark, *((f"k{i}", "old", 1, 0) for i in range(500))), uri)
    save_entries(ledger_rows(spark, *((f"k{i}", "new", 2, 0) for i in range(10))), uri)
    folders = {p.name: spark.read.parquet(str(p)).count() for p in (tmp_path / "l" / "entries").iterdir()}
    assert sorted(folders.values()) == [10, 500]
    assert sorted(shown(spark, uri).values()) == ["new"] * 10 + ["old"] * 490
    before = sorted(map(tuple, read_ledger(spark, uri).collect()))
    assert K.compact_ledger(spark, uri) == 3
    assert sorted(map(tuple, read_ledger(spark, uri).collect())) == before
    assert sorted(map(tuple, read_ledger(spark, uri, 2).collect())) == before
    assert shown(spark, uri, 1)["k3"] == "old"


def test_writers_of_one_version_both_keep_their_entries(spark, tmp_path):
    uri = f"file://{tmp_path}/l"
    with ThreadPoolExecutor(6) as pool:
        numbers = list(pool.map(lambda i: save_entries(ledger_rows(spark, (f"k{i}", f"e{i}", 1, 0), ("same", f"e{i}", 1, 0)), uri, 1), range(6)))
    assert sorted(numbers) == [1, 2, 3, 4, 5, 6]
    found = shown(spark, uri)
    assert {k: v for k, v in found.items() if k != "same"} == {f"k{i}": f"e{i}" for i in range(6)}
    assert found["same"] == f"e{numbers.index(6)}"


def test_a_commit_is_made_once(spark, tmp_path):
    for base in (str(tmp_path / "a"), f"file://{tmp_path}/b"):
        assert put_if_absent(spark, f"{base}/commits/1.json", "one")
        assert not put_if_absent(spark, f"{base}/commits/1.json", "two")
    assert [(p.name, p.read_text()) for p in (tmp_path / "b" / "commits").iterdir()] == [("1.json", "one")]
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.shelf.link./x", f"file://{tmp_path}/c")
    (tmp_path / "c").mkdir()
    assert put_if_absent(spark, "viewfs://shelf/x/commits/1.json", "one")
    assert not put_if_absent(spark, "viewfs://shelf/x/commits/1.json", "two")
    assert (tmp_path / "c" / "commits" / "1.json").read_text() == "one"


def test_a_compaction_neither_hides_nor_revives(spark, tmp_path):
    uri = str(tmp_path / "l")
    save_entries(ledger_rows(spark, ("a", "1", 1, 0), ("b", "1", 1, 0)), uri)
    state = read_ledger(spark, uri, 1)
    # Others commit while the snapshot of commit 1 is made.
    save_entries(ledger_rows(spark, ("a", "2", 2, 0)), uri)
    K.write_ledger(state, uri, 2, upto=1)
    assert shown(spark, uri) == {"a": "2", "b": "1"}
    clear_ledger(spark, uri)
    K.write_ledger(state, uri, upto=1)
    assert shown(spark, uri) == {}
    save_entries(ledger_rows(spark, ("c", "3", 3, 0)), uri)
    assert shown(spark, uri) == {"c": "3"}


def test_many_deltas_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "COMPACT_AFTER", 3)
    uri = str(tmp_path / "l")
    for i in range(6):
        save_entries(ledger_rows(spark, (f"k{i}", "e", i, 0)), uri)
        assert len(ledger_state(spark, uri)[1]) <= 3
    assert len(shown(spark, uri)) == 6
