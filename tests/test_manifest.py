import io
import json
import xml.dom.minidom
import zipfile

import pytest
from pyspark.sql import functions as F

from codexferry import constants as C
from codexferry.operators import notebooks as N
from codexferry.operators import summary as S
from codexferry.operators.identity import identity_map
from codexferry.operators.notebooks import merge_new_titles, path_collisions
from codexferry.plans import manifest as M
from codexferry.sinks import writers as K
from codexferry.sources import tables as R
from codexferry.sources.archives import unzip
from tests.exports import HTML_PAGE, notebook, source, zip_bytes

OWNER = "own@x.y"


def tree(spark, *archives):
    rows = [(f"a{i}.zip", "", zip_bytes(entries)) for i, entries in enumerate(archives)]
    return unzip(spark.createDataFrame(rows, "archive string, dest string, content binary"), OWNER)


def identity(spark, rows):
    raw = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "line_no long, `GWS_Email ` string, m365_upn string, ge_target_email string, "
        "sharepoint_site_url string",
    )
    return identity_map(raw)


FIRST = notebook(
    "ann@old.x", "Solar", {
        "Panels": (source(), HTML_PAGE),
        "Talk": (source("YOUTUBE_VIDEO", video="v1", channel="Ch"), "<p>hi there</p>"),
        "Deck": (source("PDF"), None),
        "Broken": ("{not json", "<p>x</p>"),
    },
    notes={"Idea": "<p>one</p><p>two</p>"},
    artifacts={"Quiz": {"artifactType": "ARTIFACT_TYPE_QUIZ"}, "Map": {"appType": "APP", "title": "M"},
               "Bad": "[1"},
    extra={"emoji": None, "other": {"z": 1, "a": 2}},
)
# The same notebook again, title in another case, in a folder that sorts later.
SECOND = notebook(
    "ann@old.x", "Solar copy", {
        "Panels": (source("PDF"), "<p>other</p>"),
        "Extra": (source("PDF"), "<p>a b c</p>"),
    },
    title="SOLAR", notes={"Late": "<p>n</p>"}, artifacts={"L": {}},
)
THIRD = notebook("bob@old.x", "No title", {}, title="")
NOISE = {
    "ann@old.x/x/Plain/Plain metadata.json": {"name": "no title or emoji"},
    "ann@old.x/x/Bad/Bad metadata.json": "{",
    "ann@old.x/x/Solar/Sources/Orphan.html": "<p>no metadata</p>",
    "ann@old.x/x/List/List metadata.json": '["title"]',
    "q/Sources/Sources metadata.json": {"title": "inside a child folder"},
    "q/Sources/sub/E metadata.json": {"emoji": "x"},
}


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    uri = str(tmp_path_factory.mktemp("work"))
    return M.extract(tree(spark, {**FIRST, **SECOND}, {**THIRD, **NOISE}), OWNER, uri)


@pytest.fixture(scope="module")
def manifest(spark, found):
    ids = identity(spark, [
        (" ANN@old.x ", "first@new.x", None, None),
        ("ann@old.x", " ann@new.x ", "", None),
        (None, "nobody@new.x", None, None),
    ])
    return M.map_owners(M.merge(found), ids, "/stage")


def test_notebooks(manifest):
    rows = {r.nb_key: r for r in manifest.notebooks.collect()}
    assert set(rows) == {"ann@old.x::solar", "bob@old.x::no title", f"{OWNER}::e"}
    solar = rows["ann@old.x::solar"]
    assert (solar.title, solar.emoji, solar.sharepoint_folder) == ("Solar", None, "ann@old.x/Solar")
    assert json.loads(solar.metadata) == {"title": "Solar", "emoji": None, "other": {"z": 1, "a": 2}}
    assert solar.metadata.index('"z"') < solar.metadata.index('"a"')
    assert (solar.m365_upn, solar.ge_target_email) == ("ann@new.x", "ann@new.x")
    assert solar.sharepoint_site_url.endswith("/Shared Documents/ann@new.x")
    assert rows["bob@old.x::no title"].m365_upn == "bob@old.x"
    assert rows["bob@old.x::no title"].emoji == "📓"
    assert rows[f"{OWNER}::e"].title == "E"


def test_sources(manifest):
    rows = {r.title: r for r in manifest.sources.collect()}
    assert [r for r in sorted(rows, key=lambda t: rows[t].position)] == [
        "Broken", "Deck", "Panels", "Talk", "Extra",
    ]
    assert rows["Panels"].source_url == "https://energy.example/solar-panels"
    assert rows["Panels"].source_type == "SOURCE_CONTENT_TYPE_URL"
    assert rows["Panels"].word_count == 5
    assert rows["Talk"].source_url == rows["Talk"].youtube_url == "https://www.youtube.com/watch?v=v1"
    assert (rows["Talk"].youtube_channel, rows["Talk"].added_timestamp) == ("Ch", "2024-01-01")
    assert (rows["Deck"].word_count, rows["Deck"].source_url) == (0, "")
    assert (rows["Broken"].source_type, rows["Broken"].word_count) == ("SOURCE_CONTENT_TYPE_UNKNOWN", 1)
    assert rows["Extra"].from_later_copy and not rows["Panels"].from_later_copy
    assert rows["Extra"].docx_path == "/stage/ann@old.x/SOLAR/Sources/Extra.docx"


def test_only_new_titles_come_from_later_copies(found):
    assert [r.title for r in merge_new_titles(found.sources, found.copies).collect()] == ["Extra"]


def test_notes_and_artifacts_come_from_the_first_copy(manifest):
    notes = manifest.notes.collect()
    assert [(n.title, n.content_text, n.position) for n in notes] == [("Idea", "one\n\ntwo", 1)]
    assert notes[0].relative_sharepoint_path == "ann@old.x/Solar/Notes/Idea.docx"
    got = sorted((a.position, a.title, a.artifact_type) for a in manifest.artifacts.collect())
    assert got == [(1, "Bad", "STUDIO_ARTIFACT"), (2, "M", "APP"), (3, "Quiz", "ARTIFACT_TYPE_QUIZ")]


def test_nested_rows_and_chunks(manifest):
    rows = {r.nb_key: r for r in manifest.nested().collect()}
    solar = rows["ann@old.x::solar"]
    assert [s.title for s in solar.sources] == ["Broken", "Deck", "Panels", "Talk", "Extra"]
    assert [n.title for n in solar.notes] == ["Idea"] and len(solar.artifacts) == 3
    assert list(solar.sources[0].asDict()) == S.SOURCE_ITEM
    empty = rows["bob@old.x::no title"]
    assert (empty.chunk, empty.sources, empty.notes, empty.artifacts) == (0, [], [], [])
    chunks = manifest.nested(size=2).where("nb_key = 'ann@old.x::solar'").orderBy("chunk").collect()
    assert [[s.title for s in c.sources] for c in chunks] == [
        ["Broken", "Deck"], ["Panels", "Talk"], ["Extra"],
    ]
    assert [len(c.notes) for c in chunks] == [1, 0, 0]


def test_totals_equal_the_sums(manifest):
    row = manifest.totals().first()
    assert row.asDict() == {
        "user_count": 3, "notebook_count": 3, "total_sources": 5, "total_urls_recovered": 2,
        "total_notes": 1, "total_artifacts": 3, "total_errors": 0,
    }


def test_user_summary(manifest):
    rows = {r.gws_email: r for r in S.user_summary(manifest.notebooks, manifest.sources).collect()}
    ann = rows["ann@old.x"]
    assert (ann.notebook_count, ann.source_count, ann.url_count, ann.notebooks) == (1, 5, 2, ["Solar"])
    assert rows["bob@old.x"].source_count == 0
    assert [r.owner_email for r in S.distinct_users(manifest.notebooks).collect()] == sorted(rows)


def test_index(manifest):
    lines = S.index_lines(manifest.notebooks, manifest.sources)
    rows = lines.where("nb_key = 'ann@old.x::solar'").orderBy("line_no").collect()
    text = [r.line for r in rows]
    assert [r.line_no for r in rows] == list(range(16))
    assert text[0] == "# None Solar" and text[2] == "- **GWS Owner**: `ann@old.x`"
    assert text[5] == "- **Total Sources**: 5"
    assert text[13] == (
        "| 3 | Panels | `SOURCE_CONTENT_TYPE_URL` | [https://energy.example/solar-panels]"
        "(https://energy.example/solar-panels) | `Sources/Panels.docx` |"
    )
    assert text[12] == "| 2 | Deck | `SOURCE_CONTENT_TYPE_PDF` | _Uploaded File_ | `Sources/Deck.docx` |"


def test_documents(found):
    rows = {r.path: bytes(r.content) for r in M.documents(found).collect()}
    assert set(rows) == {
        "ann@old.x/Solar/Sources/Panels.docx", "ann@old.x/Solar/Sources/Talk.docx",
        "ann@old.x/Solar/Sources/Deck.docx", "ann@old.x/Solar/Sources/Broken.docx",
        "ann@old.x/SOLAR/Sources/Panels.docx", "ann@old.x/SOLAR/Sources/Extra.docx",
        "ann@old.x/Solar/Notes/Idea.docx", "ann@old.x/SOLAR/Notes/Late.docx",
    }

    def paragraphs(path):
        with zipfile.ZipFile(io.BytesIO(rows[path])) as zf:
            assert [i.filename for i in zf.infolist()] == [
                "[Content_Types].xml", "_rels/.rels", "word/document.xml",
            ]
            dom = xml.dom.minidom.parseString(zf.read("word/document.xml"))
        out = []
        for p in dom.getElementsByTagName("w:p"):
            size = p.getElementsByTagName("w:sz")[0].getAttribute("w:val")
            bold = bool(p.getElementsByTagName("w:b"))
            node = p.getElementsByTagName("w:t")[0].firstChild
            out.append((node.data if node else "", size, bold))
        return out

    assert paragraphs("ann@old.x/Solar/Sources/Panels.docx") == [
        ("Panels", "36", True),
        ("Original Source Type: SOURCE_CONTENT_TYPE_URL | Owner: ann@old.x | Added: 2024-01-01", "18", False),
        ("Original Source URL: https://energy.example/solar-panels", "20", True),
        ("Solar Panels", "32", True),
        ("About solar power.", "22", False),
    ]
    assert paragraphs("ann@old.x/Solar/Sources/Talk.docx")[3] == ("YouTube Channel: Ch", "18", False)
    assert paragraphs("ann@old.x/Solar/Notes/Idea.docx")[1:] == [
        ("Original Source Type: NOTE | Owner: ann@old.x | Added: N/A", "18", False),
        ("one", "22", False), ("two", "22", False),
    ]


def test_later_archives_replace_files(spark):
    path = "ann@old.x/T/N/N metadata.json"
    page = "ann@old.x/T/N/Sources/S"
    df = tree(
        spark,
        {path: {"title": "Old"}, f"{page} metadata.json": source("PDF"), f"{page}.html": "<p>old</p>"},
        {path: {"title": "New"}, f"{page}.html": "<p>new text</p>"},
    )
    found = M.extract(df, OWNER)
    assert [r.title for r in found.copies.collect()] == ["New"]
    row = found.sources.collect()[0]
    assert (row.source_type, row.word_count) == ("SOURCE_CONTENT_TYPE_PDF", 2)


def test_equal_file_names_are_reported(spark):
    df = tree(spark, notebook("a@b.c", "N", {"x?": (source("PDF"), ""), "x*": (source("PDF"), "")}))
    merged = M.merge(M.extract(df, OWNER))
    assert [r.n for r in path_collisions(merged.sources).collect()] == [2]


def test_fan_out_of_a_template(spark):
    found = M.extract(tree(spark, FIRST), OWNER)
    users = [(f"u{i}@old.x", f"u{i}@new.x", None, None) for i in range(7)]
    merged = M.merge(found)
    wide = M.map_owners(merged, identity(spark, users), "/stage")
    assert wide.notebooks.count() == 7 and wide.sources.count() == 28 and wide.notes.count() == 7
    assert {r.owner_email for r in wide.notebooks.collect()} == {u[0] for u in users}
    row = wide.sources.where("owner_email = 'u3@old.x' and title = 'Deck'").first()
    assert row.relative_sharepoint_path == "u3@old.x/Solar/Sources/Deck.docx"
    assert row.copied_from == "ann@old.x/Solar/Sources/Deck.docx"
    # notes keep the template's path unless asked otherwise
    assert {r.relative_sharepoint_path for r in wide.notes.collect()} == {
        "ann@old.x/Solar/Notes/Idea.docx"
    }
    moved = M.map_owners(merged, identity(spark, users), "/stage", rewrite_note_paths=True)
    assert "u6@old.x/Solar/Notes/Idea.docx" in {
        r.relative_sharepoint_path for r in moved.notes.collect()
    }
    assert wide.nested().count() == 7
    # the staged folder of each user is whole: sources, notes and index
    copied = {(r.copied_from, r.path) for r in wide.copied.collect()}
    assert len(copied) == 7 * (4 + 1 + 1)
    for name in ("Notes/Idea.docx", "Notebook_Sources_Index.md", "Sources/Deck.docx"):
        assert (f"ann@old.x/Solar/{name}", f"u2@old.x/Solar/{name}") in copied
    assert {p for _, p in copied} <= {r.path for r in M.staged_listing(wide).collect()}
    # one mapped user, or two owners: no fan-out
    assert M.map_owners(merged, identity(spark, users[:1])).notebooks.count() == 1
    two = M.merge(M.extract(tree(spark, FIRST, THIRD), OWNER))
    assert M.map_owners(two, identity(spark, users)).notebooks.count() == 2


def test_package_entries(spark, manifest):
    listing = M.staged_listing(manifest)
    names = {r.arcname for r in S.package_entries(listing, manifest.notebooks).collect()}
    assert "upload_to_sharepoint_pnp.ps1" in names
    assert "sharepoint_spmt_manifest.csv" in names and "ann@old.x/Solar/Sources/Deck.docx" in names
    one = manifest.notebooks.where("owner_email = 'ann@old.x'")
    short = {r.arcname for r in S.package_entries(listing, one).collect()}
    assert "Solar/Sources/Deck.docx" in short and "Solar/Notebook_Sources_Index.md" in short


def test_sinks_round_trip(spark, manifest, found, tmp_path):
    uri = str(tmp_path)
    transfer = S.transfer_manifest(manifest.notebooks, "/stage")
    K.write_transfer_manifest(transfer, f"{uri}/transfer")
    back = R.read_transfer_manifest(spark, f"{uri}/transfer")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, transfer.collect()))
    K.write_manifest(manifest.tables(), manifest.totals(), f"{uri}/manifest")
    tables = R.read_manifest(spark, f"{uri}/manifest")
    assert tables["sources"].count() == 5
    K.write_nested_manifest(manifest.nested(), f"{uri}/nested")
    nested = R.read_manifest_json(spark, f"{uri}/nested")
    assert nested.where("title = 'Solar'").first().emoji is None
    lines = S.index_lines(manifest.notebooks, manifest.sources)
    K.write_index(S.index_files(lines), f"{uri}/index")
    index = spark.read.parquet(f"{uri}/index").where("path like 'ann@old.x/Solar/%'").collect()
    assert [r.path for r in index] == ["ann@old.x/Solar/Notebook_Sources_Index.md"]
    parts = S.index_files(lines, size=5).where("path like 'ann@old.x/Solar/%'").orderBy("part").collect()
    assert len(parts) == 4 and "".join(p.content for p in parts) == index[0].content
    K.export_files(S.index_files(lines, size=5), f"{uri}/indexes")
    folder = tmp_path / "indexes" / "ann@old.x" / "Solar"
    assert [p.name for p in folder.iterdir()] == ["Notebook_Sources_Index.md"]
    assert (folder / "Notebook_Sources_Index.md").read_text() == index[0].content
    with pytest.raises(ValueError, match="viewfs"):
        K.export_files(S.index_files(lines), "viewfs://bucket/out")
    assert index[0].content.startswith("# None Solar\n\n") and index[0].content.count("\n") == 16
    K.write_documents(M.documents(found), f"{uri}/documents")
    documents = spark.read.parquet(f"{uri}/documents")
    K.export_files(documents, f"{uri}/staged")
    staged = R.list_staged_files(spark, f"{uri}/staged")
    assert {r.rel_path for r in staged.collect()} == {r.path for r in documents.collect()}
    assert "content" not in str(staged._jdf.queryExecution().executedPlan().toString()).split("ReadSchema")[-1]
    bad = spark.createDataFrame([("../out", b"x")], "path string, content binary")
    with pytest.raises(Exception, match="leaves the folder"):
        K.export_files(bad, f"{uri}/staged")


def test_identity_csv(spark, tmp_path):
    (tmp_path / "map.csv").write_text(
        "﻿Source_Email , Target_UPN,gemini_enterprise_target_email,SHAREPOINT_onedrive_destination_url\n"
        " A@x.y ,a@n,,\n"
        "b@x.y\n"
        "c@x.y,c@n,c@g,http://site,too,many\n"
        ",lost@n,,\n"
        '"a@x.y","a2@n"," a3@g ",""\n',
        encoding="utf-8",
    )
    rows = identity_map(R.read_identity_map(spark, str(tmp_path / "map.csv"))).orderBy("gws_email")
    got = [(r.gws_email, r.m365_upn, r.ge_target_email) for r in rows.collect()]
    assert got == [("a@x.y", "a2@n", "a3@g"), ("b@x.y", "b@x.y", "b@x.y"), ("c@x.y", "c@n", "c@g")]
    assert rows.collect()[2].sharepoint_site_url == "http://site"
    wave = R.generate_wave(spark, 1200, "old.x", "new.x").orderBy("gws_email")
    emails = [r.gws_email for r in wave.collect()]
    assert len(set(emails)) == 1200 and {"user001@old.x", "user1200@old.x"} <= set(emails)
    assert wave.count() == identity_map(wave.withColumn("line_no", F.lit(1))).count()


def test_identity_rows_follow_file_names(spark, tmp_path):
    from codexferry.operators.identity import identity_map

    head = "gws_email,m365_upn\n"
    folder = tmp_path / "people"
    folder.mkdir()
    (folder / "a.csv").write_text(head + "u@x.y,first@n\n" + "".join(f"p{i}@x.y,p@n\n" for i in range(300)))
    (folder / "b.csv").write_text(head + "u@x.y,second@n\n")
    (folder / "c.csv").write_text(head + "u@x.y,third@n\n" + "".join(f"q{i}@x.y,q@n\n" for i in range(50)) + "u@x.y,last@n\n")
    rows = identity_map(R.read_identity_map(spark, str(folder)))
    assert rows.where("gws_email = 'u@x.y'").first().m365_upn == "last@n"
    assert rows.count() == 351


def test_transfer_lists_are_read_by_name(spark, tmp_path):
    columns = list(reversed(C.TRANSFER_COLUMNS))
    (tmp_path / "t.csv").write_text("Extra," + ",".join(columns) + "\n-," + ",".join(f"v:{c}" for c in columns) + "\n")
    row = R.read_transfer_manifest(spark, str(tmp_path / "t.csv")).first()
    assert row.asDict() == {c: f"v:{c}" for c in C.TRANSFER_COLUMNS}
    (tmp_path / "bad.csv").write_text("SourcePath\nx\n")
    with pytest.raises(ValueError, match="TargetWebUrl"):
        R.read_transfer_manifest(spark, str(tmp_path / "bad.csv"))


def test_manifest_json_has_a_row_per_line_or_file(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"title": "a"}\n{"title": "b"}\n')
    (tmp_path / "one.json").write_text('{\n "title": "c"\n}\n')
    assert [r.title for r in R.read_manifest_json(spark, str(tmp_path / "lines.json")).collect()] == ["a", "b"]
    assert [r.title for r in R.read_manifest_json(spark, str(tmp_path / "one.json"), multi_line=True).collect()] == ["c"]


GOOD = ['{"title":"a"}', ' {"title" : [1, {"b":2}], "x": NaN}\n', '{}', '{"_end":"a"}', '{"title":null,"title":"b"}']
BAD = [
    "", " ", '{"title":"a"', '{"title":"a"} x', '{"title":"a"}{}', '{"title":"a"},{"title":"a"}', '{"title":"a"}] [{}', '{"title":"a"},',
    '{"t":1},"b":0} {"a":{}', "{", '{"t":1}]', '{"t":1}}', "1,2", '{"t":1}],[2', "[1", "[{}]", "5", "null", "'a'", "{'title':1}", '{"title":01}', '{"title":"a\tb"}', '{"title":"a"}// x', None,
]


def test_an_object_is_read_only_if_it_is_the_whole_text(column):
    read = lambda kind: lambda c: N.json_object(c, kind).isNotNull()
    for kind in (N.NOTEBOOK_JSON, N.SOURCE_JSON, N.ARTIFACT_JSON):
        assert column(read(kind), GOOD) == [True] * len(GOOD)
        assert column(read(kind), BAD) == [False] * len(BAD)


def test_text_after_the_object_makes_it_unreadable(column):
    whole = '{"title":"a","emoji":"e","appType":"t","metadata":{"originalSourceContentType":"k"}}'
    tails = ["", " \n", " x", "{}", ",{}", "]", "] [", "//"]
    good = [True, True] + [False] * 6
    values = [whole + t for t in tails]
    assert column(N.is_notebook, values) == good
    assert column(lambda c: N.notebook_title(c, F.lit("f metadata.json")), values) == ["a" if g else "f" for g in good]
    assert column(N.notebook_emoji, values) == ["e" if g else C.DEFAULT_EMOJI for g in good]
    kinds = column(lambda c: N.source_fields(c)["source_type"], values)
    assert kinds == ["k" if g else C.TYPE_UNKNOWN for g in good]
    titles = column(lambda c: N.artifact_fields(c, F.lit("base"))["title"], values)
    assert titles == ["a" if g else "base" for g in good]


def test_values_of_odd_objects(column):
    title = lambda c: N.notebook_title(c, F.lit("f metadata.json"))
    assert column(title, ['{"title":null}', '{"title":" "}', '{"title":5}', '{"title":"a","title":"b"}', "{}"]) == ["f", "", "5", "b", "f"]
    assert column(N.notebook_emoji, ['{"emoji":null}', '{"emoji":"x"}', "{}"]) == [None, "x", C.DEFAULT_EMOJI]
    assert column(N.is_notebook, ['{"emoji":null}', '{"title":{}}', '{"titles":1}', "{}"]) == [True, True, False, False]
    kind = lambda c: N.source_fields(c)["source_type"]
    assert column(kind, ['{"metadata":5}', '{"metadata":null}', '{"metadata":{"originalSourceContentType":"a","youtubeMetadata":[1]}}']) == [C.TYPE_UNKNOWN] * 2 + ["a"]


def test_a_text_is_parsed_once(spark):
    tree = spark.createDataFrame([("a", "b/x metadata.json", 0, b"{}", None)], "archive string, entry_path string, entry_no long, content binary, entry_error string")
    for found in (N.discover_notebooks(tree, "o"), N.discover_sources(tree), N.discover_artifacts(tree)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1 and "json_object_keys" not in plan and "get_json" not in plan


def test_totals_are_measured_while_tables_are_written(spark, tmp_path):
    rows = lambda n, cols: spark.createDataFrame([tuple(f"{c}{i % 3}" for c in cols) for i in range(n)], ", ".join(f"{c} string" for c in cols))
    sources = rows(7, ["nb_key", "source_url"]).withColumn("source_url", F.when(F.col("nb_key") == "nb_key1", "").otherwise(F.col("source_url")))
    manifest = M.Manifest(rows(5, ["nb_key", "owner_email"]), sources, rows(2, ["nb_key"]), rows(0, ["nb_key"]), rows(1, ["archive"]))
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    watched = sources.mapInArrow(counted, sources.schema)
    K.write_manifest({**manifest.tables(), "sources": watched, "errors": manifest.errors}, None, str(tmp_path / "a"))
    assert reads.value == 7
    K.write_manifest(manifest.tables(), manifest.totals(), str(tmp_path / "b"))
    measured, scanned = (spark.read.json(str(tmp_path / x / "totals")).first().asDict() for x in "ab")
    assert measured == scanned and measured["total_urls_recovered"] == 5 and measured["total_errors"] == 1


def test_empty_lists_of_a_json_manifest_keep_their_columns(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"nb_key": "k", "title": "a", "sources": [], "notes": null}\n')
    found = R.read_manifest_json(spark, str(tmp_path / "one.json"))
    assert found.select("sources.title", "notes.content_text", "artifacts.artifact_type", "chunk").first() == ([], None, None, None)
