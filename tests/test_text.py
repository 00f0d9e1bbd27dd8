import html
from urllib.parse import quote

import pyarrow as pa
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codexferry.functions import text as T
from codexferry.functions.labels import artifact_label, origin_cell, source_type_label


def test_sanitize_filename(column):
    given_names = {
        'a<b>c:d"e/f\\g|h?i*j': "a_b_c_d_e_f_g_h_i_j",
        "  two   spaces　here  ": "two spaces here",
        "dots... . .": "dots",
        "...": "Untitled",
        "": "Untitled",
        "tab\there\x00\x1f": "tab_here__",
        "\x85x y": "x y",
        "é😀ß": "é😀ß",
        "a" * 200: "a" * 180,
        "😀" * 181: "😀" * 180,
        "a" * 179 + " b": "a" * 179 + " ",
    }
    assert column(T.sanitize_filename, list(given_names)) == list(given_names.values())


def test_sanitize_is_idempotent_below_the_limit(spark):
    names = st.lists(st.text(max_size=40), min_size=1, max_size=40)

    @settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
    @given(names)
    def check(values):
        values = [v for v in values if "\ud800" not in v]
        df = spark.createDataFrame([(v,) for v in values], "v string")
        once = df.select(T.sanitize_filename(F.col("v")).alias("a"))
        rows = once.select("a", T.sanitize_filename(F.col("a")).alias("b")).collect()
        assert all(r.a == r.b and r.a for r in rows)

    check()


def test_infer_owner_email(column):
    values = {
        "x/User.One+a@Old.Example/Export": "user.one+a@old.example",
        "takeout-user1@dom.com.zip": "takeout-user1@dom.com.zip",
        "first@a.com/second@b.com": "first@a.com",
        "no address": "Default@X",
        "": "Default@X",
    }
    got = column(lambda c: T.infer_owner_email(c, "Default@X"), list(values))
    assert got == list(values.values())
    assert column(T.strip_archive_affixes, ["takeout-user1@dom.com.zip"]) == ["user1@dom.com"]


def test_base_name_and_paths(column):
    assert column(T.base_name, ["A metadata.json", "b.html", "c.HTML", "x.html metadata.json"]) == [
        "A", "b", "c.HTML", "x.html",
    ]
    assert column(T.parent_dir, ["a/b/c", "a", "/a"]) == ["a/b", "", ""]
    assert column(T.file_name, ["a/b/c", "a", "a/"]) == ["c", "a", ""]


def test_word_count_and_strip_match_python(column):
    values = ["", " a  b ", "x y\x1cz", "　é ü\n\n", "one"]
    assert column(T.word_count, values) == [len(v.split()) for v in values]
    assert column(T.strip_space, values) == [v.strip() for v in values]


def test_xml_text_matches_html_escape(column):
    values = ["<a href='x'>\"&amp;</a>", "a\x00b\x08c\td\ne\x0bf\x1fg", "plain é"]
    control = {i: None for i in range(32) if i not in (9, 10, 13)}
    assert column(T.xml_text, values) == [html.escape(v.translate(control)) for v in values]


def test_percent_encode_matches_quote(column):
    values = ["a b/c+d*e~f", "é/ü%20", "x@y.com/Sub & More/(1).docx", "-_.!'"]
    assert column(T.percent_encode_path, values) == [quote(v) for v in values]


def test_labels(column, spark):
    assert column(
        source_type_label,
        ["SOURCE_CONTENT_TYPE_URL", "SOURCE_CONTENT_TYPE_YOUTUBE_VIDEO", "SOURCE_CONTENT_TYPE_PDF",
         "SOURCE_CONTENT_TYPE_POWERPOINT", "SOURCE_CONTENT_TYPE_SOURCE_CONTENT_TYPE_X", "OTHER"],
    ) == ["🌐 Website URL", "▶️ YouTube Video", "📕 PDF Document", "📊 PowerPoint",
          "📄 SOURCE_CONTENT_TYPE_X", "📄 OTHER"]
    assert column(
        lambda c: artifact_label(F.lit("T"), c), ["ARTIFACT_TYPE_QUIZ", "APP_TYPE_MAP", "PLAIN"]
    ) == ["T (QUIZ)", "T (MAP)", "T (PLAIN)"]
    assert column(origin_cell, ["", "http://a"]) == ["_Uploaded File_", "[http://a](http://a)"]


def test_documents_are_packed_in_small_pieces():
    """A task does not hold the packed documents of a whole batch."""
    from codexferry.operators.docx import render_docx
    from tests.test_html import Given

    batch = pa.RecordBatch.from_arrays(
        [pa.array(map(str, range(600))), pa.array(["<w:p/>"] * 600)], names=["path", "document_xml"]
    )
    pieces = list(render_docx(Given("path", "document_xml"))(iter([batch])))
    assert [p.num_rows for p in pieces] == [256, 256, 88]
    assert [x for p in pieces for x in p.column("path").to_pylist()] == [str(i) for i in range(600)]
