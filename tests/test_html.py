import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from codexferry.bindings.adapters import text_line_blocks
from codexferry.functions import documents as D
from codexferry.operators.html import parse_html, parse_page


def texts(html):
    return [(t, level, x) for t, level, x in parse_page(html)[0]]


def test_blocks_in_document_order():
    html = "<h1>A</h1><h4>B</h4><p>C</p><ul><li>D</li></ul><pre>E</pre><blockquote>F</blockquote>"
    assert texts(html) == [
        ("heading", 1, "A"), ("heading", 4, "B"), ("paragraph", None, "C"),
        ("bullet", None, "D"), ("paragraph", None, "E"), ("paragraph", None, "F"),
    ]


def test_inline_text_is_joined_by_a_space():
    assert texts("<p>foo<b>bar</b>baz</p>") == [("paragraph", None, "foo bar baz")]
    assert texts("<p> a <!-- note --> b </p>") == [("paragraph", None, "a b")]
    assert texts("<p>a&amp;b &lt;x&gt; &#233; &nope; &copy;</p>") == [
        ("paragraph", None, "a&b <x> é &nope ©")
    ]


def test_nested_blocks_are_given_twice():
    assert texts("<ul><li>x<p>y</p></li></ul>") == [
        ("bullet", None, "x y"), ("paragraph", None, "y"),
    ]


def test_unclosed_paragraph_holds_what_follows():
    assert texts("<p>a<p>b</p>c") == [("paragraph", None, "a b c"), ("paragraph", None, "b")]
    assert texts("<div><p>a</div><p>b</p>") == [("paragraph", None, "a"), ("paragraph", None, "b")]


def test_unmatched_end_tag_is_ignored():
    assert texts("<p>a</b></div>b</p>") == [("paragraph", None, "a b")]


def test_hidden_text_does_not_count():
    html = "<p>a<script>var t='</p>';</script><style>p{}</style><template><b>q</b></template>b</p>"
    assert texts(html) == [("paragraph", None, "a b")]
    assert texts("<p><br/>x<hr>y<img src=q></p>") == [("paragraph", None, "x y")]


def test_empty_blocks_are_dropped_and_lines_are_the_fallback():
    assert texts("<p> </p>\n<div>one\n two </div>three") == [
        ("paragraph", None, "one"), ("paragraph", None, "two"), ("paragraph", None, "three"),
    ]
    assert texts("") == [] and texts(None) == []
    # one block is enough to switch the fallback off
    assert texts("loose<p>x</p>") == [("paragraph", None, "x")]


def test_links_in_document_order():
    html = """<A HREF="https://a/?x=1&amp;y=2">q</A><a>none</a><a href='rel'>z</a><!-- <a href="c"> -->
    <script>"<a href='no'>"</script><a href=" https://b ">"""
    assert parse_page(html)[1] == ["https://a/?x=1&y=2", "", "rel", " https://b "]


def test_parse_html_passes_columns_through(spark):
    df = spark.createDataFrame([(1, "<p>a b</p><a href='u'>", b"z"), (2, None, None)],
                               "id long, html string, raw binary")
    got = parse_html(df).withColumn("n", D.blocks_word_count(F.col("blocks"))).orderBy("id").collect()
    assert [b.text for b in got[0].blocks] == ["a b"] and got[0].hrefs == ["u"]
    assert got[0].n == 2 and bytes(got[0].raw) == b"z"
    assert got[1].blocks == [] and got[1].hrefs == [] and got[1].n == 0


def test_large_batches_go_out_in_pieces(spark):
    df = spark.range(50).selectExpr("id", "concat('<p>page ', id, '</p>') as html").coalesce(1)
    rows = parse_html(df, batch_chars=20).collect()
    assert {r.id: r.blocks[0].text for r in rows} == {i: f"page {i}" for i in range(50)}


def test_fallback_in_columns_matches_the_parser(column):
    text = "one\r\n two \x85\n\x1cthree "
    lines = column(text_line_blocks, [text])[0]
    assert [b.text for b in lines] == [x.strip() for x in text.splitlines() if x.strip()]


def test_character_reference_without_semicolon():
    assert texts("<p>a&amp</p>") == [("paragraph", None, "a&")]
    assert texts("<p>a &lt<b>x</b> &am</p>") == [("paragraph", None, "a < x &am")]


class Given:
    """Stands for a table: keeps the function that would run on its batches."""

    def __init__(self, *names):
        self.schema = StructType([StructField(name, StringType()) for name in names])

    def mapInArrow(self, fn, schema):
        return fn


def test_a_batch_of_many_pages_goes_out_in_small_pieces():
    """A task holds one piece of its result, not that of a whole batch."""
    links = "<a href='https://long.example/" + "x" * 10_000 + "'>"
    pages = [f"<p>{i}</p>" for i in range(1000)] + [f"<p>l</p>{links}"] * 300
    batch = pa.RecordBatch.from_arrays([pa.array(range(1300)), pa.array(pages)], names=["id", "html"])
    pieces = list(parse_html(Given("id", "html"))(iter([batch])))
    assert [i for p in pieces for i in p.column("id").to_pylist()] == [*range(1300)]
    assert max(p.num_rows for p in pieces) <= 256
    assert max(sum(map(len, sum(p.column("hrefs").to_pylist(), []))) for p in pieces) < (1 << 20) + 20_000
