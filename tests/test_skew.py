"""One notebook and one owner hold most of everything; results stay whole."""

import pytest
from pyspark.sql import functions as F

from codexferry.operators import summary as S
from codexferry.plans import manifest as M

N = 3000


@pytest.fixture(scope="module")
def found(spark):
    """Root 0 holds two thirds of the sources; every notebook has a second copy."""
    hot = F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 40)
    copies = spark.range(80).select(
        F.concat(F.lit("r"), F.floor(F.col("id") / 40).cast("string"), F.lit("/"),
                 (F.col("id") % 40).cast("string")).alias("root_path"),
        F.lit("m").alias("nb_file"),
        F.concat(F.lit("k"), (F.col("id") % 40).cast("string")).alias("nb_key"),
        F.when(F.col("id") % 40 < 30, "big@o").otherwise("small@o").alias("owner_email"),
        F.concat(F.lit("F"), (F.col("id") % 40).cast("string")).alias("folder"),
        F.concat(F.lit("T"), (F.col("id") % 40).cast("string")).alias("title"),
    ).withColumn("sharepoint_folder", F.concat_ws("/", "owner_email", "folder"))
    sources = spark.range(N).select(
        F.explode(F.array(F.lit("r0/"), F.lit("r1/"))).alias("copy"), "id", hot.alias("root"),
    ).select(
        F.concat("copy", F.col("root").cast("string")).alias("root_path"),
        F.format_string("s%05d metadata.json", F.col("id")).alias("file"),
        # the second copy shares two of three titles
        F.concat(F.when((F.col("copy") == "r1/") & (F.col("id") % 3 == 1), "x").otherwise("s"),
                 F.col("id").cast("string")).alias("title"),
        F.when(F.col("id") % 2 == 0, "http://u").otherwise("").alias("source_url"),
        *[F.lit("").alias(c) for c in ("source_type", "added_timestamp", "youtube_url", "youtube_channel")],
        F.lit(1).cast("long").alias("word_count"),
        F.array().cast("array<struct<type:string,level:int,text:string>>").alias("blocks"),
    )
    notes = sources.limit(0).select(
        "root_path", "file", "title", F.lit("").alias("content_text"), "blocks"
    )
    artifacts = notes.select("root_path", "file", "title", F.lit("").alias("artifact_type"))
    return M.Extracted(copies, sources, notes, artifacts)


@pytest.mark.parametrize("max_group", [50, 1_000_000])
def test_hot_notebook_is_whole(spark, found, max_group):
    merged = M.merge(found, max_group=max_group)
    rows = merged.sources.select("nb_key", "position", "title", "copy_path", "file").collect()
    want = {}
    for s in sorted(found.sources.select("root_path", "file", "title").collect()):
        titles = want.setdefault("k" + s.root_path[3:], {})
        titles.setdefault(s.title, (s.root_path, s.file))
    got = {}
    for r in sorted(rows, key=lambda r: (r.nb_key, r.position)):
        got.setdefault(r.nb_key, []).append((r.title, (r.copy_path, r.file)))
    assert {k: list(v.items()) for k, v in want.items()} == got
    assert max(len(v) for v in got.values()) > N / 2
    for r in rows:
        assert 1 <= r.position <= len(got[r.nb_key])


def test_hot_owner_and_chunks(spark, found):
    empty = spark.createDataFrame(
        [], "gws_email string, m365_upn string, ge_target_email string, sharepoint_site_url string"
    )
    wide = M.map_owners(M.merge(found, max_group=50), empty, "/stage")
    books = wide.notebooks.withColumn("emoji", F.lit("e")).withColumn("metadata", F.lit("{}"))
    nested = S.attach_children(books, wide.sources, wide.notes, wide.artifacts, size=100)
    sizes = nested.where("nb_key = 'k0'").select("chunk", F.size("sources").alias("n")).collect()
    total = wide.sources.where("nb_key = 'k0'").count()
    assert max(r.n for r in sizes) == 100 and sum(r.n for r in sizes) == total
    assert len(sizes) == -(-total // 100)
    summary = S.user_summary(wide.notebooks, wide.sources, size=12)
    big = sorted(summary.where("gws_email = 'big@o'").collect(), key=lambda r: r.chunk)
    assert [len(r.notebooks) for r in big] == [12, 12, 6]
    assert {r.notebook_count for r in big} == {30}
    lines = S.index_lines(books, wide.sources).where("nb_key = 'k0'")
    assert lines.count() == total + 11 == lines.select("line_no").distinct().count()
