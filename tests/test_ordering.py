import pytest
from pyspark.sql import functions as F

from codexferry.operators import ordering as O


@pytest.fixture(scope="module")
def skewed(spark):
    """6000 rows, two thirds of them under one key, some without a key."""
    k = F.when(F.col("id") % 3 < 2, F.lit(0)).when(F.col("id") % 7 > 0, F.col("id") % 50 + 1)
    return spark.range(6000).select(
        k.alias("k"), (F.col("id") * 7919 % 6000).alias("o"), F.col("id").alias("v")
    )


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.k, []).append((r.o, r.v))
    return {(k, v): i for k, g in groups.items() for i, (_, v) in enumerate(sorted(g), 1)}


@pytest.mark.parametrize("max_group", [100, 1_000_000])
def test_positions_match_brute_force(spark, skewed, max_group):
    got = O.number_rows(skewed, ["k"], ["o"], max_group=max_group).collect()
    want = brute(skewed.collect())
    assert len(got) == 6000 and {(r.k, r.v): r.position for r in got} == want


def test_a_hot_key_spans_several_tasks(spark, skewed):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = O.number_rows(skewed, ["k"], ["o"], max_group=100)
        tasks = numbered.where("k = 0").select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks > 1
        assert numbered.agg(F.max("position")).first()[0] == 4000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_global_positions(spark, skewed):
    rows = O.number_rows(skewed, [], ["o", "v"]).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(1, 6001))
    assert [(r.o, r.v) for r in rows] == sorted((r.o, r.v) for r in rows)


def test_chunks_hold_whole_keys(spark, skewed):
    numbered = O.number_rows(skewed, ["k"], ["o"], max_group=100)
    chunks = O.nest_chunks(numbered, ["k"], F.col("v"), size=250).collect()
    assert max(len(c["items"]) for c in chunks) == 250
    hot = sorted((c for c in chunks if c.k == 0), key=lambda c: c.chunk)
    assert len(hot) == 16
    want = [r.v for r in skewed.where("k = 0").orderBy("o").collect()]
    assert [v for c in hot for v in c["items"]] == want
    assert sum(len(c["items"]) for c in chunks) == 6000


def test_pairs_are_complete_and_spread(spark):
    left = spark.range(300).select(F.col("id").alias("a"))
    right = spark.range(40).select(F.col("id").alias("b"))
    paired = O.pair_all(left, right, ["a"], ["b"])
    assert paired.count() == 12000 == paired.distinct().count()
    plan = paired._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_one_row_meets_many_on_all_partitions(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("64", "false", "-1")):
            spark.conf.set(k, v)
        for n, m in ((1, 20_000), (20_000, 1), (300, 400), (3, 5)):
            left, right = spark.range(n).select(F.col("id").alias("a")), spark.range(m).select(F.col("id").alias("b"))
            paired = O.pair_all(left, right, ["a"], ["b"])
            sizes = [r["count"] for r in paired.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(sizes) == n * m
            if n * m > 1000:
                assert len(sizes) >= 48 and max(sizes) < n * m / 8
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
