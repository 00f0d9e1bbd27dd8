import random

from codexferry.llm import common


def brute(edges):
    part = {}
    root = lambda x: x if part.setdefault(x, x) == x else root(part[x])
    for a, b in edges:
        if a is not None and b is not None and a != b:
            low, high = sorted((root(a), root(b)))
            part[high] = low
    return {(x, root(x)) for x in part}


def tasks(spark, name, work):
    """What the work gives, and how many tasks it took."""
    spark.sparkContext.setJobGroup(name, name)
    found, tracker = work(), spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(name)]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return found, sum(s.numTasks for j in jobs for s in map(tracker.getStageInfo, j.stageIds) if s)


def test_few_links_take_few_tasks(spark, monkeypatch):
    draw = random.Random(5)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(300)] + [(900, k) for k in range(500, 560)] + [(None, 1), (3, 3), (7, None)]
    df = spark.createDataFrame(edges, "a long, b long")
    work = lambda: {tuple(r) for r in common.components(df).collect()}
    own = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # Spark itself broadcasts what it knows to be small.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(common, "FEW_LINKS", 0)
    shuffled, many = tasks(spark, "many", work)
    monkeypatch.undo()
    found, few = tasks(spark, "few", work)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", own)
    assert {x for x in brute(edges) if x[0] != x[1]} == found == shuffled
    assert few < many
