import os

from pyspark.sql import functions as F

from codexferry.storage import CLEANUP, materialize, remove, scratch, together


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle")}


def test_shuffle_files_go_when_a_table_is_written(spark):
    before, own = shuffle_files(spark), spark.conf.get(CLEANUP, None)
    sums = lambda n: spark.range(1000).groupBy((F.col("id") % n).alias("k")).agg(F.sum("id").alias("s"))
    one = materialize(sums(7).join(sums(5).select("k"), "k"))
    two = together(lambda: materialize(sums(11)), lambda: materialize(sums(13)))
    assert (one.count(), [t.count() for t in two]) == (5, [11, 13])
    del one, two
    one = materialize(sums(3))
    assert one.count() == 3 and spark.conf.get(CLEANUP, None) == own
    made = shuffle_files(spark) - before
    # What is left comes from the three kinds of counts above, none from a write.
    assert len({f.split("_")[1] for f in made}) <= 4


def test_scratch_tables_are_removed(spark):
    folder = scratch(spark)
    first = materialize(spark.range(10), f"{folder}/a")
    second = materialize(first.where("id > 3"))
    remove(spark, folder)
    assert second.count() == 6
    assert not os.path.exists(folder.removeprefix("file:"))
