"""What written tables leave on disk."""
import time

from pyspark.sql import functions as F

from logweir.llm.scratch import written


def shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = manager.getAllFiles().iterator()
    names = set()
    while files.hasNext():
        names.add(files.next().getName())
    return {x for x in names if x.startswith("shuffle_")}


def test_shuffle_files_go_when_a_table_is_written(spark):
    before = shuffle_files(spark)
    out = written(spark.range(1000).withColumn("x", F.col("id") % 7).repartition("x").sortWithinPartitions("x"), "test")
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left and out.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None
