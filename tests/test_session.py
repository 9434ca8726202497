"""Tables that cut a lineage."""

import glob

from pyspark.sql import functions as F

from trackloom import session

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_a_written_table_leaves_no_shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*")}
    before, kept = files(), spark.conf.get(CLEANUP)
    found = session.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert not files() - before
    assert spark.conf.get(CLEANUP) == kept
    assert sorted((r.k, r["count"]) for r in found.collect()) == [(k, 143 if k < 6 else 142) for k in range(7)]
