"""Files that appear when a job has succeeded."""

import os

import pytest
from pyspark.sql import functions as F

from trackloom.sources import files


def below(folder):
    return sorted(os.path.relpath(os.path.join(at, name), folder) for at, _, names in os.walk(folder) for name in names)


def named(spark, n=40):
    text = F.when(F.col("id") % 7 != 0, F.concat(F.lit("text "), F.col("id").cast("string")))
    return spark.range(n).select(F.concat(F.lit("part"), (F.col("id") % 3).cast("string"), F.lit("/f"), F.col("id").cast("string"), F.lit(".txt")).alias("name"), text.alias("text"), "id")


def test_files_appear_with_the_job(spark, tmp_path):
    files.write_files(named(spark).repartition(4), f"file://{tmp_path}/out")
    assert below(tmp_path / "out") == sorted(f"part{i % 3}/f{i}.txt" for i in range(40))
    assert (tmp_path / "out" / "part1" / "f1.txt").read_text() == "text 1" and (tmp_path / "out" / "part1" / "f7.txt").read_text() == ""
    files.write_files(named(spark, 2).withColumn("text", F.lit("new")), f"file://{tmp_path}/out")
    assert (tmp_path / "out" / "part1" / "f1.txt").read_text() == "new" and len(below(tmp_path / "out")) == 40
    files.write_files(named(spark).where("false"), f"file://{tmp_path}/none")
    assert below(tmp_path / "none") == []


def test_a_failing_task_leaves_no_file(spark, tmp_path):
    rows = named(spark).repartition(4)
    broken = rows.withColumn("text", F.when(F.col("id") == 33, F.raise_error(F.lit("no text"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="no text"):
        files.write_files(broken, f"file://{tmp_path}/out")
    assert below(tmp_path / "out") == []
