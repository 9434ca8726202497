"""Ranks of many groups of queries are counted in rounds."""

import numpy as np

from trackloom.operators import metrics


def test_no_more_copies_of_the_gallery_than_tasks_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, int(p), i % 3, rng.normal(size=8).tolist()) for i, p in enumerate(rng.integers(0, 3, 240))]
    df = spark.createDataFrame(rows, "id long, pid long, cid long, embedding array<double>")
    queries, gallery = df.where("id < 90"), df.where("id >= 90")
    tables, written = [], metrics.written
    monkeypatch.setattr(metrics, "written", lambda table, what: tables.append((what, table)) or written(table, what))
    few = {tuple(r) for r in metrics.average_precisions(queries, gallery, 16).collect()}
    assert all(what != "average-precisions" for what, _ in tables)
    _, count = metrics.query_groups(queries, gallery, 40_000)
    at_once = spark.sparkContext.defaultParallelism
    tables.clear()
    many = {tuple(r) for r in metrics.average_precisions(queries, gallery, 16, 40_000).collect()}
    rounds = [table for what, table in tables if what == "average-precisions"]
    assert count > at_once and len(rounds) == -(-count // at_once)
    assert all(table.rdd.getNumPartitions() <= at_once for table in rounds)
    assert many == few and len(many) == 90
