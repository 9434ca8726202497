"""Annotation datasets: conversion, balanced rotations, sweeps and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels


def yolo_labels(boxes: DataFrame, least_height: float = 0.0, clipped: bool = True, least_clipped_height: float = 0.0) -> DataFrame:
    """image_id and box shares for boxes (image_id, x, y, w, h, width, height, order), too small ones left out.

    With ``clipped`` the height is tested before the box is cut, boxes without
    area after cutting are left out, and so are images without boxes.
    ``least_clipped_height`` tests the height that the label's line tells, in
    pixels.
    """
    make = labels.normalized_box if clipped else labels.normalized_box_unclipped
    box = make(*[F.col(c).cast("double") for c in ("x", "y", "w", "h", "width", "height")])
    df = boxes.where((F.col("w") > 0) & (F.col("h") > 0) & (F.col("h") >= least_height)) if clipped else boxes
    df = df.withColumn("box", box)
    if clipped:
        df = df.where((F.col("box")["w"] > 0) & (F.col("box")["h"] > 0))
    if least_clipped_height > 0:
        df = df.where(F.format_string("%.6f", F.col("box")["h"]).cast("double") * F.col("height") >= least_clipped_height)
    return df.select("image_id", "order", "box.*")


def label_files(found: DataFrame) -> DataFrame:
    """One text for each image: its boxes' lines in order, with a line break between them. An image's boxes are few."""
    line = labels.label_line(F.struct("xc", "yc", "w", "h"))
    rows = found.select("image_id", F.struct("order", line.alias("line")).alias("r")).groupBy("image_id").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    return rows.select("image_id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text"))


def conversion_counts(images: DataFrame, annotations: DataFrame, files: DataFrame, found: DataFrame) -> DataFrame:
    """Converted images, images whose file is missing, and images without a usable box. All are tables with image_id."""
    present = images.select("image_id").join(files.select("image_id").distinct().withColumn("file", F.lit(True)), "image_id", "left")
    both = present.join(found.select("image_id").distinct().withColumn("usable", F.lit(True)), "image_id", "left")
    has = F.coalesce("file", F.lit(False))
    good = F.coalesce("usable", F.lit(False))
    counts = both.agg(F.count_if(has & good).alias("converted"), F.count_if(~has).alias("no_image"), F.count_if(has & ~good).alias("no_person"))
    return counts.join(F.broadcast(annotations.agg(F.count("*").alias("annotations"))))


def hash_order(path: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), path.cast("string")).cast("binary"))


def rotations(images: DataFrame, seed: int = 42) -> DataFrame:
    """Adds ``rotation`` to images (dataset, path, kind): night ones in chunks of at most as many as there are day ones; -1 for day ones, which belong to all.

    Each night dataset is shuffled by a hash and cut on its own; chunks are
    numbered over datasets in order. Without night images there is one rotation
    of the day ones. No day images is an error.

    An image's chunk comes from its rank by hash, in buckets of the hash whose
    sizes are carried over a small table, so no dataset is ranked in one task.
    """
    day = images.where(F.col("kind") == "day").count()
    if day == 0:
        raise ValueError("no day images to balance with")
    night = images.where(F.col("kind") == "night").withColumn("draw", hash_order(F.col("path"), seed))
    night = night.withColumn("part", F.substring("draw", 1, 3))
    sizes = night.groupBy("dataset", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("dataset").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    datasets = sizes.groupBy("dataset").agg(F.ceil(F.sum("n") / day).alias("chunks"))
    first = datasets.withColumn("first", F.coalesce(
        F.sum("chunks").over(Window.partitionBy(F.lit(0)).orderBy("dataset").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    ))
    ranked = night.withColumn("rn", F.row_number().over(Window.partitionBy("dataset", "part").orderBy("draw", "path")))
    placed = ranked.join(sizes.select("dataset", "part", "before"), ["dataset", "part"]).join(first.select("dataset", "first"), "dataset")
    chunk = F.floor((F.col("before") + F.col("rn") - 1) / day) + F.col("first")
    placed = placed.withColumn("rotation", chunk.cast("long")).select(*images.columns, "rotation")
    return images.where(F.col("kind") == "day").withColumn("rotation", F.lit(-1).cast("long")).unionByName(placed)


def rotation_report(rotated: DataFrame) -> DataFrame:
    """For each rotation its day and night images and the night's share in percent."""
    day = rotated.agg(F.count_if(F.expr("rotation = -1")).alias("day"))
    night = rotated.where("rotation >= 0").groupBy("rotation").agg(F.count("*").alias("night"))
    only = day.select(F.lit(0).cast("long").alias("rotation"), "day").join(F.broadcast(night.agg(F.count("*").alias("any"))).where("any = 0")).select("rotation", "day", F.lit(0).cast("long").alias("night"))
    out = night.join(F.broadcast(day)).select("rotation", "day", "night").unionByName(only)
    return out.withColumn("night_percent", F.round(F.col("night") * 100 / F.greatest(F.col("day") + F.col("night"), F.lit(1)), 1))


def rotation_members(rotated: DataFrame) -> DataFrame:
    """All images of each rotation: the day ones repeated for each, and its night chunk."""
    top = rotated.agg(F.greatest(F.max("rotation"), F.lit(0)).alias("top"))
    day = rotated.where("rotation = -1").drop("rotation").join(F.broadcast(top)).withColumn("rotation", F.explode(F.sequence(F.lit(0).cast("long"), "top"))).drop("top")
    return rotated.where("rotation >= 0").unionByName(day)


def capped(images: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` images in hash order: the feature is the cap."""
    return images.orderBy(hash_order(F.col("path"), seed), "path").limit(n)


def validation_set(images: DataFrame, from_each: int, datasets: int, seed: int = 42) -> DataFrame:
    """``from_each`` images for each of the data sets, in total and in hash order; all with 0."""
    return capped(images, from_each * datasets, seed) if from_each > 0 else images


def in_range(rotated: DataFrame, only: int | None = None, start_from: int = 0) -> DataFrame:
    """The rotation ``only``, or those from ``start_from`` on."""
    return rotated.where(F.col("rotation") == only) if only is not None else rotated.where(F.col("rotation") >= start_from)


def training_plan(rotated: DataFrame) -> DataFrame:
    """Rate and frozen layers by rotation, and each one's starting weights: what the one before leaves."""
    numbers = rotated.where("rotation >= 0").select("rotation").distinct()
    w = Window.partitionBy(F.lit(0)).orderBy("rotation")
    out = numbers.withColumn("weights_out", F.concat(F.lit("rot"), F.col("rotation").cast("string"), F.lit("/best.pt")))
    return out.withColumns({
        "lr": F.when(F.col("rotation") == 0, 0.001).otherwise(0.0005), "freeze": F.when(F.col("rotation") == 0, 10).otherwise(0),
        "weights_in": F.coalesce(F.last("weights_out", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit("base.pt"))
    })


def sweep_grid(spark, conf: list[float], iou: list[float], imgsz: list[int]) -> DataFrame:
    """All combinations of three short lists."""
    lists = spark.range(1).select(F.array(*map(F.lit, conf)).alias("a"), F.array(*map(F.lit, iou)).alias("b"), F.array(*map(F.lit, imgsz)).alias("c"))
    return lists.select(F.explode("a").alias("conf"), "b", "c").select("conf", F.explode("b").alias("iou"), "c").select("conf", "iou", F.explode("c").alias("imgsz"))


def remaining(grid: DataFrame, done: DataFrame) -> DataFrame:
    """Combinations that have no result yet."""
    return grid.join(done.select("conf", "iou", "imgsz").distinct(), ["conf", "iou", "imgsz"], "left_anti")


def verify(files: DataFrame, expected: DataFrame) -> DataFrame:
    """For each expected directory (subdir, at_least) its images and whether there are enough."""
    counted = files.groupBy("subdir").agg(F.count("*").alias("images"))
    return expected.join(counted, "subdir", "left").select(
        "subdir", F.coalesce("images", F.lit(0)).alias("images"), (F.coalesce("images", F.lit(0)) >= F.col("at_least")).alias("ok")
    )


def verdict(checks: DataFrame, by: str = "dataset") -> DataFrame:
    """Whether all checks (ok) of each data set hold, and of how many."""
    return checks.groupBy(by).agg(F.bool_and("ok").alias("ok"), F.count("*").alias("checks"), F.count_if(~F.col("ok")).alias("failed"))
