"""Event logs, summaries, manifests and result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT_LOG = ("timestamp", "camera_name", "door_id", "door_name", "event", "track_id", "occupancy_after")


def event_log(events: DataFrame, doors: DataFrame | None = None) -> DataFrame:
    """The log's columns, with times cut to milliseconds."""
    if "door_name" in events.columns:
        df = events
    elif doors is not None:
        df = events.join(doors, "door_id", "left")
    else:
        df = events.withColumn("door_name", F.col("door_id"))
    time = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("timestamp")
    return df.select(time, "camera_name", "door_id", "door_name", "event", "track_id", F.col("occupancy").alias("occupancy_after"))


def append_event_log(log: DataFrame, path: str) -> None:
    """CSV files with a header under a folder for each day."""
    log.withColumn("event_date", F.substring("timestamp", 1, 10)).write.mode("append").partitionBy("event_date").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_manifests(members: DataFrame, path: str) -> None:
    """Image paths, one to a line, in a folder for each rotation."""
    spread = members.select("rotation", F.col("path").alias("value")).repartition("rotation", F.pmod(F.xxhash64("path"), F.lit(16)))
    spread.write.mode("overwrite").partitionBy("rotation").text(path)


def rotation_yaml(rotations: DataFrame, folder: str) -> DataFrame:
    """For each rotation the text of the data set's description: where its manifests are, and its one class."""
    total = rotations.agg(F.count("*").alias("total"))
    # fixed value: the description's layout
    layout = "# Rotation %d/%d\ntrain: %s/rotation=%d\nval: %s/val\nnc: 1\nnames:\n  0: person\n"
    number = F.col("rotation").cast("int")
    text = F.format_string(layout, number + 1, F.col("total").cast("int"), F.lit(folder), number, F.lit(folder))
    return rotations.join(F.broadcast(total)).select("rotation", text.alias("text"))  # one row


def read_sweep(spark: SparkSession, path: str) -> DataFrame:
    """Finished combinations of a results CSV with what they reached; malformed rows are skipped."""
    reader = spark.read.option("header", True).option("mode", "DROPMALFORMED").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    df = reader.csv(path)
    shape = {"conf": ("Conf", "double"), "iou": ("IOU", "double"), "imgsz": ("Img_Size", "int")}
    reached = {"precision": "Precision", "recall": "Recall", "map50": "mAP50", "map50_95": "mAP50-95"}
    shape |= {k: (v, "double") for k, v in reached.items() if v in df.columns}
    out = df.select(*[F.col(f"`{name}`").try_cast(kind).alias(k) for k, (name, kind) in shape.items()])
    return out.where("conf is not null and iou is not null and imgsz is not null")


def read_results(spark: SparkSession, project: str) -> DataFrame:
    """run, ``source`` and values (a map of strings) of each run's folder under ``project``.

    results.json counts where it can be parsed, otherwise the last line of
    results.csv under its stripped header. A run with neither has no row; one
    with broken ones only has an empty map.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "results.{json,csv}").load(project)
    rows = files.select(
        F.regexp_extract("path", r"([^/]+)/results\.[a-z]+$", 1).alias("run"), F.col("path").endswith(".json").alias("is_json"),
        F.col("content").cast("string").alias("text")
    )
    lines = F.filter(F.transform(F.split("text", "\\r?\\n"), lambda x: F.trim(x)), lambda x: x != "")
    cells = lambda line: F.transform(F.split(line, ","), lambda x: F.trim(x))
    head, last = cells(F.get(lines, F.lit(0))), cells(F.element_at(lines, -1))
    many = F.least(F.size(head), F.size(last))
    from_csv = F.when(F.size(lines) >= 2, F.map_from_arrays(F.slice(head, F.lit(1), many), F.slice(last, F.lit(1), many)))
    parsed = rows.withColumn("values", F.when(F.col("is_json"), F.from_json("text", "map<string,string>")).otherwise(from_csv))
    both = parsed.groupBy("run").agg(
        F.max(F.when(F.col("is_json"), F.to_json("values"))).alias("j"), F.max(F.when(~F.col("is_json"), F.to_json("values"))).alias("c")
    )
    source = F.when(F.col("j").isNotNull(), "json").when(F.col("c").isNotNull(), "csv").otherwise("none")
    return both.select("run", source.alias("source"), F.from_json(F.coalesce("j", "c", F.lit("{}")), "map<string,string>").alias("values"))


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def last_result(results: DataFrame, order: str = "epoch") -> DataFrame:
    """The row of the last epoch."""
    return results.agg(F.max_by(F.struct(*results.columns), order).alias("r")).select("r.*")


def frame_counts(detections: DataFrame) -> DataFrame:
    return detections.groupBy("camera_name", "frame_idx").agg(F.count("*").alias("detections"))


def chained_weights(log: DataFrame) -> DataFrame:
    """Adds the weights that each rotation starts from: the last ones an earlier rotation left."""
    w = Window.partitionBy(F.lit(0)).orderBy("rotation").rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("starts_from", F.last("weights_out", True).over(w))


def percent_report(metrics: DataFrame) -> DataFrame:
    """Shares as percentages of three decimals."""
    return metrics.select(*[F.round(F.col(c) * 100, 3).alias(c) for c in metrics.columns])
