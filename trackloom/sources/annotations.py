"""Annotation formats as tables of boxes: image_id, order, x, y, w, h (and what the format has besides)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels

#: Names of persons in each format, as the data sets spell them.
PERSON_NAMES = ("person", "pedestrian", "people", "human")
CITY_NAMES = ("pedestrian", "person")
RIDER_NAMES = ("rider", "bicyclist", "motorcyclist")


def read_ndjson(spark: SparkSession, path: str, visible: bool = False) -> DataFrame:
    """Lines of {ID, gtboxes}: persons only, by their full box; with ``visible`` by the visible one, or else the full one."""
    df = spark.read.schema("ID string, gtboxes array<struct<tag:string,fbox:array<int>,vbox:array<int>>>").json(path)
    rows = df.where("ID is not null").select(F.col("ID").alias("image_id"), F.posexplode("gtboxes").alias("order", "b")).where("b.tag = 'person'")
    box = F.coalesce("b.vbox", "b.fbox") if visible else F.col("b.fbox")
    return rows.select("image_id", "order", *[F.element_at(box, i + 1).alias(c) for i, c in enumerate("xywh")]).where("x is not null")


def _files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document in each file under ``path``, with its stem as image_id and its folder's name as city."""
    file = F.col("_metadata.file_path")
    df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return df.withColumns({"image_id": labels.stem(file), "city": labels.folder(file)})


def read_city_json(spark: SparkSession, path: str, skip_occluded: bool = False) -> DataFrame:
    """A file for each image, with a list of labelled boxes; heights and widths default to 1024 and 2048.

    ``skip_occluded`` leaves out boxes that are marked with 1.
    """
    box = "array<struct<lbl:string,bbleft:double,bbtop:double,bbwidth:double,bbheight:double,occl:double>>"
    df = _files(spark, path, f"imgHeight int, imgWidth int, annotation struct<list:{box}>")
    size = [F.coalesce("imgWidth", F.lit(2048)).alias("width"), F.coalesce("imgHeight", F.lit(1024)).alias("height")]
    rows = df.select("image_id", "city", *size, F.posexplode("annotation.list").alias("order", "b")).where(F.lower("b.lbl").isin(*CITY_NAMES))
    if skip_occluded:
        rows = rows.where(F.coalesce("b.occl", F.lit(0.0)) != 1)
    sides = [F.coalesce(f"b.{name}", F.lit(0.0)).alias(c) for c, name in zip("xywh", ("bbleft", "bbtop", "bbwidth", "bbheight"))]
    return rows.select("image_id", "city", "order", *sides, "width", "height")


def read_corner_json(spark: SparkSession, path: str, riders: bool = False, most_occluded: float = 1.0) -> DataFrame:
    """A file for each image, with children whose ``pos`` is [x0, y0, x1, y1].

    Identities count in any case; children without four numbers, and files
    without the image's size, have no boxes.
    """
    child = "struct<identity:string,pos:array<double>,occluded:double>"
    df = _files(spark, path, f"imagewidth int, imageheight int, children array<{child}>").where("imagewidth is not null and imageheight is not null")
    rows = df.select("image_id", "city", F.col("imagewidth").alias("width"), F.col("imageheight").alias("height"), F.posexplode("children").alias("order", "b"))
    wanted = CITY_NAMES + (RIDER_NAMES if riders else ())
    rows = rows.where(F.lower("b.identity").isin(*wanted) & (F.coalesce("b.occluded", F.lit(0.0)) <= most_occluded) & (F.size("b.pos") >= 4))
    x0, y0, x1, y1 = (F.element_at("b.pos", i + 1) for i in range(4))
    return rows.select("image_id", "city", "order", x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"), "width", "height")


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """images, annotations and categories of one document joined: boxes of the person category, or of the first if none has its name."""
    image, mark = "struct<id:long,width:int,height:int,file_name:string>", "struct<image_id:long,category_id:long,bbox:array<double>>"
    schema = f"images array<{image}>, annotations array<{mark}>, categories array<struct<id:long,name:string>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("document", F.col("_metadata.file_path"))
    named = F.filter("categories", lambda c: F.lower(c["name"]).isin(*PERSON_NAMES))
    wanted = doc.select("document", F.coalesce(F.get(named, F.lit(0))["id"], F.get("categories", F.lit(0))["id"]).alias("category_id"))
    images = doc.select("document", F.explode("images").alias("i"))
    images = images.select("document", F.col("i.id").alias("image"), labels.stem(F.col("i.file_name")).alias("image_id"), "i.width", "i.height")
    boxes = doc.select("document", F.posexplode("annotations").alias("order", "a"))
    boxes = boxes.select("document", "order", F.col("a.image_id").alias("image"), "a.category_id", "a.bbox")
    kept = boxes.join(wanted, ["document", "category_id"], "left_semi").join(images, ["document", "image"])
    return kept.select("document", "image_id", "order", *[F.element_at("bbox", i + 1).alias(c) for i, c in enumerate("xywh")], "width", "height")


def person_counts(spark: SparkSession, path: str) -> DataFrame:
    """Annotations of the person category in each document."""
    rows = read_coco(spark, path)
    return rows.groupBy("document").agg(F.count("*").alias("persons"), F.count_distinct("image_id").alias("images"))


def read_counted_text(spark: SparkSession, path: str, riders: bool = False, partial: bool = False) -> DataFrame:
    """Files whose first line counts the lines ``label x1 y1 x2 y2`` that follow.

    Pedestrians have label 1, riders 2, persons seen in part 3. Blank lines don't
    count; a file without a number in its first line is left out, and so are
    short lines.
    """
    df = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).withColumn("image_id", labels.stem(F.col("_metadata.file_path")))
    lines = df.withColumn("lines", F.filter(F.transform(F.split("value", "\\r?\\n"), lambda x: F.trim(x)), lambda x: x != ""))
    n = F.get("lines", F.lit(0)).try_cast("int")
    rows = lines.where(n.isNotNull()).select("image_id", n.alias("n"), F.posexplode("lines").alias("order", "line")).where("order between 1 and n")
    parts = rows.withColumn("p", F.split("line", "\\s+")).where("size(p) >= 5")
    number = lambda i: F.element_at("p", i + 1).try_cast("double")
    wanted = [1] + [2] * riders + [3] * partial
    sides = [number(1).alias("x"), number(2).alias("y"), (number(3) - number(1)).alias("w"), (number(4) - number(2)).alias("h")]
    return parts.where(F.element_at("p", 1).try_cast("int").isin(*wanted)).select("image_id", "order", *sides)


def image_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".jpg", ".jpeg", ".png", ".webp")) -> DataFrame:
    """Paths of images under a folder; their content is never read. The suffixes are those of one use; others add ``.bmp`` or leave out ``.webp``."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return df.where(labels.has_suffix(F.col("path"), suffixes)).withColumn("image_id", labels.stem(F.col("path")))


def first_existing(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Of candidates (name, path, priority) the existing one of lowest priority for each name."""
    return candidates.join(files.select("path"), "path", "left_semi").groupBy("name").agg(F.min_by("path", "priority").alias("path"))
