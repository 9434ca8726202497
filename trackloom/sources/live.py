"""A live source of cameras' rows, as a streaming data source.

Offsets are frames by camera. What is there is what the cameras have sent since
the feed began, at the rate that each one reports (25 where that is impossible),
so offsets follow from the clock alone and go on after a restart. A micro-batch
reads each camera's new frames in a task of its own, a second of frames at a
time. A read that fails, or takes longer than the time allowed, is followed by a
new connection from the first frame that is missing; so rows come once. Five
reconnects in a row without a frame are allowed; the next failure ends the query.
A column ``reconnects``, if asked for, says how many it took in the task so far.

The feed that comes with it is a folder with the rows of each camera, which Spark
writes, and so can stand for recorded cameras. Its failures, for tests, are an
option: by camera and frame how often the connection is dropped or stalls there.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as ReadTimeout

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..functions import geo

NAME = "trackloom_live"
RECONNECTS, TIMEOUT_S, WAIT_S = 5, 2.0, 2.0


def stage_feed(rows: DataFrame, path: str, fps: DataFrame | None = None) -> None:
    """``rows`` (camera_name, frame_idx and other columns) as a feed that begins now; ``fps`` has camera_name and the rate that it reports."""
    rows.withColumn("camera", F.col("camera_name")).repartition("camera").sortWithinPartitions("camera", "frame_idx").write.partitionBy("camera").parquet(f"{path}/rows")
    known = rows.groupBy("camera_name").agg((F.max("frame_idx") + 1).alias("frames"))
    known = known.withColumn("fps", F.lit(None).cast("double")) if fps is None else known.join(fps.select("camera_name", F.col("fps").cast("double")), "camera_name", "left")
    known = known.select("camera_name", "frames", F.coalesce(geo.fps_or_default(F.col("fps")), F.lit(25.0)).alias("fps"), F.lit(time.time()).alias("began"))
    known.coalesce(1).write.parquet(f"{path}/index")


class Feed:
    """The rows of a staged folder; reading may fail where ``trouble`` says so."""

    def __init__(self, path: str, trouble: dict | None = None):
        self.fs, self.path = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        self.trouble = {c: {int(f): list(x) for f, x in found.items()} for c, found in (trouble or {}).items()}

    def index(self) -> list[dict]:
        return ds.dataset(f"{self.path}/index", filesystem=self.fs).to_table().to_pylist()

    def read(self, camera: str, low: int, high: int, timeout_s: float) -> pa.Table:
        """The rows of some frames."""
        for frame, left in self.trouble.get(camera, {}).items():
            if low <= frame < high and left[1] > 0:
                left[1] -= 1
                if left[0] == "drop":
                    raise ConnectionError(f"{camera} is gone at frame {frame}")
                time.sleep(2 * timeout_s)
        rows = ds.dataset(f"{self.path}/rows", filesystem=self.fs, partitioning=ds.partitioning(pa.schema([("camera", pa.string())]), flavor="hive"))
        return rows.to_table(filter=(ds.field("camera") == camera) & (ds.field("frame_idx") >= low) & (ds.field("frame_idx") < high))


class Frames(InputPartition):
    def __init__(self, camera: str, low: int, high: int, fps: float):
        super().__init__((camera, low, high))
        self.camera, self.low, self.high, self.fps = camera, low, high, fps


class LiveReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.columns = schema.fieldNames()
        self.path, self.speed = options["path"], float(options.get("speed", 1.0))
        self.trouble = json.loads(options.get("trouble", "{}"))
        self.reconnects = int(options.get("reconnects", RECONNECTS))
        self.timeout_s, self.wait_s = float(options.get("timeout_s", TIMEOUT_S)), float(options.get("wait_s", WAIT_S))
        self.cameras = {r["camera_name"]: r for r in Feed(self.path).index()}

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.cameras, 0)

    def latestOffset(self) -> dict:
        now = time.time()
        return {c: int(min(r["frames"], max(0.0, now - r["began"]) * r["fps"] * self.speed)) for c, r in self.cameras.items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Frames(c, start.get(c, 0), high, self.cameras[c]["fps"]) for c, high in end.items() if high > start.get(c, 0)]

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        feed, at, failed, total = Feed(self.path, self.trouble), partition.low, 0, 0
        with ThreadPoolExecutor(1) as own:
            while at < partition.high:
                until = min(partition.high, at + max(1, int(partition.fps)))
                try:
                    found = own.submit(feed.read, partition.camera, at, until, self.timeout_s).result(self.timeout_s)
                except (OSError, ReadTimeout) as problem:  # a ConnectionError is an OSError
                    failed += 1
                    if failed > self.reconnects:
                        raise ConnectionError(f"{partition.camera}: no frame after {self.reconnects} reconnects") from problem
                    total += 1
                    time.sleep(self.wait_s)
                    continue
                at, failed = until, 0
                if "reconnects" in self.columns:
                    found = found.append_column("reconnects", pa.array([total] * found.num_rows, pa.int32()))
                yield from found.select(self.columns).to_batches()

    def commit(self, end: dict) -> None:
        """Frames stay in the feed."""

    def stop(self) -> None:
        pass


class LiveSource(DataSource):
    """Options: path, speed (of a recorded feed), reconnects, timeout_s, wait_s and trouble. The schema is the reader's own choice of the feed's columns."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return LiveReader(schema, self.options)


def live(spark: SparkSession, path: str, schema: StructType | str, **options) -> DataFrame:
    """The stream of a feed."""
    from ..session import ship_package

    ship_package(spark)
    spark.dataSource.register(LiveSource)
    return spark.readStream.format(NAME).schema(schema).options(path=path, **{k: str(v) for k, v in options.items()}).load()


def until_read(query, path: str, speed: float = 1.0) -> None:
    """Wait until a recorded feed has sent all its frames and they have been read, then stop the query."""
    end = max((r["began"] + r["frames"] / (r["fps"] * speed) for r in Feed(path).index()), default=0.0)
    try:
        while time.time() < end + 0.1 and query.isActive:
            time.sleep(0.1)
        query.processAllAvailable()
    finally:
        query.stop()
