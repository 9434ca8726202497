"""What every operator needs from the session: shared storage and shipped code."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "_trackloom_shipped"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application.

    Python workers then import it even where the repository is on no path of
    theirs. The archive holds only this package's source files.
    """
    sc = spark.sparkContext
    if getattr(sc, _SHIPPED, False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="trackloom-"), "trackloom_src.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("trackloom", os.path.relpath(full, top)))
    sc.addPyFile(archive)
    setattr(sc, _SHIPPED, True)


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only with a local master,
    as in tests, a temporary folder of this machine is used where that is unset;
    on a cluster that would lose what other machines write, so it is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = getattr(spark.sparkContext, "_trackloom_shared", None)
        if not found:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir is not set: name a folder there that driver and executors share")
            found = "file://" + tempfile.mkdtemp(prefix="trackloom-shared-")
            spark.sparkContext._trackloom_shared = found
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A folder name under the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is shuffled meanwhile is removed from the executors' disks with its job; else it stays until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there, and what was shuffled for it goes."""
    spark = df.sparkSession
    path = fresh_dir(spark, what)
    with _shuffles_removed(spark):
        df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.trackloom_path = path
    if own := _OPEN.get():
        own[-1].append(found)
    return found


#: Tables of the open ``scratch`` blocks, the innermost last; each thread has its own.
_OPEN: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("open", default=())


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Deletes what :func:`written` writes meanwhile, but for the tables that are put into the list.

    Those are left to the next outer ``scratch``, if there is one. Whatever
    reads a deleted table must have been written before.
    """
    kept: list[DataFrame] = []
    outer, own = _OPEN.get(), []
    token = _OPEN.set((*outer, own))
    try:
        yield kept
    finally:
        _OPEN.reset(token)
        dropped(*[t for t in own if all(t is not k for k in kept)])
        if outer:
            outer[-1].extend(kept)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that :func:`written` made, once nothing reads them any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.trackloom_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
