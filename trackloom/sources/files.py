"""A sink of one file for each row, as a data source whose files appear when the whole job has succeeded.

A task writes its files under a folder of its own attempt, below ``_temporary``.
The driver moves them to their names once all tasks are done, and only those of
the attempts that Spark took; a job that fails, and attempts that were repeated,
leave nothing behind. A move that is repeated puts the same file there again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import ship_package

NAME = "trackloom_files"
#: Files that the driver moves at a time.
MOVED_TOGETHER = 16


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    where, top = fs.FileSystem.from_uri(folder)
    return where, top.rstrip("/")


def _write(where: fs.FileSystem, top: str, name: str, text: str | None, made: set[str]) -> None:
    path = f"{top}/{name}"
    parent = path.rpartition("/")[0]
    if parent not in made:
        where.create_dir(parent, recursive=True)
        made.add(parent)
    with where.open_output_stream(path) as out:
        out.write((text or "").encode())


@dataclass
class Written(WriterCommitMessage):
    """The folder of an attempt that wrote all its rows."""

    folder: str


class FilesWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        where, top = _opened(self.folder)
        task = TaskContext.get()
        own, made = f"{top}/_temporary/{self.job}/{task.partitionId()}-{task.taskAttemptId()}", set()
        for row in iterator:
            _write(where, own, row["name"], row["text"], made)
        return Written(own if made else "")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        where, top = _opened(self.folder)
        where.create_dir(top, recursive=True)
        made: set[str] = set()

        def move(item: tuple[str, str]) -> None:
            where.move(*item)

        with ThreadPoolExecutor(MOVED_TOGETHER) as own:
            for message in messages:
                if message is None or not message.folder:
                    continue
                found = where.get_file_info(fs.FileSelector(message.folder, recursive=True))
                moves = [(x.path, f"{top}/{x.path[len(message.folder) + 1:]}") for x in found if x.is_file]
                for _, path in moves:
                    parent = path.rpartition("/")[0]
                    if parent not in made:
                        where.create_dir(parent, recursive=True)
                        made.add(parent)
                list(own.map(move, moves))
        self._clear(where, top)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*_opened(self.folder))

    def _clear(self, where: fs.FileSystem, top: str) -> None:
        for folder in (f"{top}/_temporary/{self.job}", f"{top}/_temporary"):
            if where.get_file_info(folder).type == fs.FileType.Directory and (folder.endswith(self.job) or not where.get_file_info(fs.FileSelector(folder))):
                where.delete_dir(folder)


class FilesSink(DataSource):
    """Option: path, a URI that driver and executors can write. Rows have name, relative to it, and text."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FilesWriter(self.options["path"])


def write_files(named: DataFrame, folder: str) -> None:
    """``text`` of each row of ``named`` as a file ``name`` under ``folder``; a null text is an empty file. All of them appear, or none."""
    spark = named.sparkSession
    ship_package(spark)
    spark.dataSource.register(FilesSink)
    named.select(F.col("name").cast("string"), F.col("text").cast("string")).write.format(NAME).mode("append").option("path", folder).save()
