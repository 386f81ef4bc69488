"""Files that tasks write and read themselves, in a folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from quillgauge.session import shared_folder


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    make_folder(folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to a new folder under the shared one and read it from there.

    Like a checkpoint it cuts the lineage and outlives executors; packed in columns, it takes a
    fraction of a checkpoint's place.
    """
    path = f"{work_folder(df.sparkSession, name)}/data"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def make_folder(folder: str) -> None:
    system, path = place(folder)
    system.create_dir(path, recursive=True)


@contextmanager
def task_file(folder: str, name: str) -> Iterator[fs.FileSystem]:
    """Write a file whole or not at all: a repeated or doubled task replaces it by an equal one."""
    system, path = place(f"{folder}/{name}")
    context = TaskContext.get()
    attempt = context.taskAttemptId() if context else 0
    temporary = f"{path}.attempt-{attempt}-{uuid.uuid4().hex}"
    with system.open_output_stream(temporary) as out:
        yield out
    system.move(temporary, path)


def partition_number() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0
