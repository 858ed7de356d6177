"""A Spark data sink that makes one text file of ordered rows.

    df.orderBy(...).select("value").write.format("auditmill_file").mode("overwrite").option("path", path).save()

Each task writes its rows as lines to a part of its own beside the target; the commit puts the parts together in the order
of their partitions, which is that of a sorted table, and moves the result to its name. Until then the old file stays,
and a write that is broken off leaves it. The commit streams the parts in pieces of COPY_BYTES: one file has one writer.
"""

from __future__ import annotations

import hashlib
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyspark.cloudpickle
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

from auditmill.sources.trees import open_path

NAME = "auditmill_file"
COPY_BYTES = 1 << 23


@dataclass
class Part(D.WriterCommitMessage):
    number: int
    path: str
    rows: int


class OneFileWriter(D.DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path
        self.parts = f"{path}.{uuid.uuid4().hex}.parts"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId()
        path, rows = f"{self.parts}/{number:08d}-{uuid.uuid4().hex}", 0  # attempts of a task do not meet
        fs, inner = open_path(path)
        fs.create_dir(inner.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(inner, compression=None) as out:
            for batch in iterator:
                rows += batch.num_rows
                for value in batch.column(0).to_pylist():
                    out.write((value or "").encode() + b"\n")
        return Part(number, path, rows)

    def commit(self, messages: list[Part | None]) -> None:
        whole = f"{self.parts}/whole"
        fs, inner = open_path(whole)
        fs.create_dir(inner.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(inner, compression=None) as out:
            for part in sorted((m for m in messages if m), key=lambda m: m.number):
                with fs.open_input_stream(open_path(part.path)[1], compression=None) as source:
                    while piece := source.read(COPY_BYTES):
                        out.write(piece)
        target = open_path(self.path)[1]
        if fs.get_file_info(target).type == arrow_fs.FileType.Directory:
            raise IsADirectoryError(self.path)
        fs.move(inner, target)
        self._clear()

    def abort(self, messages: list[Part | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, inner = open_path(self.parts)
        if fs.get_file_info(inner).type == arrow_fs.FileType.Directory:
            fs.delete_dir(inner)


class OneFile(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> OneFileWriter:
        return OneFileWriter(self.options["path"])


def write_lines(lines: DataFrame, path: str) -> None:
    """Write the first column, a text, as the lines of one file, in the order of the table."""
    lines.sparkSession.dataSource.register(OneFile)
    lines.write.format(NAME).mode("overwrite").option("path", path).save()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            fs, inner = open_path(path)
            body, lines = hashlib.md5(usedforsecurity=False), 0
            with fs.open_input_stream(inner, compression=None) as source:
                while piece := source.read(COPY_BYTES):
                    body.update(piece)
                    lines += piece.count(b"\n")
            yield pa.RecordBatch.from_arrays([pa.array([body.hexdigest()]), pa.array([lines])], names=["body", "lines"])


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """(body, lines) of one file: its MD5 digest and its line ends. A digest needs the bytes in order, so one task streams
    them, COPY_BYTES at a time."""
    return spark.createDataFrame([(path,)], "path string").mapInArrow(_digests, "body string, lines bigint")


pyspark.cloudpickle.register_pickle_by_value(sys.modules[__name__])
