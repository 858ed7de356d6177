"""Source trees as tables: names by the data source in `trees`, contents by tasks through Arrow's file systems.

Files that passed the tests on name and size are spread over tasks by their bytes before any content is read; contents
arrive as bytes and are decoded by column expressions.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
import pyspark.cloudpickle
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditmill import params as P
from auditmill import schemas
from auditmill.functions.lookup import file_language
from auditmill.functions.text import decode_text, suffix
from auditmill.session import bound_batches, store
from auditmill.sources.ignore import is_ignored
from auditmill.sources.trees import listing, open_path

READ_TARGET_BYTES = 128 * 1024 * 1024
READ_BATCH_BYTES = 4 * 1024 * 1024


def _info(path: str) -> arrow_fs.FileInfo:
    fs, inner = open_path(path)
    return fs.get_file_info(inner)


def path_exists(path: str) -> bool:
    return _info(path).type != arrow_fs.FileType.NotFound


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of each file, in batches of bounded size. Unreadable files give no row."""
    names = ["path", "rel_path", "size_bytes", "content"]
    types = [pa.string(), pa.string(), pa.int64(), pa.binary()]
    rows, held = [], 0
    for batch in batches:
        for path, rel_path, size in zip(*[batch.column(c).to_pylist() for c in names[:3]]):
            try:
                fs, inner = open_path(path)
                with fs.open_input_stream(inner) as stream:
                    data = stream.read()
            except OSError:
                continue
            rows.append((path, rel_path, size, data))
            held += len(data)
            if held >= READ_BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def read_listed(chosen: DataFrame) -> DataFrame:
    """Read the files of a listing, in as many tasks as their bytes call for. The listing is stored, as two steps need it."""
    stored = store(chosen.select("path", "rel_path", "size_bytes"))
    size = stored.agg(F.sum("size_bytes")).first()[0] or 0
    tasks = max(stored.sparkSession.sparkContext.defaultParallelism, -(-size // READ_TARGET_BYTES))
    bound_batches(stored.sparkSession)
    read = stored.repartition(tasks).mapInArrow(_read_files, "path string, rel_path string, size_bytes bigint, content binary")
    return read.withColumn("content", decode_text(F.col("content")))


def wanted(
    rel_path: Column,
    size_bytes: Column,
    languages: Sequence[str] | None = None,
    excluded: Sequence[str] = P.EXCLUDED_DIRECTORIES,
    ignore_lines: Iterable[str] = (),
    max_bytes: int = P.MAX_FILE_BYTES,
    extensions: Mapping[str, str] = P.EXTENSION_LANGUAGES,
) -> Column:
    """All conditions a file of a tree must meet. They need its name and size only."""
    allowed = list(languages or dict.fromkeys(extensions.values()))
    inside = F.arrays_overlap(F.split(rel_path, "/"), F.array(*[F.lit(d) for d in excluded]))
    return (
        (size_bytes <= max_bytes)
        & file_language(rel_path, extensions).isin(*allowed)
        & ~inside
        & ~is_ignored(rel_path, ignore_lines)
    )


def select_files(
    table: DataFrame,
    languages: Sequence[str] | None = None,
    ignore_lines: Iterable[str] = (),
    recursive: bool = True,
    max_bytes: int = P.MAX_FILE_BYTES,
    excluded: Sequence[str] = P.EXCLUDED_DIRECTORIES,
    extensions: Mapping[str, str] = P.EXTENSION_LANGUAGES,
) -> DataFrame:
    """The wanted rows of a table with `rel_path` and `size_bytes`, with their language."""
    keep = wanted(F.col("rel_path"), F.col("size_bytes"), languages, excluded, ignore_lines, max_bytes, extensions)
    if not recursive:
        keep = keep & ~F.contains(F.col("rel_path"), F.lit("/"))
    return table.filter(keep).withColumn("language", file_language(F.col("rel_path"), extensions))


def load_files(
    spark: SparkSession,
    root: str,
    recursive: bool = True,
    languages: Sequence[str] | None = None,
    max_bytes: int = P.MAX_FILE_BYTES,
    extensions: Mapping[str, str] = P.EXTENSION_LANGUAGES,
    excluded: Sequence[str] = P.EXCLUDED_DIRECTORIES,
) -> DataFrame:
    """Source files under a directory, or one single file, as (path, language, content, size_bytes).

    The ignore file at the root counts; a single file passes by it and by the excluded names.
    """
    info = _info(root)
    if info.type == arrow_fs.FileType.File:
        rows = [(root, info.base_name, info.size)]
        one = spark.createDataFrame(rows, "path string, rel_path string, size_bytes bigint")
        chosen = select_files(one, languages, max_bytes=max_bytes, excluded=("/",), extensions=extensions)
    else:
        ignore_lines: list[str] = []
        ignore_file = f"{root.rstrip('/')}/.gitignore"
        if path_exists(ignore_file):
            fs, inner = open_path(ignore_file)
            with fs.open_input_stream(inner) as stream:
                ignore_lines = stream.read().decode("utf-8", errors="ignore").splitlines()
        found = listing(spark, root, recursive, excluded, list(extensions), max_bytes)
        chosen = select_files(found, languages, ignore_lines, recursive, max_bytes, excluded, extensions)
    texts = read_listed(chosen.drop("language"))
    return texts.select("path", file_language(F.col("path"), extensions).alias("language"), "content", "size_bytes")


def load_texts(spark: SparkSession, root: str, suffixes: Sequence[str], recursive: bool) -> DataFrame:
    """Text files of a corpus with the given suffixes. A missing directory is an empty table."""
    if not path_exists(root):
        return spark.createDataFrame([], schemas.TEXT_FILES)
    found = listing(spark, root, recursive, suffixes=[s.lower() for s in suffixes])
    return read_listed(found.filter(suffix(F.col("rel_path")).isin(*suffixes)))


pyspark.cloudpickle.register_pickle_by_value(sys.modules[__name__])
