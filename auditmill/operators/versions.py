"""Tables that are replaced in one step.

A table is a folder of version folders and, under `_versions`, one numbered file per version that names its folder. Rows
are written to a new folder first; the numbered file comes last and makes them the table. A reader sees the old rows or
the new ones, never none or half, and a run that ends in between leaves the old ones. Two writers that start from the same
version cannot both finish: the second finds its number taken. Paths are those Spark can write to.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

POINTERS = "_versions"
KEEP = 2  # versions left after a switch, as readers may still be at the one before


class TableChanged(RuntimeError):
    """Another writer replaced the table meanwhile."""


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions, the newest first."""
    fs, place = _place(spark, f"{path.rstrip('/')}/{POINTERS}")
    names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
    return sorted((int(n) for n in names if n.isdigit()), reverse=True)


def _folder(spark: SparkSession, path: str, number: int) -> str:
    """The folder a version names; empty where its switch was broken off."""
    fs, place = _place(spark, f"{path.rstrip('/')}/{POINTERS}/{number:012d}")
    stream = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def version(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """(number, folder) of the table's rows as they are now; a folder of plain Parquet files is version 0."""
    numbers = _numbers(spark, path)
    last = numbers[0] if numbers else 0
    for number in numbers:
        if folder := _folder(spark, path, number):
            return last, f"{path.rstrip('/')}/{folder}"
    fs, place = _place(spark, path)
    plain = fs.exists(place) and any(s.getPath().getName().endswith(".parquet") for s in fs.listStatus(place))
    return last, path if plain else None


def read(spark: SparkSession, path: str) -> DataFrame:
    folder = version(spark, path)[1]
    if folder is None:
        raise FileNotFoundError(f"{path} holds no table")
    return spark.read.parquet(folder)


def write_beside(df: DataFrame, path: str) -> str:
    """Write the rows to a new version folder, which is not the table yet; gives its name."""
    folder = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path.rstrip('/')}/{folder}")
    return folder


def switch(spark: SparkSession, path: str, folder: str, after: int) -> None:
    """Make a version folder the table, if the table is still at number `after`."""
    fs, place = _place(spark, f"{path.rstrip('/')}/{POINTERS}/{after + 1:012d}")
    try:
        out = fs.create(place, False)
    except Exception as error:  # the file is there
        if fs.exists(place):
            raise TableChanged(f"{path} is at version {after + 1} already") from error
        raise
    try:
        out.write(folder.encode())
    finally:
        out.close()


def clear(spark: SparkSession, path: str, keep: int = KEEP) -> None:
    """Delete the rows of all but the newest versions. Their numbers stay, so that none is taken twice."""
    seen = 0
    for number in _numbers(spark, path):
        if not (folder := _folder(spark, path, number)):
            continue
        seen += 1
        fs, place = _place(spark, f"{path.rstrip('/')}/{folder}")
        if seen > keep and not fs.delete(place, True):
            break  # this one and those before went earlier


def replace(df: DataFrame, path: str, after: int | None = None, keep: int = KEEP) -> None:
    """Replace the table by the rows of `df`, which may be made from it. `after` is the version they were made from."""
    spark = df.sparkSession
    after = version(spark, path)[0] if after is None else after
    switch(spark, path, write_beside(df, path), after)
    clear(spark, path, keep)
