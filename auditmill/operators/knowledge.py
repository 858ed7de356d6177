"""The knowledge table: union of the corpora, numbering, records, writing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditmill import params as P
from auditmill.functions.lookup import to_csv
from auditmill.operators import versions
from auditmill.session import store
from auditmill.sources.onefile import write_lines

IN_PARTITION = (1 << 33) - 1


def union_sources(sources: Sequence[DataFrame]) -> DataFrame:
    """Rows of all corpora; `source_rank` keeps the order in which they are given."""
    ranked = [df.withColumn("source_rank", F.lit(i)) for i, df in enumerate(sources)]
    return reduce(DataFrame.unionByName, ranked)


def number_rows(df: DataFrame, order: Sequence[str], out: str = "idx") -> DataFrame:
    """Position of each row, from 0, in the given order, without a window over all rows.

    Rows are sorted by ranges and stored once, as columns, with the number of their range and their place in it; a row's
    position is its place plus the sizes of the ranges before. `order` must tell all rows apart. Only one number per
    range comes to the driver."""
    part, place, before = (_spare(df, name) for name in ("_part", "_place", "_before"))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({
        part: F.spark_partition_id(), place: F.monotonically_increasing_id().bitwiseAND(F.lit(IN_PARTITION))})
    stored = store(ranged)
    offsets, total = [], 0
    for number, count in stored.groupBy(part).count().orderBy(part).collect():
        offsets.append((number, total))
        total += count
    table = df.sparkSession.createDataFrame(offsets, f"{part} int, {before} bigint")
    return stored.join(F.broadcast(table), part).withColumn(out, F.col(before) + F.col(place)).drop(part, place, before)


def _spare(df: DataFrame, name: str) -> str:
    """The name, or a longer one that no column has."""
    while name in df.columns:
        name += "_"
    return name


def knowledge_id(source: Column, cwe_id: Column, idx: Column) -> Column:
    name = F.when(F.coalesce(cwe_id, F.lit("")) == "", "none").otherwise(cwe_id)
    return F.concat_ws("-", source, F.lower(F.replace(name, F.lit("-"), F.lit(""))), idx.cast("string"))


def to_records(numbered: DataFrame, limits: P.TextLimits = P.TextLimits()) -> DataFrame:
    """Stored form of knowledge rows that have an `idx`. Lists stay lists; `languages_csv` is
    the flat form for stores that have no lists."""
    return numbered.select(
        knowledge_id(F.col("source"), F.col("cwe_id"), F.col("idx")).alias("id"),
        F.col("text").alias("document"),
        "source",
        F.coalesce("cwe_id", F.lit("")).alias("cwe_id"),
        F.left("title", F.lit(limits.title)).alias("title"),
        F.coalesce(F.try_element_at("metadata", F.lit("severity_hint")), F.lit("")).alias("severity_hint"),
        "languages",
        to_csv(F.col("languages")).alias("languages_csv"),
        "examples",
    )


def count_by_source(df: DataFrame, column: str = "source") -> DataFrame:
    """Rows per source and in all (`total`)."""
    return (
        df.rollup(column).agg(F.count("*").alias("n"), F.grouping(column).alias("_all"))
        .select(F.when(F.col("_all") == 1, "total").otherwise(F.col(column)).alias(column), "n")
    )


def upsert(current: DataFrame, new: DataFrame, key: str = "id", version: str | None = None) -> DataFrame:
    """`current` with the rows of `new` put in by key. If `new` has a key more than once, the row of the highest
    `version` counts, without one the last in the order of `new`. Rows of `current` are only checked, never sorted."""
    rest = [c for c in new.columns if c != key]
    place = F.monotonically_increasing_id()  # rises along the rows
    numbered = new.select(key, F.struct(*rest).alias("_row"), (F.struct(version, place) if version else place).alias("_place"))
    latest = numbered.groupBy(key).agg(F.max_by("_row", "_place").alias("_row"))
    new = latest.select(key, "_row.*").select(*new.columns)
    kept = current.join(new.select(key), key, "left_anti")
    return kept.unionByName(new.select(*current.columns))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return versions.read(spark, path)


def has_rows(spark: SparkSession, path: str) -> bool:
    return versions.version(spark, path)[1] is not None and not read_table(spark, path).isEmpty()


def write_table(df: DataFrame, path: str, rebuild: bool = False) -> int:
    """Write the table unless it has rows already; `rebuild` replaces it in one step. Gives its row count."""
    spark = df.sparkSession
    if rebuild or not has_rows(spark, path):
        versions.replace(df, path)
    return read_table(spark, path).count()


def upsert_table(new: DataFrame, path: str, key: str = "id", version: str | None = None) -> int:
    """Put the rows of `new` into the table by key, as `upsert` does; gives its row count.

    The merged rows are written beside the table and replace it in one step: a run that is broken off leaves the table as
    it was, and a run that another writer has overtaken raises `TableChanged`."""
    spark = new.sparkSession
    number, folder = versions.version(spark, path)
    current = spark.read.parquet(folder) if folder else new.limit(0)
    versions.replace(upsert(current, new, key, version), path, after=number)
    return read_table(spark, path).count()


def peek(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def id_lines(ids: DataFrame, column: str = "cwe_id") -> DataFrame:
    """Lines of a JSON array of the distinct ids in text order, one id per line.

    Sorted by ranges, so the list is never held by one task. A comma stands before each id
    but the first, which is found by an aggregate. The ids are stored, as three steps read them."""
    distinct = store(ids.select(F.col(column).alias("id")).filter("id is not null").distinct())
    quoted = F.to_json(F.array("id"))
    bare = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    first = distinct.agg(F.min("id").alias("id")).filter("id is not null").withColumn("_first", F.lit(True))
    body = distinct.join(F.broadcast(first), "id", "left").select(
        F.lit(1).alias("part"), "id", F.concat(F.when(F.col("_first"), "  ").otherwise(", "), bare).alias("value"))
    edges = ids.sparkSession.createDataFrame([(0, "", "["), (2, "", "]")], "part int, id string, value string")
    return edges.unionByName(body).orderBy("part", "id").select("part", "id", "value")


def write_ids(ids: DataFrame, path: str, column: str = "cwe_id") -> None:
    """One JSON file; it is replaced only when the new one is whole."""
    write_lines(id_lines(ids, column).select("value"), path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids out of a JSON array, written on one line or on many."""
    found = F.regexp_extract_all("value", F.lit(r'"([^"]+)"'), F.lit(1))
    return spark.read.text(path).select(F.explode(found).alias("cwe_id")).distinct()
