"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 10).

Each document draws an exponential key, -ln(u) / quality weight, from a hash of its id, so reruns agree. Within a
source documents are ordered by key. A source is taken whole as often as its target holds it (complete epochs); the
rest of the target is filled by documents in key order, whose sizes are prefix-summed up to the budget. The document
that crosses the budget is taken up to it, so a source's words meet its target to the word.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditmill.llm.draws import unit
from auditmill.llm.order import running_total
from auditmill.llm.words import WORD
from auditmill.session import store

WEIGHTS = (5.0, 2.0, 1.0)  # of the sources by code point, null last, repeating
MOST = 3                   # a target is at most so many times its source
SEED = 42
LEAST_QUALITY = 0.05


def quality_weight(text: Column) -> Column:
    """Between LEAST_QUALITY and 1: the share of lower-case letters and blanks; prose is near 1, tables and shouting low."""
    plain = F.regexp_count(text, F.lit(r"[\p{Ll}\x20]"))
    return F.greatest(F.lit(LEAST_QUALITY), F.coalesce(F.try_divide(plain, F.length(text)), F.lit(0.0)))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target): weights share the sum of all sizes, no target is above `most` times its source.

    The targets are min(most * size, level * weight) with one level for all: sources are met in the order of
    size / weight, and the first level that the source after it can hold is the one. One row a source goes in."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = (by_source.withColumn("weight", F.element_at(listed, (number % len(weights) + 1).cast("int")))
               .withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight")))
    every = Window.partitionBy()
    before = Window.orderBy("ratio", "source").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = weighed.withColumn("level", rest / left)
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level"))).over(every)
    return levels.withColumn("at", first["level"]).select(
        "source", "source_size", F.least("cap", F.col("at") * F.col("weight")).alias("target"))


def mix(documents: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, seed: int = SEED,
        id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """(id, size, source, source_size, target, taken, epochs, part) of each row.

    size counts the words of the text (null: 0); taken = epochs * size + part. A null source is a source of its own
    and comes last; null ids draw by their text. Repeated rows each count. An empty table gives an empty one."""
    text = F.col(text_column)
    drawn = F.coalesce(F.col(id_column).cast("string"), F.md5(text.cast("binary")), F.lit(""))
    key = -F.ln(unit(F.lit(seed), drawn)) / F.coalesce(quality_weight(text), F.lit(LEAST_QUALITY))
    rows = store(documents.select(
        F.col(id_column).alias("id"), F.col(source_column).alias("source"), F.xxhash64(text).alias("content"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        key.alias("key")))
    targets = store(source_targets(rows, weights, most))
    before = running_total(rows, "source", ["key", "id", "content"], "size", "before")
    named = targets.toDF("_s", "source_size", "target")
    joined = before.join(named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    part = F.least("size", F.greatest(F.lit(0).cast("long"), rest - F.col("before")))
    return (joined.withColumn("epochs", epochs.cast("long")).withColumn("part", part.cast("long"))
            .select(F.col("id").alias(id_column), "size", F.col("source").alias(source_column), "source_size", "target",
                    (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), "epochs", "part", "content"))


def mixture(documents: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, seed: int = SEED,
            id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The rows of the mix with the columns of `documents`: a document as often as its complete epochs, and once more
    if the rest of the target holds it or ends in it; in the latter case its text is cut after the words taken.

    Rows equal in id, source and text count as repeats of one document: they are numbered within each part of the table
    and by the counts of the parts before, so no task holds all of them. A null text has no words and stays null, very
    long texts are cut like others; other columns pass through whatever their names; an empty table gives an empty one."""
    taken = mix(documents, weights, most, seed, id_column, text_column, source_column)

    def keys(row_id: Column, source: Column, content: Column) -> list[Column]:
        parts = (row_id, source, content)
        return [F.xxhash64(*parts).alias("k1"), F.hash(*parts).alias("k2")]
    plan = (taken.filter("epochs > 0 OR part > 0").select(*keys(F.col(id_column), F.col(source_column), F.col("content")), "size", "epochs", "part")
            .groupBy("k1", "k2").agg(F.max("size").alias("size"), F.max("epochs").alias("epochs"), F.sum("part").alias("parts")))
    packed = documents.select(F.struct(*documents.columns).alias("row"), F.spark_partition_id().alias("p"),
                              *keys(F.col(id_column), F.col(source_column), F.xxhash64(text_column)))
    same = Window.partitionBy("k1", "k2", "p").orderBy(F.lit(0))
    rows = store(packed.withColumn("n", F.row_number().over(same) - 1))
    earlier = Window.partitionBy("k1", "k2").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("k1", "k2", "p").agg(F.count("*").alias("c"))
    starts = counts.select("k1", "k2", "p", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("start"))
    rows = rows.join(starts.join(plan, ["k1", "k2"]), ["k1", "k2", "p"]).withColumn("n", F.col("n") + F.col("start"))
    part = F.least("size", F.greatest(F.lit(0), F.col("parts") - F.col("n") * F.col("size")))
    rows = rows.withColumn("part", part.cast("long"))
    copies = F.col("epochs") + F.when(F.col("part") > 0, 1).otherwise(0)
    rows = rows.filter(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    text = F.col("row").getField(text_column)
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("part").cast("int")), "")
    is_cut = (F.col("copy") > F.col("epochs")) & (F.col("part") < F.col("size"))
    given = F.when(is_cut, cut).otherwise(text).alias(text_column)
    return rows.select(*[given if c == text_column else F.col("row").getField(c).alias(c) for c in documents.columns])
