"""Figures on a run: how many rows each stage had, and how good a detector is."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def funnel(stages: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(step, stage, n) for each stage, in the given order."""
    counts = [
        df.agg(F.count("*").alias("n")).select(F.lit(i).alias("step"), F.lit(name).alias("stage"), "n")
        for i, (name, df) in enumerate(stages, 1)
    ]
    return reduce(DataFrame.unionByName, counts)


class Counters:
    """Row counts of stages, taken while the stages are computed for another purpose: no scan of their own.

    `observe` marks a table that is about to be stored; its counts are known when that has been done. Put marks above the
    last shuffle: rows of a task that is run again after a loss would count twice below it."""

    def __init__(self) -> None:
        self._seen: list[tuple[list[str], Observation]] = []

    def observe(self, df: DataFrame, **counts: Column) -> DataFrame:
        seen = Observation()
        self._seen.append((list(counts), seen))
        return df.observe(seen, *[column.alias(name) for name, column in counts.items()])

    def values(self) -> list[tuple[str, int]]:
        """(stage, rows) in the order of the marks; waits for a mark that no action has reached."""
        return [(name, seen.get.get(name, 0)) for names, seen in self._seen for name in names]

    def funnel(self, spark: SparkSession) -> DataFrame:
        rows = [(i, name, n) for i, (name, n) in enumerate(self.values(), 1)]
        return spark.createDataFrame(rows, "step int, stage string, n bigint")


def score(pairs: DataFrame, predicted: Column, actual: Column, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts, precision, recall and F1, for all rows or per group."""
    counted = pairs.groupBy(*by).agg(
        F.count_if(predicted & actual).alias("tp"),
        F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & actual).alias("fn"),
        F.count_if(~predicted & ~actual).alias("tn"),
    )
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return counted.withColumns({
        "precision": F.try_divide(tp, tp + fp),
        "recall": F.try_divide(tp, tp + fn),
        "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
    })
