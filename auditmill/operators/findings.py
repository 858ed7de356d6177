"""Checks on findings and removal of repeats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditmill import params as P

FINDING_KEY = ("cwe_id", "file_path", "line_start", "line_end")
SHARES = 128   # tasks that the findings of a heavy id are dealt to
HEAVY = 256    # an id with more than one in so many of the findings is heavy


def well_formed(severity: Column, confidence: Column) -> Column:
    """The schema's own bounds: a known severity, a confidence in [0, 1]."""
    return F.lower(severity).isin(*P.SEVERITIES) & confidence.between(0.0, 1.0)


def lines_valid(line_start: Column, line_end: Column) -> Column:
    return (line_start > 0) & (line_end >= line_start)


def known_ids(findings: DataFrame, ids: DataFrame, column: str = "cwe_id") -> DataFrame:
    """Findings whose id is in the dictionary. Spark broadcasts the ids if they are few."""
    return findings.join(ids.select(column), column, "left_semi")


def unknown_ids(findings: DataFrame, ids: DataFrame, column: str = "cwe_id") -> DataFrame:
    return findings.join(ids.select(column), column, "left_anti")


def keep_first(df: DataFrame, key: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """The first row per key by `seq`.

    An aggregate and no window over the key: each task keeps one row per key before the
    shuffle, so a key with very many copies costs no more than any other."""
    order = F.struct(*seq)
    rest = [c for c in df.columns if c not in key]
    first = df.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return first.select(*key, "_row.*").select(*df.columns)


def reject_reason(min_confidence: float, known: Column) -> Column:
    """Why a finding is dropped, by the first check it fails; null if it passes them all."""
    return (
        F.when(~known, "unknown_id")
        .when(~(F.col("confidence") >= min_confidence), "low_confidence")
        .when(~lines_valid(F.col("line_start"), F.col("line_end")), "bad_lines")
    )


def heavy_ids(findings: DataFrame) -> list[int]:
    """Hashes of the ids that more than one in HEAVY findings has; lighter ones may be among them, but at most HEAVY in all.

    One pass over the ids, run at once: each task keeps HEAVY counters, which lose against ids that have none, so the driver
    gets HEAVY numbers, however many ids there are."""
    return findings.select(F.xxhash64("cwe_id").alias("id")).freqItems(["id"], 1 / HEAVY).first()[0]


def check(findings: DataFrame, ids: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """All findings with severity in lower case and a `reason` (null if they pass).

    Few ids may have nearly all findings. These heavy ids come in SHARES copies, and the findings of one are dealt to its
    copies, so no task gets all of them. All other ids come once: there may be many, and Spark may broadcast them."""
    plain = [F.col(f.name) for f in findings.schema.fields if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType)]
    heavy = F.xxhash64("cwe_id").isin(*heavy_ids(findings))
    shares = F.when(heavy, F.sequence(F.lit(0), F.lit(SHARES - 1))).otherwise(F.array(F.lit(0)))
    copies = ids.select("cwe_id").distinct().select("cwe_id", F.lit(True).alias("_known"), F.explode(shares).alias("_share"))
    dealt = findings.withColumn("_share", F.when(heavy, F.pmod(F.xxhash64(*plain), F.lit(SHARES)).cast("int")).otherwise(0))
    marked = dealt.join(copies, ["cwe_id", "_share"], "left").drop("_share")
    known = F.coalesce(F.col("_known"), F.lit(False))
    return (
        marked.withColumn("severity", F.lower("severity"))
        .withColumn("reason", reject_reason(min_confidence, known))
        .drop("_known")
    )


def validate(
    findings: DataFrame, ids: DataFrame, seq: Sequence[str], min_confidence: float = 0.5
) -> DataFrame:
    """Findings that pass all checks, the first one of each key. Filters come before the
    removal of repeats, so a repeat of a dropped finding may stay."""
    good = known_ids(
        findings.filter(
            (F.col("confidence") >= min_confidence) & lines_valid(F.col("line_start"), F.col("line_end"))
        ),
        ids,
    )
    return keep_first(good.withColumn("severity", F.lower("severity")), FINDING_KEY, seq)


def reject_counts(checked: DataFrame) -> DataFrame:
    """Number of dropped rows per reason."""
    return checked.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
