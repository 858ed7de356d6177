"""The corpus pipeline: quality rules, near duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows of the stage before and returns a DataFrame; all but the
last return the columns of `documents`. `run` stores each stage as Parquet and reads it again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditmill.llm import jaccard_join, mixing, personal, pieces, quality
from auditmill.session import store

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the plain rules or the robust distance reject go.

    A null or empty text fails the plain rules; repeated rows each count; a null language or source is a group like others;
    very long texts are counted whole; further columns pass through; an empty table stays empty."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id stays, of several with that id the one with the least
    hash; rows that share an id only are not copies. Rows with a null id are in no group and stay."""
    mark = F.xxhash64(*docs.columns, *[F.col(c).isNull() for c in docs.columns])
    first = jaccard_join.firsts(docs, mark).toDF("id", "mark")
    packed = docs.filter("doc_id IS NOT NULL").select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), mark.alias("mark"))
    kept = packed.join(first, ["id", "mark"], "left_semi").dropDuplicates(["id", "mark"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]).unionByName(docs.filter("doc_id IS NULL"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind. All rows stay; a null text stays null, an empty one empty, text
    without personal data as it is, whatever characters it holds; further columns pass through."""
    return _recounted(personal.redact(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents as often as they are taken.

    A null source is a source, a null text has no words; repeated rows each count; further columns pass through; an empty
    table stays empty."""
    return _recounted(mixing.mixture(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids and digests of the ids and of the decoded text of each row of the mix. A null text is empty; null ids
    and repeated rows are kept; further columns are left out; an empty table gives none."""
    import public_tokenizers
    return pieces.token_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules), ("near duplicates", near_duplicates), ("personal data", personal_data),
    ("source mix", source_mix), ("tokens", tokens)]

# The stages fit robust estimates, verify sketches and merge tokens: SQL cannot state their rows.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
