"""Markdown guides as knowledge rows, one per section.

A guide is cut inside its own row by array functions, so no line is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditmill import params as P
from auditmill import schemas
from auditmill.functions.lookup import guide_weakness, mentioned
from auditmill.functions.text import clean_markup, stem, strip
from auditmill.sources.files import load_texts

# Only a newline ends a line here, whatever else the runtime may count as one.
HEADING = r"(?md)^## (.+)$"
TITLE = r"(?md)^# (.+)$"


def read_guides(spark: SparkSession, directory: str) -> DataFrame:
    """Markdown files directly in a directory; none if it is missing."""
    return load_texts(spark, directory, [".md"], recursive=False)


def _title_or(c: Column, default: str) -> Column:
    found = F.regexp_extract(c, TITLE, 1)
    return F.when(found != "", found).otherwise(F.lit(default))


def sections(text: Column) -> Column:
    """array<struct<title, body>> of a guide: the part before the first level-2 heading,
    then one entry per heading; the whole text if there is no heading. Empty ones are left out."""

    def entry(piece: Column) -> Column:
        is_section = piece.rlike(r"(?d)\A## .")
        intro = strip(piece)
        return F.when(
            is_section,
            F.struct(
                strip(F.regexp_extract(piece, HEADING, 1)).alias("title"),
                strip(F.regexp_replace(piece, r"(?d)\A## .+", "")).alias("body"),
            ),
        ).otherwise(
            F.struct(
                _title_or(intro, "Introduction").alias("title"),
                strip(F.regexp_replace(intro, r"(?d)\A# .+\n?", "")).alias("body"),
            )
        )

    pieces = F.split(text, r"(?md)(?=^## .)", -1)
    cut = F.filter(F.transform(pieces, entry), lambda s: s["body"] != "")
    whole = F.array(F.struct(_title_or(text, "Overview").alias("title"), text.alias("body")))
    return F.when(text.rlike(HEADING), cut).otherwise(whole)


def split_guides(files: DataFrame, limits: P.TextLimits = P.TextLimits()) -> DataFrame:
    """One row per section, cleaned, with its place in the guide; short sections are dropped.

    Cleaning and the length test come before the explode, so a section is cleaned once."""
    cleaned = F.transform(sections(F.col("content")), lambda s, i: F.struct(
        i.alias("section_no"), s["title"].alias("section_title"), clean_markup(s["body"]).alias("full")))
    kept = F.filter(cleaned, lambda s: F.length(s["full"]) >= limits.section_minimum)
    others = [c for c in files.columns if c != "content"]
    return files.select(*others, F.inline(kept)).withColumn("body", F.left("full", F.lit(limits.chunk_text))).drop("full")


def knowledge(files: DataFrame, limits: P.TextLimits = P.TextLimits()) -> DataFrame:
    """Knowledge rows of guides given as (path, rel_path, content)."""
    name = F.col("stem")
    shown = F.replace(F.replace(name, F.lit("_Cheat_Sheet"), F.lit("")), F.lit("_"), F.lit(" "))
    rows = split_guides(files, limits).withColumn("stem", stem(F.col("rel_path"))).withColumn("cwe_id", guide_weakness(name))
    return rows.select(
        F.lit("owasp").alias("source"),
        "cwe_id",
        F.concat(F.lit("OWASP: "), shown, F.lit(" — "), "section_title").alias("title"),
        F.col("body").alias("text"),
        F.array().cast("array<string>").alias("examples"),
        mentioned(F.col("body")).alias("languages"),
        F.create_map(
            F.lit("source"), F.lit("owasp"),
            F.lit("cwe_id"), F.coalesce("cwe_id", F.lit("")),
            F.lit("file"), name,
            F.lit("section"), F.col("section_title"),
        ).alias("metadata"),
        F.col("rel_path").alias("order_path"),
        F.col("section_no").cast("bigint").alias("order_pos"),
    ).to(schemas.KNOWLEDGE)
