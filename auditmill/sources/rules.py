"""Rule files (YAML) as knowledge rows.

Python only turns a file into its rules (one JSON text each); everything after that works
on VARIANT columns.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator

import pandas as pd
import pyspark.cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditmill import params as P
from auditmill import schemas
from auditmill.functions.lookup import canonical_names, first_truthy, weakness_id
from auditmill.functions.text import join_parts, labelled, let, stem, strip
from auditmill.session import bound_batches
from auditmill.sources.files import load_texts


def read_rule_files(spark: SparkSession, directory: str) -> DataFrame:
    """Rule files at any depth; none if the directory is missing."""
    return load_texts(spark, directory, [".yml", ".yaml"], recursive=True)


def _rules_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml

    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    for batch in batches:
        rows = []
        for rel_path, path, content in zip(batch["rel_path"], batch["path"], batch["content"]):
            try:
                loaded = yaml.load(content, Loader=loader)
            except Exception:
                continue
            listed = loaded.get("rules") if isinstance(loaded, dict) else None
            for n, rule in enumerate(listed if isinstance(listed, list) else []):
                if isinstance(rule, dict):
                    rows.append((path, rel_path, n, json.dumps(rule, default=str, ensure_ascii=False)))
        yield pd.DataFrame(rows, columns=["path", "rel_path", "rule_no", "rule"])


def explode_rules(files: DataFrame) -> DataFrame:
    """One row per rule, `rule` as VARIANT. Files under or named `test*` are left out."""
    bound_batches(files.sparkSession)
    in_tests = F.exists(F.split("rel_path", "/"), lambda p: F.startswith(p, F.lit("test")))
    raw = files.filter(~in_tests).select("path", "rel_path", "content").mapInPandas(
        _rules_of, "path string, rel_path string, rule_no bigint, rule string")
    return raw.withColumn("rule", F.try_parse_json("rule"))


def _get(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def _shown(value: Column) -> Column:
    """A value as the rule's author would print it: null as None, truth values capitalised."""
    text = _get(value, "$", "string")
    return let(text, lambda t: F.when(F.is_variant_null(value), "None").when(F.schema_of_variant(value) == "BOOLEAN", F.initcap(t)).otherwise(t))


def _pattern_items(items: Column, text: Callable[[Column], Column], limits: P.TextLimits) -> Column:
    """Texts of the first items of a list, without the empty ones."""
    texts = F.transform(F.slice(items, 1, limits.rule_pattern_items), lambda i: F.coalesce(text(i), F.lit("")))
    return F.array_join(F.filter(texts, lambda t: t != ""), "\n")


def _alternative(item: Column) -> Column:
    """An item counts by its `pattern`, or where it has none by its `pattern-regex`."""
    return F.when(_get(item, "$.pattern").isNotNull(), _get(item, "$.pattern", "string")).otherwise(_get(item, "$['pattern-regex']", "string"))


def bound(rules: DataFrame) -> DataFrame:
    """The rules as columns: what is looked up in `rule` is looked up once, in one struct.

    A one-element explode keeps the struct a step of its own; without it Catalyst would copy every look-up into each
    filter and column that uses it."""
    rule = F.col("rule")
    texts = ["id", "message", "own_severity", "severity", "pattern"]
    paths = ["$.id", "$.message", "$.metadata.severity", "$.severity", "$.pattern"]
    listed = F.coalesce(_get(rule, "$.languages", "array<string>"), F.array_compact(F.array(_get(rule, "$.languages", "string"))))
    raw = F.struct(
        F.transform(F.array(*[_get(rule, p) for p in paths]), lambda v: F.when(v.isNotNull(), _shown(v))).alias("texts"),
        _get(rule, "$['pattern-either']", "array<variant>").alias("either"), _get(rule, "$.patterns", "array<variant>").alias("all"),
        listed.alias("listed"), _get(rule, "$.metadata.cwe").alias("cwe"), _get(rule, "$.metadata['cwe2022-top25']").alias("other_cwe"))
    others = [c for c in rules.columns if c != "rule"]
    flat = rules.select(*others, F.inline(F.array(raw)))
    return flat.select(*others, *[F.get("texts", F.lit(i)).alias(f"rule_{name}") for i, name in enumerate(texts)], "either", "all", "listed", "cwe", "other_cwe")


def chunk_text(message: Column, severity: Column, pattern: Column, limits: P.TextLimits = P.TextLimits()) -> Column:
    parts = [
        labelled("Description: ", F.left(message, F.lit(limits.rule_message))),
        labelled("Severity: ", severity),
        labelled("Vulnerable pattern:\n", F.left(pattern, F.lit(limits.rule_pattern))),
    ]
    return F.left(join_parts(parts, "\n\n"), F.lit(limits.chunk_text))


def knowledge(rules: DataFrame, limits: P.TextLimits = P.TextLimits()) -> DataFrame:
    """Knowledge rows of the rules that name a weakness and a supported language."""
    pattern = (
        F.when(F.col("rule_pattern").isNotNull(), F.col("rule_pattern"))
        .when(F.col("either").isNotNull(), _pattern_items(F.col("either"), _alternative, limits))
        .when(F.col("all").isNotNull(), _pattern_items(F.col("all"), lambda i: _get(i, "$.pattern", "string"), limits))
        .otherwise("")
    )
    given = F.struct(
        weakness_id(first_truthy(F.col("cwe"), F.col("other_cwe"))).alias("cwe_id"),
        canonical_names(F.col("listed"), P.RULE_LANGUAGES).alias("languages"),
        F.coalesce("rule_id", stem(F.col("path"))).alias("shown_id"),
        strip(F.coalesce("rule_message", F.lit(""))).alias("message"),
        F.lower(F.coalesce("rule_own_severity", "rule_severity", F.lit(""))).alias("severity"),
        pattern.alias("pattern"),
    )
    others = [c for c in rules.columns if c != "rule"]
    rows = (
        bound(rules).select(*others, F.inline(F.array(given)))
        .filter(F.col("cwe_id").isNotNull() & (F.size("languages") > 0))
        .withColumn("text", chunk_text(F.col("message"), F.col("severity"), F.col("pattern"), limits))
    )
    return rows.filter(strip(F.col("text")) != "").select(
        F.lit("semgrep").alias("source"),
        "cwe_id",
        F.concat(F.lit("Semgrep: "), "shown_id").alias("title"),
        "text",
        F.filter(F.array("pattern"), lambda p: p != "").alias("examples"),
        "languages",
        F.create_map(
            F.lit("source"), F.lit("semgrep"),
            F.lit("cwe_id"), F.col("cwe_id"),
            F.lit("rule_id"), F.col("shown_id"),
            F.lit("severity_hint"), F.when(F.col("severity") != "", F.col("severity")).otherwise("medium"),
            F.lit("file"), F.col("path"),
        ).alias("metadata"),
        F.col("rel_path").alias("order_path"),
        F.col("rule_no").alias("order_pos"),
    ).to(schemas.KNOWLEDGE)


pyspark.cloudpickle.register_pickle_by_value(sys.modules[__name__])
