"""Knowledge base build: corpora in, knowledge table and id dictionary out."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from auditmill import params as P
from auditmill.operators import hooks, knowledge
from auditmill.session import store
from auditmill.sources import catalogue, guides, rules

Builder = Callable[[SparkSession, str], DataFrame]


def catalogue_source(spark: SparkSession, path: str, limits: P.TextLimits = P.TextLimits()) -> DataFrame:
    return catalogue.knowledge(catalogue.parse_records(catalogue.read_catalogue(spark, path), limits), limits)


def guides_source(spark: SparkSession, path: str, limits: P.TextLimits = P.TextLimits()) -> DataFrame:
    return guides.knowledge(guides.read_guides(spark, path), limits)


def rules_source(spark: SparkSession, path: str, limits: P.TextLimits = P.TextLimits()) -> DataFrame:
    return rules.knowledge(rules.explode_rules(rules.read_rule_files(spark, path)), limits)


# A further corpus is one more entry: a function from its path to rows of the knowledge schema.
SOURCES: dict[str, Builder] = {
    "cwe": catalogue_source,
    "owasp": guides_source,
    "semgrep": rules_source,
}


def collect_knowledge(spark: SparkSession, paths: Mapping[str, str], sources: Mapping[str, Builder] = SOURCES,
                      limits: P.TextLimits = P.TextLimits()) -> DataFrame:
    """Knowledge records of all corpora that have a path, in the order of the registry."""
    own = (catalogue_source, guides_source, rules_source)
    built = [build(spark, paths[name], limits) if build in own else build(spark, paths[name]) for name, build in sources.items() if name in paths]
    # Sorting by ranges reads its input twice; stored rows are not parsed again for it.
    rows = store(knowledge.union_sources(built))
    numbered = knowledge.number_rows(rows, ["source_rank", "order_path", "order_pos"])
    return knowledge.to_records(numbered, limits)


def build_knowledge_base(
    spark: SparkSession,
    paths: Mapping[str, str],
    table_path: str,
    ids_path: str,
    embedder: hooks.Embedder,
    rebuild: bool = False,
    params: P.AuditParams = P.AuditParams(),
    sources: Mapping[str, Builder] = SOURCES,
    merge: bool = False,
) -> int:
    """Build and write the knowledge table unless it has rows; gives its row count.

    `rebuild` replaces the rows of a filled table, `merge` puts the new ones in by id."""
    if not (rebuild or merge) and knowledge.has_rows(spark, table_path):
        return knowledge.read_table(spark, table_path).count()
    parsed = None
    if "cwe" in paths and sources.get("cwe") is catalogue_source:  # one parse for the rows and the ids
        parsed = store(catalogue.parse_records(catalogue.read_catalogue(spark, paths["cwe"]), params.limits))
        sources = {**sources, "cwe": lambda _spark, _path: catalogue.knowledge(parsed, params.limits)}
    records = store(collect_knowledge(spark, paths, sources, params.limits))
    if records.isEmpty():
        return 0
    embedded = hooks.embed(records, "document", embedder, params.embedding_dim, params.embed_batch)
    count = (knowledge.upsert_table(embedded, table_path) if merge and not rebuild
             else knowledge.write_table(embedded, table_path, rebuild=True))
    if parsed is not None:
        knowledge.write_ids(catalogue.valid_ids(parsed), ids_path)
    return count
