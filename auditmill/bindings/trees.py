"""Scans and sinks: files and tables that Spark writes from the given tables, read back by the library."""

import sys
import uuid
from functools import reduce

import pyspark.cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditmill.bindings.corpora import CLEANED, NAMES, RECORDS, RULES, SECTIONS, _marked, _record_text, _rule_files
from auditmill.bindings.registry import query, spread_table, sql_strip, table
from auditmill.functions.lookup import to_csv
from auditmill.operators import knowledge, versions
from auditmill.plans import index
from auditmill.session import bound_batches, shared_folder, store
from auditmill.sources import catalogue, files, guides, rules
from auditmill.sources import trees as trees_source


def _new_folder(spark):
    return f"{shared_folder(spark)}/auditmill/tree-{uuid.uuid4().hex}"


def _write_files(batches):
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            fs, inner = files.open_path(path.as_py())
            fs.create_dir(inner.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(inner) as out:
                out.write(content.as_buffer())  # the text's bytes as they lie in the batch
        yield batch.select(["path"])


def _write_tree(spark, texts):
    """Files of (rel_path, content) rows under a new folder, whose path it gives. Spark's writers choose names of
    their own, so tasks write the files; a task that is run again writes the same ones."""
    root = _new_folder(spark)
    placed = texts.select(F.concat(F.lit(f"{root}/"), "rel_path").alias("path"), "content")
    bound_batches(spark)
    placed.mapInArrow(_write_files, "path string").write.format("noop").mode("overwrite").save()
    return root


# --- Source files --------------------------------------------------------------------

SOURCE_TREE = """
tree AS (
  SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'src/d' WHEN 1 THEN 'node_modules/x/d' WHEN 2 THEN '_p/.h/d' WHEN 3 THEN 'tests/d'
                 WHEN 4 THEN 'd' ELSE 'a/' || doc_id || '/__init__' END
         || CASE doc_id % 6 WHEN 5 THEN '' ELSE doc_id::VARCHAR END || ['.py', '.PY', '.tsx', '.txt', '.c'][(1 + doc_id % 5)::INTEGER] AS rel_path,
         ['python', 'python', 'typescript', NULL, 'c'][(1 + doc_id % 5)::INTEGER] AS language, strlen(text) AS size_bytes,
         md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS content
  FROM documents),
known AS (SELECT * FROM tree WHERE language IS NOT NULL AND size_bytes <= 1048576),
fit AS (SELECT * FROM known WHERE doc_id % 6 NOT IN (1, 3) AND language <> 'c')
"""


def _source_tree(spark, sf):
    """(doc_id, rel_path, content): texts as files of several languages in several kinds of directories."""
    case, number = F.col("doc_id") % 6, F.col("doc_id").cast("string")
    endings = F.array(*[F.lit(e) for e in (".py", ".PY", ".tsx", ".txt", ".c")])
    ending = F.element_at(endings, (1 + F.col("doc_id") % 5).cast("int"))
    stem = (F.when(case == 0, F.concat(F.lit("src/d"), number)).when(case == 1, F.concat(F.lit("node_modules/x/d"), number))
            .when(case == 2, F.concat(F.lit("_p/.h/d"), number)).when(case == 3, F.concat(F.lit("tests/d"), number))
            .when(case == 4, F.concat(F.lit("d"), number)).otherwise(F.concat(F.lit("a/"), number, F.lit("/__init__"))))
    return spread_table(spark, sf, "documents", "doc_id", "text").select(
        "doc_id", F.concat(stem, ending).alias("rel_path"), F.col("text").alias("content"))


@query(f"""WITH {SOURCE_TREE}
SELECT 'tree' AS scan, rel_path, language, content, size_bytes FROM fit
UNION ALL SELECT 'flat', rel_path, language, content, size_bytes FROM fit WHERE NOT contains(rel_path, '/')
UNION ALL SELECT 'file', rel_path, language, content, size_bytes FROM known WHERE doc_id = (SELECT min(doc_id) FROM known WHERE doc_id % 6 = 1)""")
def loaded_files(spark, sf):
    """A tree with an ignore file, excluded directories, hidden names and `__init__` files: all of it, its top
    directory, and one file of an excluded directory by its path."""
    case, texts = F.col("doc_id") % 6, _source_tree(spark, sf)
    ignored = spark.createDataFrame([(".gitignore", "tests/\n*.c\n")], "rel_path string, content string")
    root = _write_tree(spark, texts.select("rel_path", "content").unionByName(ignored))
    small = F.octet_length("content") <= 1048576
    one = texts.filter((case == 1) & (F.col("doc_id") % 5 != 3) & small).agg(F.min_by("rel_path", "doc_id")).first()[0]
    scans = [("tree", files.load_files(spark, root)), ("flat", files.load_files(spark, root, recursive=False))]
    if one:
        scans.append(("file", files.load_files(spark, f"{root}/{one}")))
    out = None
    for name, found in scans:
        rows = found.select(F.lit(name).alias("scan"), F.substr("path", F.lit(len(root) + 2)).alias("rel_path"), "language",
                            F.md5("content").alias("content"), "size_bytes")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""WITH {SOURCE_TREE},
named AS (SELECT rel_path, len(string_split(rel_path, '/')) - 1 AS depth, lower(regexp_extract(rel_path, '\\.[a-zA-Z]+$')) AS suffix, size_bytes FROM tree)
SELECT suffix, depth::INTEGER AS depth, count(*) AS n, sum(size_bytes)::BIGINT AS size_bytes, min(rel_path) AS first_path
FROM named WHERE suffix IN ('.py', '.txt') AND size_bytes < 3000 AND depth <= 1 GROUP BY ALL""")
def listed_tree(spark, sf):
    """Names of a tree by the data source, with conditions on suffix, size and depth that it takes over where the session lets it."""
    root = _write_tree(spark, _source_tree(spark, sf).select("rel_path", "content"))
    before = spark.conf.get(trees_source.PUSHDOWN, None)
    spark.conf.set(trees_source.PUSHDOWN, "true")
    try:
        found = trees_source.listing(spark, root).filter("suffix IN ('.py', '.txt') AND size_bytes < 3000 AND depth <= 1")
        rows = store(found.groupBy("suffix", "depth").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("size_bytes"), F.min("rel_path").alias("first_path")))
    finally:
        spark.conf.unset(trees_source.PUSHDOWN) if before is None else spark.conf.set(trees_source.PUSHDOWN, before)
    return rows


# --- Corpora -------------------------------------------------------------------------


@query(f"""WITH {RULES}
SELECT cwe_id, 'Semgrep: r' || doc_id AS title, md5(text) AS body, languages, severity AS severity_hint
FROM chunks WHERE doc_id % 4 <> 3 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0""")
def rule_files(spark, sf):
    """Rule files of both endings at any depth, among other files, with tests by directory and by name; a second
    directory is missing."""
    number = F.regexp_extract("rel_path", r"r(\d+)\.yml$", 1).cast("bigint")
    ending = F.when(number % 4 == 3, ".txt").when(number % 4 == 2, ".yaml").otherwise(".yml")
    folder = F.when(number % 5 == 0, "tests/").otherwise("deep/er/")
    name = F.concat(F.when(number % 7 == 0, "test_").otherwise("r"), number.cast("string"))
    written = _rule_files(spark, sf).select(F.concat(folder, name, ending).alias("rel_path"), "content")
    root = _write_tree(spark, written)
    found = rules.read_rule_files(spark, root).unionByName(rules.read_rule_files(spark, f"{root}/missing"))
    return rules.knowledge(rules.explode_rules(found)).select(
        "cwe_id", "title", F.md5("text").alias("body"), to_csv(F.col("languages")).alias("languages"),
        F.col("metadata")["severity_hint"].alias("severity_hint"))


@query(rf"""WITH spoken AS (SELECT doc_id, source, CASE doc_id % 4 WHEN 1 THEN {sql_strip('text')} ELSE '' END AS message FROM documents),
texts AS (SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN CASE WHEN message = '' THEN '' ELSE 'Description: ' || message[1:600] END
                                   WHEN 2 THEN 'Vulnerable pattern:' || chr(10) || source WHEN 3 THEN 'Severity: info' ELSE '' END AS text FROM spoken)
SELECT 'Semgrep: r' || doc_id AS title, md5(text) AS body FROM texts WHERE text <> ''""")
def blank_rules(spark, sf):
    """Rules of which some have a message, some a pattern, some a severity and some nothing to say: these give no row."""
    kind, number = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    quoted = F.to_json(F.array("text"))
    says = (F.when(kind == 1, F.concat(F.lit(', "message": '), F.substring(quoted, F.lit(2), F.length(quoted) - 2)))
            .when(kind == 2, F.concat(F.lit(', "pattern": "'), "source", F.lit('"'))).when(kind == 3, ', "metadata_": 1, "severity": "INFO"')
            .otherwise(', "message": " \\n ", "patterns": [{"pattern-not": "x"}]'))
    rule = F.concat(F.lit('{"rules": [{"id": "r'), number, F.lit('", "languages": "python", "metadata": {"cwe": 5}'), says, F.lit("}]}"))
    root = _write_tree(spark, spread_table(spark, sf, "documents", "doc_id", "source", "text").select(F.concat(number, F.lit(".yml")).alias("rel_path"), rule.alias("content")))
    found = rules.knowledge(rules.explode_rules(rules.read_rule_files(spark, root)))
    return found.select("title", F.md5("text").alias("body"))


@query(rf"""WITH {SECTIONS},
cleaned AS (SELECT doc_id, section_no, title, {CLEANED} AS body FROM sections WHERE doc_id % 5 <> 0)
SELECT ['CWE-89', 'CWE-79', 'CWE-22', 'CWE-352', NULL, 'CWE-89'][(1 + doc_id % 6)::INTEGER] AS cwe_id,
       'OWASP: ' || replace({list(NAMES)!r}[(1 + doc_id % 6)::INTEGER] || '_' || doc_id, '_', ' ') || ' — ' || title AS title,
       md5(body[1:2000]) AS body FROM cleaned WHERE length(body) >= 50""")
def guide_files(spark, sf):
    """Guides read from their directory; files of other kinds beside them are no guides."""
    name = F.when(F.col("doc_id") % 5 == 0, F.regexp_replace("rel_path", r"\.md$", ".rst")).otherwise(F.col("rel_path"))
    root = _write_tree(spark, _marked(spark, sf).select(name.alias("rel_path"), "content"))
    found = guides.knowledge(guides.read_guides(spark, root))
    return found.select("cwe_id", "title", F.md5("text").alias("body"))


@query(f"""WITH {RECORDS},
placed AS (SELECT *, row_number() OVER (ORDER BY md5(doc_id::VARCHAR)) - 1 AS idx FROM chunks)
SELECT 'cwe-cwe' || doc_id || '-' || idx AS id, md5(text) AS document FROM placed""")
def catalogue_file(spark, sf):
    """Records in an order that is not that of their numbers, some without one, read from files and numbered."""
    docs = spread_table(spark, sf, "documents", "doc_id", "source", "lang", "text")
    nameless = F.when(F.col("doc_id") % 3 == 0, '<Weakness Name="no number"></Weakness>').otherwise("")
    record = F.concat(_record_text(), F.lit(catalogue.RECORD_END), nameless)
    root = _new_folder(spark)
    docs.orderBy(F.md5(F.col("doc_id").cast("string"))).select(record.alias("value")).write.text(root)
    rows = store(knowledge.union_sources([catalogue.knowledge(catalogue.parse_records(catalogue.read_catalogue(spark, root)))]))
    numbered = knowledge.number_rows(rows, ["source_rank", "order_path", "order_pos"])
    return knowledge.to_records(numbered).select("id", F.md5("document").alias("document"))


# --- Tables --------------------------------------------------------------------------


@query("""
SELECT 1::INTEGER AS step, o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL
UNION ALL SELECT 2, o_orderstatus, count(*) FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL
UNION ALL SELECT 3, o_orderstatus, count(*) FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL
UNION ALL SELECT 4, CASE o_orderstatus WHEN 'F' THEN 'X' ELSE o_orderstatus END, count(*) FROM orders GROUP BY ALL""")
def stored_table(spark, sf):
    """A table written, written again while filled, rebuilt, and merged with all orders by key: of each key of the
    new rows the highest version counts."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    path, steps = _new_folder(spark), []
    newer = orders.filter("status = 'F'").withColumn("status", F.lit("X")).withColumn("version", F.lit(2))
    merged = orders.withColumn("version", F.lit(1)).unionByName(newer)

    def seen(step):
        counts = knowledge.read_table(spark, path).groupBy("status").agg(F.count("*").alias("n"))
        steps.append(store(counts.select(F.lit(step).alias("step"), "status", "n")))

    finished = orders.withColumn("version", F.lit(1)).filter("status = 'F'")
    knowledge.write_table(orders.withColumn("version", F.lit(1)).filter("status = 'P'"), path)
    seen(1)
    knowledge.write_table(finished, path)
    seen(2)
    knowledge.write_table(finished, path, rebuild=True)
    seen(3)
    knowledge.upsert_table(merged, path, "id", "version")
    seen(4)
    return steps[0].unionByName(steps[1]).unionByName(steps[2]).unionByName(steps[3])


@query("""
WITH old AS (SELECT o_custkey AS id, o_orderpriority AS grade FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1),
new AS (SELECT o_custkey AS id, o_orderstatus AS grade FROM orders WHERE o_custkey % 3 <> 0
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) = 1)
SELECT 'merged' AS state, id, coalesce(n.grade, o.grade) AS grade FROM old o LEFT JOIN new n USING (id)
UNION ALL SELECT 'broken off', id, grade FROM old
UNION ALL SELECT 'overtaken', id, grade FROM old""")
def switched_table(spark, sf):
    """Rows merged by key without a version, of which the last in order counts; the table as readers see it while a
    replacement is written but not switched to, and after a second writer came too late."""
    orders = table(spark, sf, "orders")
    first = orders.groupBy(F.col("o_custkey").alias("id")).agg(F.min_by("o_orderpriority", "o_orderkey").alias("grade"))
    new = orders.filter("o_custkey % 3 <> 0").orderBy("o_totalprice", "o_orderkey").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("grade"))
    path, states = _new_folder(spark), []

    def seen(state):
        states.append(store(knowledge.read_table(spark, path).select(F.lit(state).alias("state"), "id", "grade")))

    knowledge.write_table(first, path)
    number, _ = versions.version(spark, path)
    versions.write_beside(new, path)
    seen("broken off")
    late = versions.write_beside(new, path)
    knowledge.write_table(first, path, rebuild=True)
    try:
        versions.switch(spark, path, late, number)
    except versions.TableChanged:
        seen("overtaken")
    knowledge.upsert_table(new, path)
    seen("merged")
    return reduce(DataFrame.unionByName, states)


@query("SELECT DISTINCT 'CWE-' || n_chars AS cwe_id FROM documents")
def read_id_list(spark, sf):
    """Ids written as a list and read again."""
    path = _new_folder(spark)
    ids = table(spark, sf, "documents").select(F.concat(F.lit("CWE-"), F.col("n_chars").cast("string")).alias("cwe_id"))
    knowledge.write_ids(ids, path)
    return knowledge.read_ids(spark, path)


@query("""
SELECT 'items-cwe' || item_id || '-' || (row_number() OVER (ORDER BY item_id) - 1) AS id, md5(text) AS document, 'items' AS source
FROM benchmark""")
def own_source(spark, sf):
    """A further corpus in the registry of an index build."""
    def items(session, path):
        return session.read.parquet(path).select(
            F.lit("items").alias("source"), F.concat(F.lit("CWE-"), F.col("item_id").cast("string")).alias("cwe_id"),
            F.lit("item").alias("title"), "text", F.array().cast("array<string>").alias("examples"),
            F.array(F.lit("go")).alias("languages"), F.create_map(F.lit("source"), F.lit("items")).alias("metadata"),
            F.lit("").alias("order_path"), F.col("item_id").cast("bigint").alias("order_pos"))

    built = index.collect_knowledge(spark, {"items": f"{sf}/benchmark.parquet"}, {**index.SOURCES, "items": items})
    return built.select("id", F.md5("document").alias("document"), "source")


pyspark.cloudpickle.register_pickle_by_value(sys.modules[__name__])
