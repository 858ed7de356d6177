"""Whole runs: texts as source files, benchmark items as knowledge, small stand-ins for the models."""

import json
import re
import sys

import pyspark.cloudpickle
from pyspark.sql import functions as F

from auditmill import params as P
from auditmill.bindings.corpora import LINES, _braced
from auditmill.bindings.registry import query, spread_table, table
from auditmill.operators import hooks, segment
from auditmill.plans import scan


def _toy_vectors(texts):
    return [[1.0 + len(t), 1.0 + t.count("e"), 1.0 + t.count("a")] for t in texts]


def _toy_review(messages):
    """One finding on the comment line of the code: its id is the number of e's in the comment.
    Comments without any give a broken reply."""
    line, comment = re.search(r"^ *(\d+) \|   // \}(.*)$", messages[-1]["content"], re.MULTILINE).groups()
    count = comment.count("e")
    if not count:
        return "nothing"
    return json.dumps({"findings": [{
        "cwe_id": f"CWE-{count}", "severity": "HIGH" if "@" in comment else "low", "title": comment[:40],
        "line_start": int(line), "line_end": int(line), "confidence": 0.9 if len(comment) % 2 == 0 else 0.4}]})


def _run(spark, sf):
    items = table(spark, sf, "benchmark").select(
        F.concat(F.lit("k-"), F.col("item_id").cast("string")).alias("id"), F.lit("cwe").alias("source"),
        F.concat(F.lit("CWE-"), F.col("item_id").cast("string")).alias("cwe_id"), F.lit("item").alias("title"),
        F.col("text").alias("document"), F.array().cast("array<string>").alias("examples"),
        F.array(F.lit("go"), F.lit("c")).alias("languages"))
    known = hooks.embed(items, "document", _toy_vectors, 3)
    ids = table(spark, sf, "nation").select(F.concat(F.lit("CWE-"), F.col("n_nationkey").cast("string")).alias("cwe_id"))
    files = _braced(spark, sf).withColumn("size_bytes", F.length("content").cast("bigint"))
    return scan.audit(files, known, ids, _toy_vectors, _toy_review, P.AuditParams(embedding_dim=3))


RUN = f"""{LINES},
found AS (SELECT 'src/' || doc_id AS file_path, 'CWE-' || (length(l) - length(replace(l, 'e', ''))) AS cwe_id,
                 CASE WHEN contains(l, '@') THEN 'high' ELSE 'low' END AS severity, l[1:40] AS title, 3 + 5 * i AS line_start,
                 length(l) - length(replace(l, 'e', '')) AS n, length(l) % 2 = 0 AS sure FROM lines WHERE contains(l, 'e')),
valid AS (SELECT * FROM found WHERE sure AND n IN (SELECT n_nationkey FROM nation))
"""


@query(f"""WITH {RUN}
SELECT file_path, cwe_id, severity, title, line_start::BIGINT AS line_start, '  // }}' || l AS code_snippet, 0.9::DOUBLE AS confidence
FROM valid JOIN (SELECT 'src/' || doc_id AS file_path, 3 + 5 * i AS line_start, l FROM lines) USING (file_path, line_start)""")
def audit_findings(spark, sf):
    return _run(spark, sf).findings.select(
        "file_path", "cwe_id", "severity", "title", "line_start", "code_snippet", "confidence")


@query(f"""WITH {RUN}
SELECT 1::INTEGER AS step, 'files' AS stage, count(*) AS n FROM documents UNION ALL SELECT 2, 'chunks', count(*) FROM lines
UNION ALL SELECT 3, 'raw', count(*) FROM found UNION ALL SELECT 4, 'valid', count(*) FROM valid""")
def audit_funnel(spark, sf):
    return _run(spark, sf).funnel()


@query(f"""WITH {RUN}
SELECT CASE WHEN n NOT IN (SELECT n_nationkey FROM nation) THEN 'unknown_id' ELSE 'low_confidence' END AS reason, count(*) AS n
FROM found WHERE NOT (sure AND n IN (SELECT n_nationkey FROM nation)) GROUP BY 1""")
def audit_rejects(spark, sf):
    return scan.reject_summary(_run(spark, sf))


def _tell_context(messages):
    """One finding per piece, that repeats the name of the piece and the first line of the notes it was given."""
    said = messages[-1]["content"]
    name = re.search(r"scope (\S+):", said)[1]
    notes = said.split("Reference notes:\n\n", 1)[1].split("\n\nSource (", 1)[0]
    line = int(re.search(r"^ *(\d+) \| ", said, re.MULTILINE)[1])
    return json.dumps({"findings": [{"cwe_id": "CWE-1", "severity": "low", "title": name, "description": notes, "line_start": line, "line_end": line, "confidence": 1}]})


@query(f"""WITH {LINES},
note AS (SELECT '[CWE-' || item_id || '] item' || chr(10) || text[1:40] AS note FROM benchmark ORDER BY item_id LIMIT 1)
SELECT 'src/' || doc_id AS file_path, 'f' || i AS title, (1 + 3 * i)::BIGINT AS line_start, md5(note) AS notes FROM lines, note""")
def audit_language(spark, sf):
    """A run over a language that the caller adds, with its own rule of what a function is, and with shorter notes than usual."""
    rule = segment.BracedLanguage(segment.BRACED["c"].blanks, (segment.Head("function", r"fn\s+(\w+)\s*\([^(){}]*\)[^{};]*\{"),))
    pieces = F.transform(F.split("text", "\n", -1), lambda line, i: F.concat(F.lit("fn f"), i.cast("string"), F.lit("(a: u8) -> u8 {\n  // "), line, F.lit("\n}")))
    files = spread_table(spark, sf, "documents", "doc_id", "text").select(
        F.concat(F.lit("src/"), F.col("doc_id").cast("string")).alias("path"), F.lit("rust").alias("language"), F.array_join(pieces, "\n").alias("content"))
    first = table(spark, sf, "benchmark").orderBy("item_id").limit(1)
    items = first.select(
        F.lit("k").alias("id"), F.lit("cwe").alias("source"), F.concat(F.lit("CWE-"), F.col("item_id").cast("string")).alias("cwe_id"), F.lit("item").alias("title"),
        F.col("text").alias("document"), F.array(F.lit("never shown")).alias("examples"), F.array(F.lit("rust")).alias("languages"))
    known = hooks.embed(items, "document", _toy_vectors, 3)
    ids = spark.createDataFrame([("CWE-1",)], "cwe_id string")
    params = P.AuditParams(embedding_dim=3, limits=P.TextLimits(prompt_body=40, prompt_examples=0))
    found = scan.audit(files.withColumn("size_bytes", F.length("content").cast("bigint")), known, ids, _toy_vectors, _tell_context, params, braced={"rust": rule}).findings
    return found.select("file_path", "title", "line_start", F.md5("description").alias("notes"))


pyspark.cloudpickle.register_pickle_by_value(sys.modules[__name__])
