"""Replies, checks, roll-ups and reports over the given tables."""

import uuid

from pyspark.sql import functions as F

from auditmill import params as P
from auditmill.bindings.registry import query, spread_table, sql_lines, table
from auditmill.functions import lookup
from auditmill.operators import evaluate, findings, replies, report
from auditmill.session import shared_folder, store
from auditmill.sources.onefile import read_digest

TIERS = (("critical", ("token = ", "password")), ("high", ("@",)), ("medium", ("license", "the ")))


@query("""
WITH s AS (SELECT CASE WHEN contains(t, 'token = ') OR contains(t, 'password') THEN 'critical' WHEN contains(t, '@') THEN 'high'
  WHEN contains(t, 'license') OR contains(t, 'the ') THEN 'medium' ELSE 'low' END AS severity
  FROM (SELECT lower(concat_ws(' ', source, text)) AS t FROM documents))
SELECT severity, count(*) AS n,
       CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END::INTEGER AS severity_rank
FROM s GROUP BY severity""")
def severity_rollup(spark, sf):
    guess = lookup.guess_severity(F.col("source"), F.col("text"), TIERS)
    return report.severity_counts(spread_table(spark, sf, "documents", "source", "text").select(guess.alias("severity"))).select(
        "severity", "n", "severity_rank")


@query("""
WITH r AS (SELECT *, date_trunc('hour', ts) AS hour,
  row_number() OVER (PARTITION BY user_id, event_type, date_trunc('hour', ts) ORDER BY event_id) AS rn FROM events)
SELECT event_id, user_id, event_type, epoch(hour)::BIGINT AS hour, value FROM r WHERE rn = 1""")
def first_of_repeats(spark, sf):
    hour = F.unix_timestamp(F.date_trunc("hour", F.col("ts").cast("timestamp")))
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type", hour.alias("hour"), "value")
    return findings.keep_first(rows, ["user_id", "event_type", "hour"], ["event_id"])


RAW_SQL = """
raw AS (
  SELECT 'CWE-' || l_partkey AS cwe_id, CASE l_returnflag WHEN 'A' THEN 'HIGH' WHEN 'R' THEN 'Critical' ELSE 'low' END AS severity,
         'Line of order ' || l_orderkey || ' from supplier ' || l_suppkey AS title, l_linestatus AS description,
         l_linenumber::BIGINT AS line_start, (l_linenumber + l_quantity - 5)::BIGINT AS line_end, l_returnflag AS code_snippet,
         l_linestatus || l_returnflag AS recommendation, 1 - l_discount * 8 AS confidence,
         'src/f' || (l_suppkey % 10) || ['.py', '.cjs', '.go'][(1 + l_suppkey % 3)::INTEGER] AS file_path,
         l_orderkey * 8 + l_linenumber AS seq
  FROM lineitem),
ids AS (SELECT 'CWE-' || p_partkey AS cwe_id FROM part WHERE p_size < 10),
checked AS (
  SELECT raw.* REPLACE (lower(severity) AS severity), CASE WHEN ids.cwe_id IS NULL THEN 'unknown_id' WHEN confidence < 0.5 THEN 'low_confidence'
         WHEN line_start <= 0 OR line_end < line_start THEN 'bad_lines' END AS reason
  FROM raw LEFT JOIN ids USING (cwe_id)),
valid AS (
  SELECT * EXCLUDE (rn, reason) FROM (
    SELECT *, row_number() OVER (PARTITION BY cwe_id, file_path, line_start, line_end ORDER BY seq) AS rn
    FROM checked WHERE reason IS NULL) WHERE rn = 1)
"""


def _raw(spark, sf):
    """Order lines as raw findings: weak, reversed, unknown and repeated ones among them."""
    flag, supplier, line = F.col("l_returnflag"), F.col("l_suppkey"), F.col("l_linenumber").cast("bigint")
    endings = F.array(*[F.lit(s) for s in (".py", ".cjs", ".go")])
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("CWE-"), F.col("l_partkey").cast("string")).alias("cwe_id"),
        F.when(flag == "A", "HIGH").when(flag == "R", "Critical").otherwise("low").alias("severity"),
        F.concat(F.lit("Line of order "), F.col("l_orderkey").cast("string"), F.lit(" from supplier "),
                 supplier.cast("string")).alias("title"),
        F.col("l_linestatus").alias("description"),
        line.alias("line_start"),
        (line + F.col("l_quantity") - 5).cast("bigint").alias("line_end"),
        flag.alias("code_snippet"),
        F.concat("l_linestatus", "l_returnflag").alias("recommendation"),
        (1 - F.col("l_discount") * 8).alias("confidence"),
        F.concat(F.lit("src/f"), (supplier % 10).cast("string"),
                 F.element_at(endings, (1 + supplier % 3).cast("int"))).alias("file_path"),
        (F.col("l_orderkey") * 8 + line).alias("seq"),
    )


def _ids(spark, sf):
    return table(spark, sf, "part").filter("p_size < 10").select(
        F.concat(F.lit("CWE-"), F.col("p_partkey").cast("string")).alias("cwe_id"))


def _valid(spark, sf):
    return findings.validate(_raw(spark, sf), _ids(spark, sf), ["seq"])


SHOWN = "cwe_id, severity, title, line_start, line_end, round(confidence, 6) AS confidence, file_path, seq"


@query(f"WITH {RAW_SQL} SELECT {SHOWN} FROM valid")
def valid_findings(spark, sf):
    return _valid(spark, sf).withColumn("confidence", F.round("confidence", 6)).drop(
        "description", "code_snippet", "recommendation")


@query(f"WITH {RAW_SQL} SELECT cwe_id, count(*) AS n FROM raw WHERE cwe_id IN (SELECT cwe_id FROM ids) GROUP BY cwe_id")
def known_ids(spark, sf):
    return findings.known_ids(_raw(spark, sf), _ids(spark, sf)).groupBy("cwe_id").agg(F.count("*").alias("n"))


@query(f"WITH {RAW_SQL} SELECT cwe_id, count(*) AS n FROM raw WHERE cwe_id NOT IN (SELECT cwe_id FROM ids) GROUP BY cwe_id")
def unknown_ids(spark, sf):
    return findings.unknown_ids(_raw(spark, sf), _ids(spark, sf)).groupBy("cwe_id").agg(F.count("*").alias("n"))


@query(f"WITH {RAW_SQL} SELECT reason, count(*) AS n FROM checked WHERE reason IS NOT NULL GROUP BY reason")
def reject_reasons(spark, sf):
    return findings.reject_counts(findings.check(_raw(spark, sf), _ids(spark, sf)))


@query("""
SELECT l_returnflag, count(*) FILTER (WHERE l_discount <= 0.05 AND l_returnflag IN ('A', 'R')) AS well_formed, count(*) AS n
FROM lineitem GROUP BY l_returnflag""")
def well_formed(spark, sf):
    """Severity and bounds: two flags are known severities, and some confidences are over 1."""
    flag = F.col("l_returnflag")
    severity = F.when(flag == "A", "HIGH").when(flag == "R", "info").otherwise("other")
    confidence = F.round(F.col("l_discount") * 100).cast("int") / F.lit(5)
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count_if(findings.well_formed(severity, confidence)).alias("well_formed"), F.count("*").alias("n"))


@query(f"""WITH {RAW_SQL}
SELECT count(*) AS total, concat_ws(', ',
  CASE WHEN count(*) FILTER (WHERE severity = 'critical') > 0 THEN count(*) FILTER (WHERE severity = 'critical') || ' critical' END,
  CASE WHEN count(*) FILTER (WHERE severity = 'high') > 0 THEN count(*) FILTER (WHERE severity = 'high') || ' high' END,
  CASE WHEN count(*) FILTER (WHERE severity = 'low') > 0 THEN count(*) FILTER (WHERE severity = 'low') || ' low' END) AS distribution
FROM valid""")
def severity_summary(spark, sf):
    return report.summary(_valid(spark, sf))


@query(f"""WITH {RAW_SQL}
SELECT file_path, count(*) AS n, min(CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 ELSE 4 END)::INTEGER AS gravest
FROM valid GROUP BY file_path""")
def findings_per_file(spark, sf):
    return report.file_counts(_valid(spark, sf))


ICON = "CASE severity WHEN 'critical' THEN '🔴' WHEN 'high' THEN '🟠' ELSE '🔵' END"
PERCENT = "trunc(confidence * 100)::INTEGER || '%'"


@query(f"""WITH {RAW_SQL}
SELECT file_path, cwe_id, {ICON} || ' ' || upper(severity) AS severity,
       CASE WHEN length(title) > 30 THEN title[1:30] || '...' ELSE title END AS title,
       line_start || '-' || line_end AS lines, {PERCENT} AS confidence FROM valid""")
def findings_table(spark, sf):
    return report.findings_table(_valid(spark, sf))


LABELS = P.ReportLabels()


REPORT_SQL = f"""WITH {RAW_SQL},
head AS (SELECT count(*) AS total, concat_ws(', ',
    count(*) FILTER (WHERE severity = 'critical') || ' critical', count(*) FILTER (WHERE severity = 'high') || ' high',
    count(*) FILTER (WHERE severity = 'low') || ' low') AS dist FROM valid),
blocks AS (
SELECT 0::INTEGER AS part, '' AS file_path, 0::BIGINT AS line_start, NULL::BIGINT AS seq,
       '# {LABELS.heading}' || chr(10) || chr(10) || '{LABELS.total}' || total || chr(10) || chr(10) || '{LABELS.distribution}'
           || dist || chr(10) || chr(10) || '---' || chr(10) AS value FROM head
UNION ALL SELECT DISTINCT 1, file_path, -1, NULL, '## ' || file_path || chr(10) FROM valid
UNION ALL SELECT 1, file_path, line_start, seq,
  '### ' || {ICON} || ' [' || upper(severity) || '] ' || cwe_id || ': ' || title || chr(10) || chr(10)
  || '{LABELS.lines}' || line_start || '–' || line_end || chr(10) || chr(10)
  || '{LABELS.confidence}' || {PERCENT} || chr(10) || chr(10)
  || '{LABELS.severity}' || upper(severity) || chr(10) || chr(10) || chr(10)
  || '```' || CASE WHEN file_path LIKE '%.py' THEN 'python' WHEN file_path LIKE '%.go' THEN 'go' ELSE 'text' END || chr(10)
  || code_snippet || chr(10) || '```' || chr(10) || chr(10)
  || '{LABELS.description}' || description || chr(10) || chr(10) || chr(10)
  || '{LABELS.recommendation}' || recommendation || chr(10) || chr(10) || '---' || chr(10) FROM valid)
"""


@query(REPORT_SQL + "SELECT part, file_path, line_start, seq, md5(value) AS value FROM blocks")
def report_blocks(spark, sf):
    return report.report_blocks(store(_valid(spark, sf))).withColumn("value", F.md5("value"))


@query(REPORT_SQL + """SELECT md5(string_agg(value || chr(10), '' ORDER BY part, file_path, line_start, seq NULLS FIRST, value)) AS body,
       sum(len(string_split(value, chr(10))))::BIGINT AS lines FROM blocks""")
def report_file(spark, sf):
    """The report written as one file and read back: its digest and its lines."""
    path = f"{shared_folder(spark)}/auditmill/report-{uuid.uuid4().hex}.md"
    report.write_report(_valid(spark, sf), path)
    return read_digest(spark, path)


# One reply per document, in ten shapes; its text is the finding's title.
REPLY_KINDS = """
WITH base AS (SELECT doc_id AS chunk_id, doc_id % 10 AS kind, n_chars AS place, md5(text) AS body, md5('') AS blank FROM documents)
SELECT chunk_id, 0 AS item_no, 'CWE-' || place AS cwe_id, 'high' AS severity, body AS title, place AS line_start, place + 2 AS line_end,
       0.75 AS confidence, NULL AS reason FROM base WHERE kind = 0
UNION ALL SELECT chunk_id, 0, 'CWE-1', 'medium', body, 11, 12, 0.9, NULL FROM base WHERE kind = 1
UNION ALL SELECT chunk_id, 0, NULL, 'medium', body, place, place, 0.5, 'missing_id' FROM base WHERE kind = 2
UNION ALL SELECT chunk_id, 0, 'CWE-3', 'urgent', body, place, place, 0.5, 'bad_severity' FROM base WHERE kind = 3
UNION ALL SELECT chunk_id, 0, 'CWE-4', 'medium', body, place, place, 1.5, 'bad_confidence' FROM base WHERE kind = 4
UNION ALL SELECT chunk_id, 0, 'CWE-5', 'medium', blank, place, place, 0.5, NULL FROM base WHERE kind = 5
UNION ALL SELECT chunk_id, 0, 'CWE-7', 'medium', body, NULL, NULL, 0.5, 'bad_line' FROM base WHERE kind = 7
UNION ALL SELECT chunk_id, 1, 'CWE-8', 'info', blank, 3, 3, 1.0, NULL FROM base WHERE kind = 7
UNION ALL SELECT chunk_id, 0, 'CWE-1', 'medium', body, place, place, NULL, 'bad_confidence' FROM base WHERE kind = 8
UNION ALL SELECT chunk_id, 1, 'CWE-2', 'low', body, place, place, 0.5, NULL FROM base WHERE kind = 8
UNION ALL SELECT chunk_id, 0, 'CWE-9', 'medium', body, place, place, 0.5, NULL FROM base WHERE kind = 9
"""


@query(f"""SELECT chunk_id, item_no::INTEGER AS item_no, cwe_id, severity, title, line_start::BIGINT AS line_start,
       line_end::BIGINT AS line_end, confidence::DOUBLE AS confidence, reason FROM ({REPLY_KINDS})""")
def reply_items(spark, sf):
    """Replies with plain, text and missing numbers, numbers that are none, members given twice, bad members, no
    JSON, text after the JSON, and mixed lists."""
    at, quoted = F.col("n_chars").cast("string"), F.to_json(F.array("text"))
    title = F.concat(F.lit('"title": '), F.substring(quoted, F.lit(2), F.length(quoted) - 2))

    def shape(*parts):
        return F.concat(F.lit('{"findings": ['), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("]}"))

    shapes = [
        shape('{"cwe_id": "CWE-', at, '", "severity": "HIGH", "line_start": ', at, '.7, "line_end": ',
              (F.col("n_chars") + 2).cast("string"), ', "confidence": 0.75, ', title, "}"),
        shape('{"cwe_id": "CWE-1", "line_start": " 11 ", "line_end": "12", "confidence": "0.9", ', title, "}"),
        shape("{", title, "}"),
        shape('{"cwe_id": "CWE-3", "severity": "Urgent", ', title, "}"),
        shape('{"cwe_id": "CWE-4", "confidence": 1.5, ', title, "}"),
        shape('{"cwe_id": "CWE-5"}'),
        F.concat(shape('{"cwe_id": "CWE-6", ', title, "}"), F.lit(" as asked")),
        shape('{"cwe_id": "CWE-7", "line_start": null, ', title,
              '}, {"cwe_id": "CWE-8", "severity": "INFO", "line_start": 3, "confidence": true}'),
        shape('{"cwe_id": "CWE-1", "confidence": NaN, ', title, '}, {"cwe_id": "CWE-2", "severity": "low", ', title, "}"),
        shape('{"cwe_id": "CWE-8", "title": "x", "cwe_id": "CWE-9", ', title, "}"),
    ]
    raw = F.element_at(F.array(*shapes), (1 + F.col("doc_id") % 10).cast("int"))
    given = spread_table(spark, sf, "documents", "doc_id", "text", "n_chars").select(
        F.col("doc_id").alias("chunk_id"), F.col("n_chars").cast("bigint").alias("chunk_start"), raw.alias("raw"))
    items = replies.explode_items(replies.parse(given.withColumn("code", F.lit(""))))
    return items.select("chunk_id", "item_no", "cwe_id", "severity", F.md5("title").alias("title"), "line_start", "line_end",
                        F.when(~F.isnan("confidence"), F.col("confidence")).alias("confidence"), "reason")


@query("""
SELECT key, count(*) AS n FROM (SELECT coalesce(json_extract_string(props, '$.k'), 'none') AS key FROM events) GROUP BY key""")
def reply_members(spark, sf):
    """A member of a JSON text per row, counted."""
    value = F.try_variant_get(F.try_parse_json("props"), "$.k", "string")
    return table(spark, sf, "events").groupBy(F.coalesce(value, F.lit("none")).alias("key")).agg(F.count("*").alias("n"))


@query(f"""
WITH chunk AS (SELECT doc_id, source AS file_path, 5 + doc_id % 50 AS start, {sql_lines('text')} AS lines FROM documents),
cited AS (SELECT *, start + doc_id % 4 - 1 AS line_start, start + doc_id % 4 + doc_id % 3 - 1 AS line_end FROM chunk)
SELECT doc_id AS chunk_id, file_path, line_start, line_end,
       md5(array_to_string(lines[(greatest(0, line_start - start) + 1)::BIGINT
           :greatest(greatest(0, line_start - start) + 1, line_end - start + 1)::BIGINT], chr(10))) AS code_snippet
FROM cited""")
def reply_findings(spark, sf):
    """Findings with the cited lines of their chunk; some start before it."""
    doc_id = F.col("doc_id")
    docs = spread_table(spark, sf, "documents", "doc_id", "source", "text")
    first = 5 + doc_id % 50
    chunks = docs.select(
        doc_id.alias("chunk_id"), F.col("source").alias("file_path"), first.alias("line_start"), F.col("text").alias("code"))
    start = first + doc_id % 4 - 1
    raw = F.to_json(F.struct(F.array(F.struct(
        F.lit("CWE-1").alias("cwe_id"), start.alias("line_start"), (start + doc_id % 3).alias("line_end"))).alias("findings")))
    given = docs.select(doc_id.alias("chunk_id"), F.lit(1).alias("attempt"), raw.alias("raw"))
    parsed = replies.parse_replies(given, chunks).filter("reason is null")
    return parsed.select("chunk_id", "file_path", "line_start", "line_end", F.md5("code_snippet").alias("code_snippet"))


@query("""
WITH f AS (SELECT event_id, user_id AS chunk_id, (1 + hour(ts) % 2)::INTEGER AS attempt FROM events),
m AS (SELECT chunk_id, min(attempt) AS attempt FROM f GROUP BY chunk_id)
SELECT event_id, chunk_id, attempt FROM f JOIN m USING (chunk_id, attempt)""")
def retry_findings(spark, sf):
    """Events as findings: the second attempt counts only where the first had none."""
    found = table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("chunk_id"), (1 + F.hour(F.col("ts").cast("timestamp")) % 2).alias("attempt"))
    return replies.first_attempt_with_findings(found).select("event_id", "chunk_id", "attempt")


@query("""
SELECT lang, tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
       round(2 * tp / (2 * tp + fp + fn), 6) AS f1
FROM (SELECT lang, count(*) FILTER (WHERE n_chars >= 300 AND quality = 1) AS tp, count(*) FILTER (WHERE n_chars >= 300 AND quality = 0) AS fp,
             count(*) FILTER (WHERE n_chars < 300 AND quality = 1) AS fn, count(*) FILTER (WHERE n_chars < 300 AND quality = 0) AS tn
      FROM documents JOIN labels USING (doc_id) GROUP BY lang)""")
def detector_scores(spark, sf):
    pairs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    scores = evaluate.score(pairs, F.col("n_chars") >= 300, F.col("quality") == 1, ["lang"])
    return scores.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"""WITH {RAW_SQL}
SELECT 1::INTEGER AS step, 'files' AS stage, count(DISTINCT file_path) AS n FROM raw
UNION ALL SELECT 2, 'raw', count(*) FROM raw UNION ALL SELECT 3, 'valid', count(*) FROM valid""")
def stage_funnel(spark, sf):
    raw = _raw(spark, sf)
    return evaluate.funnel([
        ("files", raw.select("file_path").distinct()), ("raw", raw), ("valid", findings.validate(raw, _ids(spark, sf), ["seq"]))])
