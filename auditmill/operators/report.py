"""Roll-ups and reports of validated findings.

A report is a sorted table with one row per block of text. Blocks of one file are not put
together in a row, so a file with very many findings is spread like any other data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditmill import params as P
from auditmill.functions.lookup import fence_language, severity_icon, severity_rank
from auditmill.functions.text import ellipsis, percent
from auditmill.session import store
from auditmill.sources.onefile import write_lines


def severity_counts(findings: DataFrame) -> DataFrame:
    """(severity, severity_rank, n), the gravest first; severities without findings are left out."""
    counts = findings.groupBy("severity").agg(F.count("*").alias("n"))
    return counts.withColumn("severity_rank", severity_rank(F.col("severity"))).orderBy("severity_rank", "severity")


def file_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("file_path").agg(
        F.count("*").alias("n"), F.min(severity_rank(F.col("severity"))).alias("gravest"))


def summary(findings: DataFrame) -> DataFrame:
    """One row: total and `2 critical, 1 low`."""
    counts = [F.count_if(F.col("severity") == s) for s in P.SEVERITIES]
    parts = F.array(*[
        F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {s}"))) for s, n in zip(P.SEVERITIES, counts)
    ])
    return findings.agg(F.count("*").alias("total"), F.array_join(parts, ", ").alias("distribution"))


def findings_table(findings: DataFrame, seq: str = "seq", limits: P.TextLimits = P.TextLimits()) -> DataFrame:
    """Flat table for display, by file and first line."""
    shown = findings.select(
        "file_path",
        "cwe_id",
        F.concat(severity_icon(F.col("severity")), F.lit(" "), F.upper("severity")).alias("severity"),
        ellipsis(F.col("title"), limits.table_title).alias("title"),
        F.concat_ws("-", F.col("line_start").cast("string"), F.col("line_end").cast("string")).alias("lines"),
        F.concat(percent(F.col("confidence")).cast("string"), F.lit("%")).alias("confidence"),
        F.col("line_start").alias("_line"),
        F.col(seq).alias("_seq"),
    )
    return shown.orderBy("file_path", "_line", "_seq").drop("_line", "_seq")


def finding_block(labels: P.ReportLabels = P.ReportLabels()) -> Column:
    """Text of one finding."""
    c = F.col
    upper = F.upper("severity")
    lines = [
        F.concat(F.lit("### "), severity_icon(c("severity")), F.lit(" ["), upper, F.lit("] "), c("cwe_id"), F.lit(": "), c("title"), F.lit("\n")),
        F.concat(F.lit(labels.lines), c("line_start").cast("string"), F.lit("–"), c("line_end").cast("string"), F.lit("\n")),
        F.concat(F.lit(labels.confidence), percent(c("confidence")).cast("string"), F.lit("%\n")),
        F.concat(F.lit(labels.severity), upper, F.lit("\n\n")),
        F.concat(F.lit("```"), fence_language(c("file_path"))),
        c("code_snippet"),
        F.lit("```\n"),
        F.concat(F.lit(labels.description), c("description"), F.lit("\n\n")),
        F.concat(F.lit(labels.recommendation), c("recommendation"), F.lit("\n")),
        F.lit("---\n"),
    ]
    return F.concat_ws("\n", *lines)


def report_blocks(findings: DataFrame, seq: str = "seq", labels: P.ReportLabels = P.ReportLabels()) -> DataFrame:
    """(part, file_path, line_start, seq, value) in the order of the written report:
    the head (part 0), then per file its heading (part 1, before all lines) and its findings."""
    head = summary(findings).select(
        F.lit(0).alias("part"), F.lit("").alias("file_path"), F.lit(0).cast("bigint").alias("line_start"),
        F.lit(None).cast(findings.schema[seq].dataType).alias("seq"),
        F.concat_ws(
            "\n",
            F.lit(f"# {labels.heading}\n"),
            F.lit(f"{labels.made}\n") if labels.made else F.lit(None).cast("string"),
            F.when(F.col("total") == 0, F.lit(f"{labels.empty}\n")).otherwise(F.concat(
                F.lit(labels.total), F.col("total").cast("string"), F.lit("\n\n"),
                F.lit(labels.distribution), F.col("distribution"), F.lit("\n\n---\n"),
            )),
        ).alias("value"),
    )
    headings = findings.select("file_path").distinct().select(
        F.lit(1).alias("part"), "file_path", F.lit(-1).cast("bigint").alias("line_start"),
        F.lit(None).cast(findings.schema[seq].dataType).alias("seq"),
        F.concat(F.lit("## "), "file_path", F.lit("\n")).alias("value"),
    )
    blocks = findings.select(
        F.lit(1).alias("part"), "file_path", F.col("line_start").cast("bigint"), F.col(seq).alias("seq"),
        finding_block(labels).alias("value"),
    )
    whole = head.unionByName(headings).unionByName(blocks)
    if labels.footer:
        whole = whole.unionByName(head.withColumns({"part": F.lit(2), "value": F.lit(f"{labels.footer}\n")}))
    return whole.orderBy("part", "file_path", "line_start", "seq", "value")  # the text decides where `seq` does not


def write_report(findings: DataFrame, path: str, seq: str = "seq", labels: P.ReportLabels = P.ReportLabels()) -> None:
    """Write the report as one text file, replaced only when the new one is whole. The findings are stored, as the report
    goes over them three times."""
    write_lines(report_blocks(store(findings), seq, labels).select("value"), path)


def write_findings(findings: DataFrame, path: str, seq: str = "seq", limits: P.TextLimits = P.TextLimits()) -> None:
    findings_table(findings, seq, limits).write.mode("overwrite").option("header", True).csv(path)
