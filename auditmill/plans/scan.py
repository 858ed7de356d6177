"""Audit of source files: chunks, nearest knowledge, prompts, replies, findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditmill import params as P
from auditmill.operators import evaluate, findings, hooks, knn, prompts, replies, report, segment
from auditmill.session import store

# Arrival order of findings: file, place in the file, attempt, place in the reply.
SEQ = ("file_path", "chunk_start", "chunk_id", "attempt", "item_no")


@dataclass(frozen=True)
class Audit:
    """Tables of one run."""

    files: DataFrame
    chunks: DataFrame
    retrieved: DataFrame
    prompts: DataFrame
    replies: DataFrame
    items: DataFrame
    raw_findings: DataFrame
    findings: DataFrame
    rejects: DataFrame
    counters: evaluate.Counters
    limits: P.TextLimits

    def funnel(self) -> DataFrame:
        """(step, stage, n), counted while the stages were stored."""
        return self.counters.funnel(self.findings.sparkSession)

    def severities(self) -> DataFrame:
        return report.severity_counts(self.findings)


def knn_params(params: P.AuditParams) -> knn.KnnParams:
    """k = 0 means the default."""
    return knn.KnnParams(
        k=params.top_k or P.AuditParams().top_k, mode=params.language_mode, empty_means_all=params.empty_means_all)


def retrieve(chunks: DataFrame, knowledge: DataFrame, params: P.AuditParams = P.AuditParams()) -> DataFrame:
    """(chunk_id, id, sim, rank) for chunks with `embedding`."""
    return knn.knn_join(chunks, knowledge, knn_params(params))


def ask(prompts_: DataFrame, detector: hooks.Detector, attempts: int = 2) -> DataFrame:
    """(chunk_id, file_path, chunk_start, attempt, raw, items) of up to `attempts` rounds.

    A chunk is asked again only while its reply holds no finding. Each round is stored, so no
    chunk is asked twice for one round; code and messages are stored only for chunks that may
    be asked again, and no round needs a join."""
    done, waiting = None, prompts_.withColumnRenamed("line_start", "chunk_start")
    waiting = waiting.select("chunk_id", "file_path", "chunk_start", "code", "messages")
    for attempt in range(1, attempts + 1):
        parsed = replies.parse(hooks.detect(waiting, detector, attempt)).withColumn(
            "again", ~replies.has_finding(F.col("items")) & F.lit(attempt < attempts))
        kept = store(parsed.withColumns({c: F.when(F.col("again"), F.col(c)) for c in ("code", "messages")}))
        answered = kept.drop("code", "messages", "again")
        done = answered if done is None else done.unionByName(answered)
        waiting = kept.filter("again").select(*waiting.columns)
    return done


def audit(
    files: DataFrame,
    knowledge: DataFrame,
    valid_ids: DataFrame,
    embedder: hooks.Embedder,
    detector: hooks.Detector,
    params: P.AuditParams = P.AuditParams(),
    system: str = P.SYSTEM_PROMPT,
    template: str = P.USER_PROMPT,
    tasks: int | None = None,
    braced=None,
    indented=None,
) -> Audit:
    """All stages. `tasks` sets the number of tasks that share the model calls. `braced` and `indented` are the
    rules of the languages, as `segment.segment_files` takes them; files of other languages than
    `params.languages` and those with rules of their own are left out.

    With a knowledge table of ordinary size, code is shuffled only to spread it over `tasks`:
    hits, context, messages, replies and items are columns added to the rows where they are."""
    known = {*params.languages, *(braced or ()), *(indented or ())}
    files = files.filter(F.col("language").isin(*sorted(known)))
    counters = evaluate.Counters()
    chunks = segment.segment_files(files, params.max_chunk_lines, braced, indented, with_ordinal=True)
    even = chunks.repartition(tasks, "chunk_id") if tasks else chunks
    # Every file has a chunk number 0. Both counts are taken as the rows are written, so no task counts twice.
    counted = counters.observe(hooks.embed(even, "code", embedder, params.embedding_dim, params.embed_batch),
                               files=F.count_if(F.col("ordinal") == 0), chunks=F.count("*"))
    embedded = store(counted.drop("ordinal"))
    with_hits = knn.attach_hits(embedded, knowledge, knn_params(params))
    messages = prompts.build_prompts(prompts.attach_context(with_hits, knowledge, limits=params.limits), system, template)
    answered = ask(messages, detector, params.attempts)
    items = replies.explode_items(answered)
    raw = items.filter("reason is null")
    checked = store(counters.observe(findings.check(raw.drop("reason"), valid_ids, params.min_confidence), raw=F.count("*")))
    first = findings.keep_first(checked.filter("reason is null"), findings.FINDING_KEY, list(SEQ))
    valid = store(counters.observe(first.withColumn("seq", F.struct(*SEQ[1:])), valid=F.count("*")))
    place = ("chunk_id", "attempt", "item_no", "reason")
    rejects = items.filter("reason is not null").select(*place).unionByName(
        checked.filter("reason is not null").select(*place))
    return Audit(
        files=files,
        chunks=embedded.drop("embedding"),
        retrieved=with_hits.select("chunk_id", F.inline("hits")),
        prompts=messages.select("chunk_id", "messages"),
        replies=answered.drop("items"),
        items=items,
        raw_findings=raw,
        findings=valid,
        rejects=rejects,
        counters=counters,
        limits=params.limits,
    )


def reject_summary(run: Audit) -> DataFrame:
    """Dropped items per reason, over parsing and validation."""
    return findings.reject_counts(run.rejects)


def write_outputs(run: Audit, report_path: str, table_path: str, labels: P.ReportLabels = P.ReportLabels()) -> None:
    """The report as one file, the table of findings as a folder."""
    report.write_report(run.findings, report_path, labels=labels)
    report.write_findings(run.findings, table_path, limits=run.limits)
