import glob
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from auditmill import params as P
from auditmill.operators import evaluate, report
from auditmill.plans import scan
from auditmill.sources import files

SCHEMA = ("cwe_id string, severity string, title string, description string, line_start bigint, line_end bigint, "
          "code_snippet string, recommendation string, confidence double, file_path string, seq int")
FOUND = [
    ("CWE-89", "high", "A title that is longer than thirty", "D1", 6, 6, "q = 1", "R1", 1.0, "b.py", 1),
    ("CWE-79", "low", "T2", "D2", 3, 4, "x\ny", "R2", 0.29, "b.py", 2),
    ("CWE-22", "critical", "T3", "D3", 9, 9, "z", "R3", 0.999, "a.rs", 3),
    ("CWE-22", "high", "T4", "D4", 3, 3, "w", "R4", 0.5, "b.py", 0),
]


def test_roll_ups(spark):
    found = spark.createDataFrame(FOUND, SCHEMA)
    assert [(r["severity"], r["n"]) for r in report.severity_counts(found).collect()] == [("critical", 1), ("high", 2), ("low", 1)]
    assert tuple(report.summary(found).first()) == (4, "1 critical, 2 high, 1 low")
    assert {r["file_path"]: (r["n"], r["gravest"]) for r in report.file_counts(found).collect()} == {"a.rs": (1, 1), "b.py": (3, 2)}
    rows = report.findings_table(found).collect()
    assert [tuple(r) for r in rows] == [
        ("a.rs", "CWE-22", "🔴 CRITICAL", "T3", "9-9", "99%"), ("b.py", "CWE-22", "🟠 HIGH", "T4", "3-3", "50%"),
        ("b.py", "CWE-79", "🔵 LOW", "T2", "3-4", "28%"),
        ("b.py", "CWE-89", "🟠 HIGH", "A title that is longer than th...", "6-6", "100%")]


def read(path):
    """A file, or the part files of a folder."""
    paths = sorted(glob.glob(os.path.join(path, "part-*"))) if os.path.isdir(path) else [path]
    return "".join(open(p, encoding="utf-8").read() for p in paths)


def test_written_report(spark, tmp_path):
    found = spark.createDataFrame(FOUND[:1] + FOUND[2:3], SCHEMA)
    report.write_report(found, str(tmp_path / "r"), labels=P.ReportLabels(heading="Отчёт"))
    lines = [
        "# Отчёт\n", "**Найдено уязвимостей:** 2\n", "**Распределение:** 1 critical, 1 high\n", "---\n", "## a.rs\n",
        "### 🔴 [CRITICAL] CWE-22: T3\n", "**Строки:** 9–9\n", "**Уверенность:** 99%\n", "**Severity:** CRITICAL\n\n", "```text", "z", "```\n",
        "**Описание:** D3\n\n", "**Рекомендация:** R3\n", "---\n", "## b.py\n",
        "### 🟠 [HIGH] CWE-89: A title that is longer than thirty\n", "**Строки:** 6–6\n", "**Уверенность:** 100%\n", "**Severity:** HIGH\n\n",
        "```python", "q = 1", "```\n", "**Описание:** D1\n\n", "**Рекомендация:** R1\n", "---\n"]
    assert read(str(tmp_path / "r")) == "\n".join(lines) + "\n"
    report.write_report(found.limit(0), str(tmp_path / "e"))
    assert read(str(tmp_path / "e")) == "# Отчёт об анализе\n\n✓ **Результат:** Уязвимостей не обнаружено.\n\n"
    report.write_findings(found, str(tmp_path / "t"))
    assert read(str(tmp_path / "t")).startswith("file_path,cwe_id,severity,title,lines,confidence\na.rs,CWE-22,")


def test_scores(spark):
    rows = [("a", True, True), ("a", True, False), ("a", False, True), ("a", True, True), ("b", False, False)]
    pairs = spark.createDataFrame(rows, "g string, p boolean, y boolean")
    got = {r["g"]: r for r in evaluate.score(pairs, F.col("p"), F.col("y"), ["g"]).collect()}
    a, b = got["a"], got["b"]
    assert (a["tp"], a["fp"], a["fn"], a["tn"]) == (2, 1, 1, 0)
    assert a["precision"] == pytest.approx(2 / 3) and a["recall"] == pytest.approx(2 / 3) and a["f1"] == pytest.approx(2 / 3)
    assert (b["precision"], b["recall"], b["f1"]) == (None, None, None)


def vectors(texts):
    return [[1.0 + t.count("execute"), 1.0 + t.count("open"), 1.0] for t in texts]


def test_audit(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def review(messages):
        calls.add(1)
        user = messages[1]["content"]
        hit = re.search(r"^ *(\d+) \| .*execute.*\+", user, re.MULTILINE)
        if not hit:
            return "sorry"
        line = int(hit.group(1))
        top = re.search(r"\[(CWE-\d+)\]", user).group(1)
        good = {"cwe_id": top, "severity": "High", "title": "SQL", "line_start": line, "line_end": line, "confidence": 0.9}
        return json.dumps({"findings": [good, dict(good), {**good, "cwe_id": "CWE-0"}, {**good, "confidence": 0.1}, {**good, "confidence": 7}]})

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "__init__.py").write_text("x = 1\n")
    (tmp_path / "src" / "db.py").write_text("import db\n\ndef get(u):\n    return db.execute('q' + u)\n\ndef safe():\n    return 1\n")
    (tmp_path / "src" / "m.go").write_text("package m\nfunc Run(q string) {\n\tdb.execute(q + \"x\")\n}\n")
    known = spark.createDataFrame([
        ("k1", "cwe", "CWE-89", "SQL", "text", [], ["python"], [5.0, 1.0, 1.0]),
        ("k2", "cwe", "CWE-22", "Path", "text", [], ["python", "go"], [1.0, 5.0, 1.0])],
        "id string, source string, cwe_id string, title string, document string, examples array<string>, "
        "languages array<string>, embedding array<double>")
    ids = spark.createDataFrame([("CWE-89",), ("CWE-22",)], "cwe_id string")
    run = scan.audit(files.load_files(spark, str(tmp_path)), known, ids, vectors, review, P.AuditParams(embedding_dim=3), tasks=3)
    assert {r["stage"]: r["n"] for r in run.funnel().collect()} == {"files": 3, "chunks": 4, "raw": 8, "valid": 2}
    found = {(os.path.basename(r["file_path"]), r["cwe_id"], r["line_start"], r["severity"], r["code_snippet"]) for r in run.findings.collect()}
    assert found == {("db.py", "CWE-89", 4, "high", "    return db.execute('q' + u)"),
                     ("m.go", "CWE-22", 3, "high", '\tdb.execute(q + "x")')}
    rejects = {r["reason"]: r["n"] for r in scan.reject_summary(run).collect()}
    assert rejects == {"unknown_id": 2, "low_confidence": 2, "bad_confidence": 2}
    assert {(r["chunk_id"], r["attempt"]) for r in run.replies.collect()} >= {(r["chunk_id"], 1) for r in run.chunks.collect()}
    assert run.replies.filter("attempt = 2").count() == 2
    assert calls.value == 6, "four chunks, two of them asked again, and none twice"
    assert [(r["severity"], r["n"]) for r in run.severities().collect()] == [("high", 2)]
    scan.write_outputs(run, str(tmp_path / "report"), str(tmp_path / "table"))
    assert read(str(tmp_path / "report")).count("### 🟠 [HIGH]") == 2
    # Only knowledge in the language of the chunk gets into its context.
    hits = {(r["id"], r["language"]) for r in run.retrieved.join(run.chunks, "chunk_id").select("id", "language").collect()}
    assert hits == {("k1", "python"), ("k2", "python"), ("k2", "go")}


def test_nearest_rows_are_scored_once(spark):
    import __spark_entry__ as entry
    for name in ("knn_top5", "knn_label_post", "knn_label_pre"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1


def test_stored_stages_need_a_shared_folder(spark, monkeypatch):
    import pytest
    from auditmill import session

    class Bare:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)
    with pytest.raises(ValueError):
        session.shared_folder(Bare)


def test_counters_take_no_scan(spark):
    counters = evaluate.Counters()
    rows = counters.observe(spark.range(100).repartition(5), rows=F.count("*"), even=F.count_if(F.col("id") % 2 == 0))
    assert rows.count() == 100
    kept = counters.observe(rows.filter("id < 10"), kept=F.count("*"))
    kept.write.format("noop").mode("overwrite").save()
    table = counters.funnel(spark)
    assert [tuple(r) for r in table.collect()] == [(1, "rows", 100), (2, "even", 50), (3, "kept", 10)]
    assert "Scan ExistingRDD" in table._jdf.queryExecution().executedPlan().toString() or "LocalTableScan" in table._jdf.queryExecution().executedPlan().toString()


def test_report_with_time_and_footer(spark, tmp_path):
    found = spark.createDataFrame(FOUND[:1], SCHEMA)
    report.write_report(found, str(tmp_path / "r.md"), labels=P.ReportLabels(heading="H", made="made today", footer="the end"))
    text = read(str(tmp_path / "r.md"))
    assert text.startswith("# H\n\nmade today\n") and text.endswith("---\n\nthe end\n\n")


def test_findings_of_one_id_are_dealt_to_many_tasks(spark):
    from auditmill.operators import findings
    rows = spark.range(0, 4000, 1, 4).select(
        F.lit("CWE-1").alias("cwe_id"), F.col("id").alias("line_start"), F.col("id").alias("line_end"), F.lit("HIGH").alias("severity"),
        F.lit(0.9).alias("confidence"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("file_path"))
    ids = spark.createDataFrame([("CWE-1",), ("CWE-1",), (None,)], "cwe_id string")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        checked = findings.check(rows, ids).withColumn("part", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(checked) == 4000 and len({r.part for r in checked}) > 8
    assert [r.line_start for r in checked if r.reason] == [0]
    few = findings.check(rows.limit(3).withColumn("cwe_id", F.lit(None).cast("string")), ids)
    assert [r.reason for r in few.collect()] == ["unknown_id"] * 3


def test_messages_become_objects_some_at_a_time(monkeypatch):
    import pyarrow as pa

    from auditmill.operators import hooks
    made = []
    monkeypatch.setattr(hooks.F, "arrow_udf", lambda kind: lambda f: made.append(f) or (lambda *c: F.lit(None)))

    class Frame:
        sparkSession = type("S", (), {"conf": type("C", (), {"get": staticmethod(lambda *a: "1")})})

        def withColumn(self, *a):
            return self

    with monkeypatch.context() as m:
        m.setattr(hooks.F, "lit", lambda x: x)
        hooks.detect(Frame(), lambda messages: messages[0]["content"])
    most, kind = [], pa.list_(pa.struct([("role", pa.string()), ("content", pa.string())]))

    class Batch:
        def __init__(self, rows):
            self.rows = rows

        def __len__(self):
            return len(self.rows)

        def slice(self, at, n):
            return Batch(self.rows.slice(at, n))

        def to_pylist(self):
            most.append(len(self.rows))
            return self.rows.to_pylist()

    rows = pa.array([[{"role": "user", "content": str(i)}] for i in range(1000)], kind)
    assert made[0](Batch(rows)).to_pylist() == [str(i) for i in range(1000)] and max(most) <= 256


def test_ids_are_copied_only_where_many_findings_name_them(spark):
    from auditmill.operators import findings
    n = F.col("id")
    name = F.when(n < 4000, "CWE-1").when(n < 5000, "none such").when(n >= 6000, F.concat(F.lit("CWE-"), (n - 4000).cast("string")))
    rows = spark.range(0, 12000, 1, 4).select(  # one id with a third of the rows, an unknown one, rows without, 6000 ids with one each
        name.alias("cwe_id"), F.lit("HIGH").alias("severity"), F.lit(0.9).alias("confidence"), (n + 1).alias("line_start"), (n + 1).alias("line_end"))
    ids = spark.range(0, 12000, 1, 4).select(F.when(n > 0, F.concat(F.lit("CWE-"), (n % 6000).cast("string"))).alias("cwe_id"))
    settings = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k) for k in settings}

    def nodes(plan):
        return [plan, *(x for i in range(plan.children().size()) for x in nodes(plan.children().apply(i)))]

    try:
        spark.conf.set(settings[0], "false")
        for limit in ("1g", "-1"):
            spark.conf.set(settings[1], limit)
            checked = findings.check(rows, ids)
            assert sorted((r.line_start, r.severity, r.reason) for r in checked.collect()) == [
                (i + 1, "high", None if i < 4000 or 6000 <= i < 10000 else "unknown_id") for i in range(12000)]
            sent = [x.metrics().apply("numOutputRows").value() for x in nodes(checked._jdf.queryExecution().executedPlan()) if x.nodeName() == "BroadcastExchange"]
            assert len(sent) == (limit == "1g") and all(k < 50_000 for k in sent)  # 6000 ids, and 127 more of each of 256 at most
        assert len(findings.heavy_ids(rows)) <= findings.HEAVY
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
