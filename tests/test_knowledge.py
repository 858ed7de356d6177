import json
import os

import pytest
from pyspark.sql import functions as F

from auditmill import params as P
from auditmill import schemas
from auditmill.operators import hooks, knowledge, prompts, versions
from auditmill.plans import index
from tests.test_sources import GUIDES, RULES, XML


def row(source="cwe", cwe="CWE-89", title="t", text="x", languages=("python", "java"), meta=None, path="", pos=0):
    return (source, cwe, title, text, ["e"], list(languages), meta or {}, path, pos)


def test_records(spark):
    rows = [row(title="x" * 250, meta={"severity_hint": "high"}), row(cwe=None, languages=()), row("owasp", "")]
    df = spark.createDataFrame(rows, schemas.KNOWLEDGE).withColumn("idx", F.lit(7))
    got = knowledge.to_records(df).collect()
    assert [r["id"] for r in got] == ["cwe-cwe89-7", "cwe-none-7", "owasp-none-7"]
    assert (len(got[0]["title"]), got[0]["severity_hint"], got[0]["languages_csv"]) == (200, "high", "python,java")
    assert (got[1]["cwe_id"], got[1]["severity_hint"], got[1]["languages_csv"], got[1]["languages"]) == ("", "", "", [])


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_numbering(spark, n):
    df = spark.range(n).select((F.lit(n) - F.col("id")).alias("k"), F.lit("x" * 20).alias("v")).repartition(7)
    got = knowledge.number_rows(df, ["k"])
    assert sorted((r["k"], r["idx"]) for r in got.collect()) == [(i + 1, i) for i in range(n)]


def test_union_and_counts(spark):
    a = spark.createDataFrame([row(), row(pos=1)], schemas.KNOWLEDGE)
    b = spark.createDataFrame([row("owasp")], schemas.KNOWLEDGE)
    united = knowledge.union_sources([a, b])
    assert {r["source"]: r["n"] for r in knowledge.count_by_source(united).collect()} == {"cwe": 2, "owasp": 1, "total": 3}
    assert [r["source"] for r in knowledge.peek(united, 2, ["source_rank", "order_pos"]).collect()] == ["cwe", "cwe"]


def test_upsert_and_writing(spark, tmp_path):
    schema = "id string, v int, version int"
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], schema)
    new = spark.createDataFrame([("b", 2, 2), ("b", 3, 3), ("c", 9, 1)], schema)
    merged = {r["id"]: r["v"] for r in knowledge.upsert(old, new, version="version").collect()}
    assert merged == {"a": 1, "b": 3, "c": 9}
    path = str(tmp_path / "kb")
    assert knowledge.write_table(old.limit(0), path) == 0
    assert knowledge.write_table(old, path) == 2, "a table without rows is not a filled one"
    assert knowledge.write_table(new, path) == 2
    assert {r["v"] for r in knowledge.read_table(spark, path).collect()} == {1}
    for _ in range(2):  # once more gives the same
        assert knowledge.upsert_table(new, path, version="version") == 3
    assert {r["id"]: r["v"] for r in knowledge.read_table(spark, path).collect()} == {"a": 1, "b": 3, "c": 9}
    assert knowledge.upsert_table(new, str(tmp_path / "fresh")) == 2
    assert knowledge.write_table(new, path, rebuild=True) == 3


def test_id_list_round_trip(spark, tmp_path):
    ids = spark.createDataFrame([("CWE-9",), ("CWE-10",), ("CWE-9",), (None,)], "cwe_id string")
    path = str(tmp_path / "ids")
    knowledge.write_ids(ids, path)
    with open(path) as file:
        assert json.load(file) == ["CWE-10", "CWE-9"]
    assert {r[0] for r in knowledge.read_ids(spark, path).collect()} == {"CWE-9", "CWE-10"}
    (tmp_path / "one.json").write_text('["CWE-1","CWE-2"]')
    assert knowledge.read_ids(spark, str(tmp_path / "one.json")).count() == 2
    knowledge.write_ids(ids.limit(0), path)
    assert knowledge.read_ids(spark, path).count() == 0


def vectors(texts):
    if any("Plain" in t for t in texts):
        raise ValueError("no")
    return [[float(len(t)), 1.0] for t in texts]


@pytest.fixture()
def corpora(tmp_path):
    (tmp_path / "c.xml").write_text(XML, encoding="utf-8")
    for folder, texts in (("g", GUIDES), ("r", {n: json.dumps({"rules": r}) for n, r in RULES.items()})):
        for name, text in texts.items():
            path = tmp_path / folder / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)
    return {"cwe": str(tmp_path / "c.xml"), "owasp": str(tmp_path / "g"), "semgrep": str(tmp_path / "r")}


def test_knowledge_base_build(spark, corpora, tmp_path):
    table, ids = str(tmp_path / "kb"), str(tmp_path / "ids")
    params = P.AuditParams(embedding_dim=2)
    count = index.build_knowledge_base(spark, corpora, table, ids, vectors, params=params)
    rows = knowledge.read_table(spark, table).collect()
    assert count == len(rows) == 3 + 5 + 5
    assert len({r["id"] for r in rows}) == count
    first = sorted(rows, key=lambda r: int(r["id"].rsplit("-", 1)[1]))
    assert [r["source"] for r in first] == ["cwe"] * 3 + ["owasp"] * 5 + ["semgrep"] * 5
    assert [r["id"] for r in first[:3]] == ["cwe-cwe89-0", "cwe-cwe7-1", "cwe-cwe10-2"], "the order of the document"
    assert first[1]["embedding"] == [0.0, 0.0]
    assert first[2]["embedding"] == [float(len(first[2]["document"])), 1.0]
    assert knowledge.read_ids(spark, ids).count() == 4
    only = {"owasp": corpora["owasp"]}
    assert index.build_knowledge_base(spark, only, table, ids, vectors, params=params) == count, "filled tables stay"
    assert index.build_knowledge_base(spark, only, table, ids, vectors, rebuild=True, params=params) == 5
    rules_too = {**only, "semgrep": corpora["semgrep"]}
    assert index.build_knowledge_base(spark, rules_too, table, ids, vectors, params=params, merge=True) == 10
    missing = {"owasp": str(tmp_path / "none"), "semgrep": str(tmp_path / "none")}
    assert index.build_knowledge_base(spark, missing, str(tmp_path / "kb3"), ids, vectors) == 0


def test_a_further_source(spark, corpora):
    more = {**index.SOURCES, "own": lambda s, path: s.createDataFrame([row("own", path)], schemas.KNOWLEDGE)}
    rows = index.collect_knowledge(spark, {"own": "CWE-5", "owasp": corpora["owasp"]}, more).collect()
    assert "own-cwe5-5" in {r["id"] for r in rows}


def test_embedder_failures_cost_their_own_row(spark):
    df = spark.createDataFrame([("ok",), ("Plain",), ("other",)], "t string").coalesce(1)
    got = {r["t"]: list(r["embedding"]) for r in hooks.embed(df, "t", vectors, 2).collect()}
    assert got == {"ok": [2.0, 1.0], "Plain": [0.0, 0.0], "other": [5.0, 1.0]}
    short = hooks.embed(df, "t", lambda texts: [[1.0] for _ in texts], 2)
    assert {tuple(r["embedding"]) for r in short.collect()} == {(0.0, 0.0)}


def test_detector_failures_are_empty_replies(spark):
    def detector(messages):
        assert [m["role"] for m in messages] == ["system", "user"]
        if "bad" in messages[1]["content"]:
            raise RuntimeError("down")
        return messages[1]["content"]

    df = spark.createDataFrame([("a", "good"), ("b", "bad")], "chunk_id string, t string")
    asked = df.select("chunk_id", prompts.messages("s", F.col("t")).alias("messages"))
    got = {r["chunk_id"]: (r["attempt"], r["raw"]) for r in hooks.detect(asked, detector, 2).collect()}
    assert got == {"a": (2, "good"), "b": (2, hooks.EMPTY_REPLY)}


def test_context_and_prompt(spark):
    known = spark.createDataFrame([
        ("k1", "CWE-89", "cwe", "SQL", "y" * 900, ["e1", "e2", "e3"]), ("k2", "", "owasp", "Guide", "body {name}", [])],
        "id string, cwe_id string, source string, title string, document string, examples array<string>")
    hits = spark.createDataFrame([("c", "k1", 2), ("c", "k2", 1)], "chunk_id string, id string, rank int")
    context = prompts.knowledge_context(hits, known)
    want = "[OWASP] Guide\nbody {name}\n\n[CWE-89] SQL\n" + "y" * 800 + "\nExamples:\n  - e1\n  - e2"
    assert [(r["chunk_id"], r["context"]) for r in context.collect()] == [("c", want)]
    chunks = spark.createDataFrame([("c", "python", "a.py", "f", "x\ny", 9), ("d", "go", "b.go", "g", "z", 1)],
                                   "chunk_id string, language string, file_path string, name string, code string, line_start int")
    given = chunks.join(context, "chunk_id", "left")
    made = {r["chunk_id"]: r["messages"] for r in prompts.build_prompts(
        given, "sys", "{knowledge}|{language}|{file_path}|{name}|{code}|{other}").collect()}
    assert made["c"][0]["content"] == "sys" and made["c"][1]["role"] == "user"
    assert made["c"][1]["content"] == want + "|python|a.py|f| 9 | x\n10 | y|{other}"
    assert made["d"][1]["content"] == "|go|b.go|g|1 | z|{other}"
    lists = chunks.withColumn("hits", F.when(F.col("chunk_id") == "c", F.expr(
        "array(named_struct('rank', 1, 'id', 'k2', 'sim', 0.9D), named_struct('rank', 2, 'id', 'k1', 'sim', 0.8D), "
        "named_struct('rank', 3, 'id', 'gone', 'sim', 0.8D))")).otherwise(F.expr(
            "cast(array() as array<struct<rank:int,id:string,sim:double>>)")))
    for limit in (1 << 20, 0):
        got = {r["chunk_id"]: r["context"] for r in prompts.attach_context(lists, known, limit).collect()}
        assert got == {"c": want, "d": ""}
    default = prompts.build_prompts(given).collect()
    assert all("{" + slot + "}" not in r["messages"][1]["content"] for r in default for slot in ("language", "code", "knowledge"))


def test_broken_off_runs_leave_the_old_rows(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "kb")
    old = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 2), ("c", 3), ("c", 1)], "id string, v int").coalesce(1)
    rows = lambda: sorted(map(tuple, knowledge.read_table(spark, path).collect()))
    assert not knowledge.has_rows(spark, path)
    with pytest.raises(FileNotFoundError):
        knowledge.read_table(spark, path)
    knowledge.write_table(old, path)
    held = knowledge.read_table(spark, path)

    def stop(*args):
        raise KeyboardInterrupt
    for name in ("switch", "write_beside"):  # between the write and the switch, and before the write
        with monkeypatch.context() as m:
            m.setattr(versions, name, stop)
            with pytest.raises(KeyboardInterrupt):
                knowledge.upsert_table(new, path)
        assert rows() == [("a", 1), ("b", 1)]
    assert knowledge.upsert_table(new, path) == 3 and rows() == [("a", 1), ("b", 2), ("c", 1)], "the last of a doubled key counts"
    assert sorted(map(tuple, held.collect())) == [("a", 1), ("b", 1)], "a reader of the version before goes on"
    os.close(os.open(f"{path}/{versions.POINTERS}/{3:012d}", os.O_CREAT))  # a switch that died before its name was written
    assert rows() == [("a", 1), ("b", 2), ("c", 1)] and knowledge.upsert_table(new, path) == 3


def test_late_writers_are_refused_and_old_versions_go(spark, tmp_path):
    path = str(tmp_path / "kb")
    rows = spark.createDataFrame([("a", 1)], "id string, v int")
    number, _ = versions.version(spark, path)
    late = versions.write_beside(rows, path)
    for v in range(4):
        knowledge.write_table(rows.withColumn("v", F.lit(v)), path, rebuild=True)
    with pytest.raises(versions.TableChanged):
        versions.switch(spark, path, late, number)
    assert [r.v for r in knowledge.read_table(spark, path).collect()] == [3]
    assert len([d for d in os.listdir(path) if d.startswith("v-")]) == versions.KEEP + 1
    rows.write.parquet(str(tmp_path / "plain"))  # rows that were not written here are taken as they are
    assert knowledge.upsert_table(rows.withColumn("v", F.lit(9)), str(tmp_path / "plain")) == 1
    assert [r.v for r in knowledge.read_table(spark, str(tmp_path / "plain")).collect()] == [9]


def test_numbering_stores_columns(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("id"), F.lit(5).alias("_part"), F.lit("x").alias("_place"))
    numbered = knowledge.number_rows(rows.repartition(7), ["id"])
    assert numbered.columns == ["id", "_part", "_place", "idx"]
    assert numbered.filter("id <> idx or _part <> 5 or _place <> 'x'").count() == 0 and numbered.count() == 1000
    plan = numbered.select("idx")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<_part_:int,_place_:bigint>" in plan, "the stored columns that are not asked for are not read"
