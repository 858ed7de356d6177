import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auditmill.functions import vectors
from auditmill.operators import blocks, knn, prompts

SCHEMA = "id bigint, embedding array<float>, language string, languages array<string>"


def make(seed, n, dim=6, hot=True):
    """Vectors in clumps; a third are copies of one vector, some are zero, missing or of another width."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    rows = []
    for i in range(n):
        v = centres[rng.integers(5)] + 0.2 * rng.normal(size=dim)
        if hot and i % 3 == 0:
            v = centres[0]
        value = [float(np.float32(x)) for x in v]
        if i % 17 == 5:
            value = [0.0] * dim
        if i % 29 == 7:
            value = None
        if i % 31 == 9:
            value = value and value[:2]
        if i == 10:
            value = value + value
        tags = [["a"], ["b"], ["a", "b"], [], None][int(rng.integers(5))]
        rows.append((i, value, ["a", "b", "c", None][int(rng.integers(4))], tags))
    return rows


def brute(queries, known, k, mode, empty_means_all):
    out = set()
    for qid, qv, lang, _ in queries:
        scored = []
        for kid, kv, _, tags in known:
            tags = tags or []
            fits = lang in tags or (empty_means_all and not tags)
            if mode == "pre" and not fits:
                continue
            sim = None
            if qv and kv and len(qv) == len(kv) == 6 and any(qv) and any(kv):
                q, v = np.array(qv), np.array(kv)
                sim = round(float(q @ v / np.sqrt(q @ q) / np.sqrt(v @ v)), 9)
            scored.append((sim is None, -(sim or 0.0), kid, sim, fits))
        for rank, (_, _, kid, sim, fits) in enumerate(sorted(scored)[:k], 1):
            if mode != "post" or fits:
                out.add((qid, kid, None if sim is None else round(sim, 7) + 0.0, rank))
    return out


FORMS = {"one block": {}, "blocks": dict(block_bytes=8 * 6 * 11, share_bytes=8 * 6 * 13), "a row each": dict(block_bytes=1, share_bytes=1)}


@pytest.mark.parametrize("form", list(FORMS))
@pytest.mark.parametrize("mode,all_langs", [("none", False), ("post", False), ("pre", False), ("pre", True), ("post", True)])
def test_against_brute_force(spark, form, mode, all_langs):
    queries, known = make(1, 90), make(2, 120)
    params = knn.KnnParams(k=4, mode=mode, empty_means_all=all_langs, **FORMS[form])
    asking = spark.createDataFrame(queries, SCHEMA).withColumnRenamed("id", "chunk_id")
    found = knn.knn_join(asking, spark.createDataFrame(known, SCHEMA), params).collect()
    got = {(r[0], r[1], None if r[2] is None else round(r[2], 7) + 0.0, r[3]) for r in found}
    assert len(got) == len(found)
    assert got == brute(queries, known, 4, mode, all_langs)


@pytest.mark.parametrize("n,k", [(1, 3), (7, 7), (700, 2), (1000, 5), (999, 1)])
def test_best_of_a_row(n, k):
    rng = np.random.default_rng(n)
    sims = np.round(rng.uniform(-1, 1, size=(20, n)), 2)
    sims[3], sims[4, : n // 2], sims[5, n // 2:] = 0.25, knn.NO_SIMILARITY, knn.EXCLUDED
    rows, cols, values, rank = knn._best(sims, k)
    for row in range(20):
        order = [c for c in np.lexsort((np.arange(n), -sims[row])) if sims[row, c] > knn.EXCLUDED][:k]
        assert cols[rows == row].tolist() == order and rank[rows == row].tolist() == list(range(1, len(order) + 1))
        assert values[rows == row].tolist() == sims[row, order].tolist()


@pytest.mark.parametrize("form", list(FORMS))
def test_lists_hold_the_same_hits(spark, form):
    asking = spark.createDataFrame(make(1, 40), SCHEMA).withColumnRenamed("id", "chunk_id")
    known = spark.createDataFrame(make(2, 60), SCHEMA)
    params = knn.KnnParams(k=3, mode="post", **FORMS[form])
    rows = {tuple(r) for r in knn.knn_join(asking, known, params).select("chunk_id", "rank", "id", "sim").collect()}
    lists = knn.attach_hits(asking, known, params).select("chunk_id", "hits").collect()
    assert len(lists) == 40 and {(r["chunk_id"], *h) for r in lists for h in r["hits"]} == rows
    assert all([h["rank"] for h in r["hits"]] == sorted(h["rank"] for h in r["hits"]) for r in lists)


@pytest.mark.parametrize("form", list(FORMS))
def test_few_or_no_knowledge_rows(spark, form):
    asking = spark.createDataFrame(make(1, 10), SCHEMA).withColumnRenamed("id", "chunk_id")
    known = spark.createDataFrame(make(2, 3), SCHEMA)
    params = knn.KnnParams(k=5, **FORMS[form])
    assert knn.knn_join(asking, known, params).count() == 30
    assert knn.knn_join(asking, known.filter("id < 0"), params).count() == 0
    assert knn.knn_join(asking.filter("chunk_id < 0"), known, params).count() == 0


@pytest.mark.parametrize("form", list(FORMS))
def test_queries_are_not_shuffled_nor_copied(spark, form):
    asking = spark.createDataFrame(make(1, 20), SCHEMA).withColumnRenamed("id", "chunk_id")
    known = spark.createDataFrame(make(2, 50), SCHEMA)
    plan = knn.knn_join(asking, known, knn.KnnParams(**FORMS[form]))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and not any(x in plan for x in ("Exchange", "Join", "CartesianProduct"))


@pytest.mark.parametrize("rows, calls", [(1, 5), (3, 4), (4, 3), (7, 2), (100, 1)])
def test_shares_hold_whole_batches_up_to_a_bound(rows, calls):
    batches = [(pa.array(range(at, at + n)),) for at, n in ((0, 3), (3, 1), (4, 2), (6, 2), (8, 4))]
    seen = []
    def work(columns):
        seen.append(len(columns[0]))
        return pa.compute.multiply(columns[0], 2)
    out = list(blocks.in_shares(iter(batches), rows, work))
    assert [len(x) for x in out] == [3, 1, 2, 2, 4] and pa.concat_arrays(out).to_pylist() == [2 * i for i in range(12)]
    assert len(seen) == calls and sum(seen) == 12


def test_a_task_reads_the_table_once(spark, tmp_path):
    """200 queries in four tasks and one share each: four reads of the stored knowledge, however many blocks and batches."""
    known = spark.createDataFrame(make(2, 50), SCHEMA).select("id", F.col("embedding").alias("vec"))
    stored, _ = blocks.store_blocks(known, "id")
    marks = str(tmp_path)
    def count(share):
        for _ in stored.read(["id"], 7):
            pass
        with open(f"{marks}/{uuid.uuid4().hex}", "w"):
            return share[0]

    @F.arrow_udf("bigint")
    def passed(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return blocks.in_shares(((b,) for b in it), 1000, count)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        assert spark.range(0, 200, 1, 4).select(passed("id").alias("x")).agg(F.sum("x")).first()[0] == sum(range(200))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(os.listdir(marks)) == 4


def test_blocks_come_in_id_order(spark):
    rows = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("id"))
    stored, table = blocks.store_blocks(rows, "id")
    assert [i for t in stored.read(["id"], 64) for i in t["id"].to_pylist()] == list(range(1000)) and table.count() == 1000


def test_other_widths_are_refused_or_counted(spark):
    known = spark.createDataFrame([(i, [1.0, float(i), 2.0], None, ["a"]) for i in range(8)], SCHEMA)
    asking = spark.createDataFrame([(1, [1.0, 2.0], "a", None), (2, [2.0, 2.0], "a", None)], SCHEMA).withColumnRenamed("id", "chunk_id")
    with pytest.raises(Exception, match="no query vector has the 3 components"):
        knn.knn_join(asking, known).collect()
    assert {tuple(r) for r in knn.vector_widths(asking.unionByName(asking.withColumn("embedding", F.lit(None).cast("array<float>")))).collect()} == {(2, 2), (None, 2)}


def test_context_of_doubled_and_unknown_ids(spark):
    known = spark.createDataFrame([(i, "s", "CWE-1", f"t{i}", "b", ["x"]) for i in (3, 1, 2, 2, 5)],
                                  "id long, source string, cwe_id string, title string, document string, examples array<string>")
    chunks = spark.createDataFrame([(1, [(1, 2), (2, 9), (3, 1)]), (2, []), (3, None), (4, [(1, 9)]), (5, [(1, 1)])], "chunk_id long, hits array<struct<rank:int,id:long>>")
    got = {r.chunk_id: r.context for r in prompts.attach_context(chunks, known, share_rows=2, block_rows=1).collect()}
    entry = lambda i: f"[CWE-1] t{i}\nb\nExamples:\n  - x"
    assert got == {1: entry(2) + "\n\n" + entry(1), 2: "", 3: "", 4: "", 5: entry(1)}
    hits = chunks.select("chunk_id", F.inline("hits"))
    assert {r.chunk_id: r.context for r in prompts.knowledge_context(hits, known).collect()} == {k: v for k, v in got.items() if v}


def test_vector_functions(values):
    rows = [([3.0, 4.0], [3.0, 4.0]), ([1.0, 0.0], [0.0, 2.0]), ([1.0, 0.0], [-2.0, 0.0]), ([0.0, 0.0], [1.0, 1.0])]
    schema = "a array<double>, b array<double>"
    assert values(rows, schema, lambda c: vectors.cosine_similarity(c("a"), c("b"))) == [1.0, 0.0, -1.0, None]
    assert values(rows, schema, lambda c: vectors.cosine_distance(c("a"), c("b"))) == [0.0, 1.0, 2.0, None]
    rows = [([1.0, 2.0],), (None,), ([1.0],)]
    assert values(rows, "a array<double>", lambda c: vectors.vector_or_zero(c("a"), 2)) == [[1.0, 2.0], [0.0, 0.0], [0.0, 0.0]]


def test_language_membership(values):
    rows = [(["a"], "a"), (["a"], "b"), ([], "a"), (["a"], None)]
    fits = lambda c: knn.language_fits(c("l"), c("x"))
    assert values(rows, "l array<string>, x string", fits) == [True, False, False, False]
    wide = lambda c: knn.language_fits(c("l"), c("x"), True)
    assert values(rows, "l array<string>, x string", wide) == [True, False, True, False]
    assert F is not None


def test_blocks_without_a_better_row_are_passed_over(monkeypatch):
    rng = np.random.default_rng(5)
    units = rng.normal(size=(200, 8))
    known = np.concatenate([np.repeat(units[:4], 2, axis=0), units[4:]])
    table = pa.table({"id": np.arange(len(known)), "vec": pa.array(known.tolist(), pa.list_(pa.float64()))})
    asked, best, ranked = units[:4], knn._KBest(4, 2), []
    asked = asked / np.linalg.norm(asked, axis=1)[:, None]
    monkeypatch.setattr(knn, "_best", lambda sims, k, real=knn._best: ranked.append(len(sims)) or real(sims, k))
    for at in range(0, len(known), 8):
        block = knn._Block(table.slice(at, 8), 8)
        best.add(block, block.top(asked, np.ones(4, bool), None, knn.KnnParams(k=2), best.sim[:, -1]))
    assert ranked == [4] and best.id.tolist() == [[0, 1], [2, 3], [4, 5], [6, 7]]


def test_a_share_counts_what_its_hits_take(monkeypatch):
    seen = []
    monkeypatch.setattr(knn, "in_shares", lambda batches, rows, work: seen.append(rows) or [])
    monkeypatch.setattr(knn.F, "arrow_udf", lambda kind: lambda f: type("Call", (), {"asNondeterministic": lambda self: lambda *c: list(f(iter(())))})())
    knn._hits(blocks.Blocks((), ("id", "vec")), 3, knn.KnnParams(k=5), knn.T.LongType(), None, None)
    assert seen[0] * 5 * 8 * 8 <= knn.KnnParams().share_bytes


def test_stored_blocks_are_read_as_streams(tmp_path):
    """A block of a file with one large row group takes far less than its column."""
    import pyarrow.parquet as pq
    text = [uuid.uuid4().hex * 64 for _ in range(20000)]
    pq.write_table(pa.table({"x": text}), tmp_path / "one", compression="none", use_dictionary=False)
    del text
    stored, most = blocks.Blocks((str(tmp_path / "one"),), ("x",)), 0
    before = pa.total_allocated_bytes()
    for table in stored.read(["x"], 10):
        assert table.num_rows <= 10
        most = max(most, pa.total_allocated_bytes() - before)
    assert most < 15 << 20


def test_vectors_are_held_once():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from auditmill.operators import blocks, knn
    flat = np.arange(20_000 * 64, dtype=np.float32) - 1e5
    flat[:2] = np.nan, np.inf
    column = pa.ListArray.from_arrays(pa.array(np.arange(0, 20_001 * 64, 64, dtype=np.int32)), pa.array(flat))
    tracemalloc.start()
    units, usable = knn._unit(column, 64)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1.7 * units.nbytes and usable.all()
    assert np.isclose(np.linalg.norm(units[1:], axis=1), 1).all() and units[0, 0] == 0
    assert flat[2] == 2 - 1e5, "the column is as it was"

    def work(share):
        held.append(pa.total_allocated_bytes() - before)
        return pa.compute.greater(share[0], -1)

    before, held, size = pa.total_allocated_bytes(), [], 8 * 50_000
    batches = ((pa.array(list(range(at, at + 50_000)), pa.int64()),) for at in range(0, 400_000, 50_000))
    out = [x for b in blocks.in_shares(batches, 200_000, work) for x in b.to_pylist()]
    assert out == [True] * 400_000 and len(held) == 2
    assert max(held) < 6 * size, "four batches as one, and the next one"
