"""The pipeline over the smallest tables and over awkward rows."""

import hashlib
import os
import re

import pytest

import corpus_pipeline
from auditmill.session import store

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not there")
def test_run(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = store(stage(spark, docs, FOLDER))
        assert out.columns == docs.columns and 0 < out.count()
        if name in ("quality rules", "near duplicates"):
            assert all(before[r.doc_id] == r for r in out.collect()) and out.count() < docs.count()
        if name == "personal data":
            assert out.count() == docs.count() and not out.filter(out.text.rlike(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[a-z]")).count()
        docs = out
    assert corpus_pipeline.run(spark, FOLDER).count() == docs.count()


def test_awkward_rows(spark, awkward, empty):
    long = re.sub(r"\s+", " ", "Some words of a text that is long enough to stay in the corpus, number {}. ") * 1
    docs = awkward.unionByName(spark.createDataFrame(
        [(100 + i, " ".join(f"{w}{i}" if k % 7 == 0 else f"{w}{k}" for k, w in enumerate(long.split() * 6)), "en", None, 1) for i in range(5)],
        awkward.schema))
    for table in (docs, empty):
        for _, stage in corpus_pipeline.STAGES:
            table = store(stage(spark, table, ""))
    assert table.columns[0] == "doc_id"


def test_near_duplicates_of_rows_that_share_an_id(spark, docs):
    one, two, three = (" ".join(f"{c}{k}" for k in range(60)) for c in "abc")
    near = one + " end"
    table = docs([(1, one), (2, near), (2, two), (2, two), (3, three), (3, three + " end"), (4, None), (4, ""), (4, ""), (None, one)])
    got = sorted(((r.doc_id or 0, r.text) for r in corpus_pipeline.near_duplicates(spark, table, "").collect()), key=str)
    assert [r for r in got if r[0] not in (3, 4)] == [(0, one), (1, one), (2, two)]
    assert len([r for r in got if r[0] == 3]) == 1 and sorted((r for r in got if r[0] == 4), key=str) == [(4, ""), (4, None)]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not there")
def test_near_duplicates_and_tokens_against_brute_force(spark):
    """Of each group of documents linked by shared shingles, found by comparing all pairs, the smallest id stays; ids and
    decoded texts are those of the tokenizer library."""
    spm, tokenizers = pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(lower))
        sets[r.doc_id] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    group = {i: i for i in sets}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                group[y] = x
    kept = store(corpus_pipeline.near_duplicates(spark, docs, FOLDER))
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [i for i in ids if top(i) == i]
    model = spm.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text or "" for r in kept.collect()}
    for r in corpus_pipeline.tokens(spark, kept, FOLDER).collect():
        found = model.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(found), hashlib.sha256(",".join(map(str, found)).encode()).hexdigest(), hashlib.sha256(model.decode(found).encode()).hexdigest())
