"""Names that clash, characters that serve as marks, copies by the hundred, any number of languages, scripts without blanks."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from auditmill.llm import language, mixing, personal, shards, spans

INNER = ["_k1", "_k2", "_n", "_size", "_epochs", "_parts", "_part", "_copy", "_mark", "_shard", "_salt", "row", "id", "mark", "k1", "p", "n", "part", "copy", "size"]


def crowded(spark, rows):
    """Rows (doc_id, text, lang, source) with a column for each name that operators use inside; each holds its doc_id."""
    names = ", ".join(f"{c} long" for c in INNER)
    return spark.createDataFrame([(*r, *[r[0]] * len(INNER)) for r in rows], f"doc_id long, text string, lang string, source string, {names}").repartition(3)


def test_clashing_names_pass_through(spark, tmp_path):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(10 + i % 7)), "en", f"s{i % 3}") for i in range(40)]
    table = crowded(spark, rows)
    for out in (mixing.mixture(table), corpus_pipeline.near_duplicates(spark, table, ""), corpus_pipeline.personal_data(spark, table, "")):
        assert out.columns == table.columns and out.count() > 0
        assert out.filter(" OR ".join(f"{c} <> doc_id" for c in INNER)).count() == 0
    shards.write(table, str(tmp_path / "out"), shards.Tree(4), 2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 40 and back.filter("_shard <> doc_id OR _salt <> doc_id").count() == 0 and "_shard_" in back.columns


def test_copies_of_one_row_share_its_part(spark):
    """300 equal rows of 10 words and a few others: what is taken of the copies sums up to what `mix` says."""
    rows = [(1, "a b c d e f g h i j", "en", "x")] * 300 + [(i, "k l m n", "en", "y") for i in range(2, 300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(7)
    taken = {r.source: r.taken for r in mixing.mix(table).groupBy("source").agg(F.sum("taken").alias("taken")).collect()}
    words = F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0))
    out = {r.source: r.n for r in mixing.mixture(table).groupBy("source").agg(F.sum(words).alias("n")).collect()}
    assert out == taken


def test_marks_in_a_text_stay(values):
    texts = ["a\ue000b\ue001c\ue002d", "\ue000x@y.org \ue001", "\ue002\ue003\ue002\ue004\ue002\ue005", "mail x@y.org", None, "", "\ue002" * 3, "\ue005\ue000\ue003"]
    got = values([(t,) for t in texts], "t string", lambda c: personal.redacted(c("t")))
    assert got == [t and t.replace("x@y.org", "[EMAIL]") for t in texts]


def plain_place(key, tree):
    """The descent by the definition, in Python floats."""
    at = 0
    for level, parents in enumerate(tree.levels()):
        def draw(child, weight):
            digits = int(hashlib.md5(f"{level}:{child}:{key}".encode()).hexdigest()[:13], 16)
            return math.log((digits + 0.5) / 2 ** 52) / weight
        at = max(((draw(c, w), -c) for c, w in parents[at] if w > 0))[1] * -1
    return at


def test_shards_against_brute_force(docs):
    tree = shards.Tree(40, weights={3: 2.0, 17: 0.0})
    rows = [(i * 7 - 50, f"text {i}" * (i % 4)) for i in range(400)]
    got = {r.doc_id: r for r in shards.assign(docs(rows), tree).collect()}
    for key, text in rows:
        r = got[key]
        assert (r.shard, r.grown_shard) == (plain_place(key, tree), plain_place(key, tree.grown()))
        assert (r.size, r.text_crc32) == (len(text.encode()) + 16, zlib.crc32(text.encode()))
    for shard in {r.shard for r in got.values()}:
        mine = sorted((r.doc_id, r.slot) for r in got.values() if r.shard == shard)
        assert [s for _, s in mine] == list(range(len(mine)))


def plain_mixture(share, bins, n):
    """Languages and proportions by the same rule, one document and all languages at once, in plain loops."""
    p = share[:, bins].astype(float)
    total = n.sum()
    alone = [sum(c * math.log(x) for c, x in zip(n, row)) for row in p]
    chosen = [max(range(len(p)), key=lambda k: (alone[k], -k))]
    part, best = [1.0], alone[chosen[0]]
    worth = language.PENALTY * math.log(total + 1) * language.OVERLAP
    while len(chosen) < len(p):
        mixed = sum(a * p[k] for a, k in zip(part, chosen))
        slope = {k: float((p[k] / mixed * n).sum() - total) for k in range(len(p)) if k not in chosen}
        new = max(slope, key=lambda k: (slope[k], -k))
        if slope[new] <= worth:
            break
        tried, now = [*chosen, new], [*[0.9 * a for a in part], 0.1]
        for _ in range(language.STEPS):
            mixed = sum(a * p[k] for a, k in zip(now, tried))
            nxt = [a * float((p[k] / mixed * n).sum()) / total for a, k in zip(now, tried)]
            moved = max(abs(a - b) for a, b in zip(now, nxt))
            now = nxt
            if moved < 1e-4:
                break
        value = float((np.log(sum(a * p[k] for a, k in zip(now, tried))) * n).sum())
        if value - best <= worth:
            break
        chosen, part, best = tried, now, value
    return dict(zip(chosen, np.array(part) / sum(part)))


def test_mixtures_against_plain_loops_and_in_blocks(spark):
    rng = random.Random(4)
    vocabulary = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnop"[k:k + 6]) for _ in range(rng.randint(3, 7))) for _ in range(40)] for k in range(9)}
    rows = [(i, " ".join(rng.choices(vocabulary[name], k=60)), name) for i, name in enumerate(list(vocabulary) * 6)]
    rows += [(1000 + i, " ".join(rng.choices(vocabulary["l00"], k=50) + rng.choices(vocabulary["l05"], k=30 + i)), None) for i in range(8)]
    rows += [(2000, "", "l00"), (2001, None, "l01"), (2002, "123", "empty one")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    found = {}
    for most in (1, 4, 256):
        model = language.learn(table, F.lit(True), most=most)
        assert model.size == 10
        found[most] = {r.doc_id: r for r in language.identify(table, model).collect()}
    assert found[1] == found[4] == found[256]
    [(names, share)] = list(model.reader()())
    assert names == sorted([*vocabulary, "empty one"])
    mixed = 0
    for i, text, lang in rows:
        r = found[256][i]
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        data = np.frombuffer(text.encode(), np.uint8)
        _, bins = language.trigrams(data, np.array([0, len(data)]))
        bins, n = np.unique(bins, return_counts=True)
        want = plain_mixture(share, bins, n.astype(float))
        assert {x.lang for x in r.languages} == {names[k] for k in want}
        assert {x.lang: pytest.approx(x.share, abs=1e-6) for x in r.languages} == {names[k]: v for k, v in want.items()}
        mixed += len(want) > 1
    assert mixed >= 5


CHINESE = [chr(c) for c in range(0x4E00, 0x4F00)]


def test_repeats_in_scripts_without_blanks(docs):
    rng = random.Random(9)
    def sentences(n):
        return "".join("".join(rng.choices(CHINESE, k=19)) + rng.choice("。！？") for _ in range(n))
    whole, passage = sentences(30), sentences(8)
    rows = [(1, whole), (2, whole), (3, sentences(5) + passage + sentences(4)), (4, sentences(7) + passage + sentences(2)), (5, sentences(20)),
            (6, "混ざった text with words。" * 1 + sentences(3))]
    for kind in ({}, {"local_cuts": True, "grow": True}):
        got = {r.doc_id: r for r in spans.remove_repeats(docs(rows), **kind).collect()}
        assert got[1].text == whole and got[1].n_removed == 0 and got[1].n_sentences >= 30
        assert got[2].text == "" and got[2].n_removed == got[2].n_sentences
        assert got[3].text == rows[2][1] and got[5].text == rows[4][1] and got[6].text == rows[5][1]
        kept = sum(c in got[4].text for c in (passage[i:i + 20] for i in range(0, 160, 20)))
        assert kept <= 2 and rows[3][1].startswith(got[4].text[:100]) and len(got[4].text) < len(rows[3][1]) - 100
