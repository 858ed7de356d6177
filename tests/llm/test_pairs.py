"""The Jaccard join, components and sentence spans against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from auditmill.llm import components, jaccard_join, spans, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k:k + 5]) for k in range(len(words) - 4))


def groups(rows):
    """(id, set size, smallest linked id) of rows with distinct ids."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for k, (i, s) in enumerate(sets):
        shared = Counter(j for g in s for j in holders.get(g, ()))
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j][1]) - n):
                a, b = find(i), find(sets[j][0])
                parent[max(a, b)] = min(a, b)
        for g in s:
            holders.setdefault(g, []).append(k)
    return sorted((i, len(s), find(i)) for i, s in sets)


def family(seed, sizes, copies, vocabulary):
    """Texts in families whose members are edits of each other, so many pairs lie near the threshold."""
    rng, rows = random.Random(seed), []
    for _ in range(60):
        texts = [[rng.choice(vocabulary) for _ in range(rng.choice(sizes))]]
        for _ in range(rng.randint(0, copies)):
            new = list(rng.choice(texts))
            for _ in range(rng.randint(0, max(1, len(new) // 25))):
                at = rng.randrange(len(new))
                if rng.random() < 0.5:
                    new[at] = rng.choice(vocabulary)
                else:
                    new.insert(at, rng.choice(vocabulary))
            texts.append(new)
        rows += texts
    rng.shuffle(rows)
    return [(i, " ".join(words)) for i, words in enumerate(rows)]


@pytest.mark.parametrize("seed, sizes", [(1, (1, 4, 5, 6, 8, 9, 10, 12)), (2, (15, 40, 90, 400))])
def test_groups(docs, seed, sizes):
    rows = family(seed, sizes, 10, [f"W{i}" for i in range(150)])
    got = jaccard_join.near_groups(docs(rows)).collect()
    assert sorted(tuple(r) for r in got) == groups(rows)


def test_large_group_of_near_copies_with_a_far_smallest_id(docs):
    base = [f"w{i}" for i in range(100)]
    rows = [(0, " ".join(base[:88] + ["z"] * 3))]
    rng = random.Random(5)
    for i in range(1, 150):
        words = list(base)
        for at in rng.sample(range(100), 2):
            words[at] = f"v{i}"
        rows.append((i, " ".join(words)))
    assert sorted(tuple(r) for r in jaccard_join.near_groups(docs(rows)).collect()) == groups(rows)


def test_awkward_rows(awkward, empty):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_groups(awkward).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 5, None), (5, 1, 5), (6, 1, 6), (7, 1, 7)} <= got
    assert jaccard_join.near_groups(awkward).count() == 11
    assert jaccard_join.near_groups(empty).collect() == []


def test_sketch_words_meet_for_every_linked_pair():
    rng = np.random.default_rng(3)
    common = np.zeros(1 << jaccard_join.SLOT_BITS, dtype=bool)
    for _ in range(300):
        n = int(rng.integers(4, 300))
        base = rng.integers(1, 2**63, n, dtype=np.uint64)
        drop = int(rng.integers(0, n // 5 + 1))
        other = base[drop:]
        if 100 * len(other) < 80 * n:
            continue
        size = np.array([n, len(other)])
        text = np.repeat([0, 1], size)
        hashes = np.concatenate([np.sort(base), np.sort(other)])
        band = np.maximum(np.searchsorted(jaccard_join.BANDS, size, side="right") - 1, 0)
        every = np.ones(2, dtype=bool)
        keys = [set(), set()]
        for joint, some in ((band, every), (np.maximum(band - 1, 0), band > 0)):
            for key, owner in zip(*jaccard_join.sketch_words(text, hashes, common, joint, some)):
                keys[owner].add(int(key))
        assert keys[0] & keys[1]


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1300)] + [(4, 4)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def sentences(text):
    places = [m.span() for m in WORD.finditer(text)]
    out, now = [], []
    for k, (a, b) in enumerate(places):
        if now and (text[places[k - 1][1] - 1] in ".!?" or "\n" in text[places[k - 1][1]:a] or len(now) == spans.LONGEST):
            out.append(now)
            now = []
        now.append((a, b))
    return out + ([now] if now else [])


def without_repeats(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        units = sentences(text)
        words = [tuple(text[a:b] for a, b in u) for u in units]
        gone, own = set(), set()
        for k in range(len(units) - spans.RUN + 1):
            run = tuple(words[k:k + spans.RUN])
            if sum(map(len, run)) >= spans.LEAST_WORDS:
                if run in own or run in seen:
                    gone |= set(range(k, k + spans.RUN))
                own.add(run)
        seen |= own
        cuts = [0, *(u[0][0] for u in units[1:]), len(text)]
        out[i] = ("".join(text[cuts[k]:cuts[k + 1]] for k in range(len(units)) if k not in gone) if units else text, len(units), len(gone))
    return out


def test_spans(docs):
    rng = random.Random(4)
    pool = [" ".join(rng.choice("aé b c d ee f".split()) for _ in range(rng.randint(1, 40))) + rng.choice([".", "!", "\n", "", "?\n"])
            for _ in range(40)]
    rows = [(i, rng.choice(["", " "]) + rng.choice([" ", "\n"]).join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(200)]
    got = {r.doc_id: tuple(r)[1:] for r in spans.remove_repeats(docs(rows)).collect()}
    assert got == without_repeats(rows)


def test_spans_of_awkward_rows(awkward, empty):
    got = sorted(((r.doc_id or 0, r.text) for r in spans.remove_repeats(awkward).collect()), key=str)
    assert (1, None) in got and (2, "") in got and (3, " \n\t") in got and got.count((5, "same row")) == 2 and len(got) == 11
    assert spans.remove_repeats(empty).collect() == []


def test_spans_find_passages_pasted_in_mid_sentence(docs):
    rng = random.Random(6)

    def words(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    rows = []
    for i in range(40):
        passage = words(50)
        rows += [(2 * i, " ".join([*words(rng.randint(0, 15)), *passage, *words(9)])),
                 (2 * i + 1, " ".join([*words(rng.randint(0, 15)), *passage, *words(9)]))]
    got = {r.doc_id: r for r in spans.remove_repeats(docs(rows), local_cuts=True).collect()}
    assert all(got[i].text == t for i, t in rows if i % 2 == 0)
    for i, t in rows:
        if i % 2:
            gone = Counter(t.split()) - Counter(got[i].text.split())
            assert gone and set(gone) <= set(rows[i - 1][1].split())


def test_spans_of_short_sentences(docs):
    rng = random.Random(7)
    words = [f"W{rng.randrange(10**6)}" for _ in range(60)]
    shouted, lines = "!! ".join(words[:30]) + "!!", "\n".join(words[30:])
    mixed = f"One of its own. {shouted} Two of its own."
    got = {r.doc_id: r.text for r in spans.remove_repeats(
        docs([(1, shouted), (2, shouted), (3, lines), (4, lines), (5, mixed), (6, "A few. Short. Ones.")]), grow=True).collect()}
    assert got[1] == shouted and got[3] == lines and got[6] == "A few. Short. Ones."
    assert got[2] == "" and got[4] == "" and got[5] == "One of its own. Two of its own."


def test_grown_runs():
    text = np.array([0] * 12 + [1] * 4 + [2] * 2)
    size = np.array([1] * 12 + [5, 1, 1, 3] + [9, 9])
    hashes = np.arange(len(text), dtype=np.uint64)
    first, _, length = spans._grown(text, hashes, np.concatenate([[0], np.cumsum(size)]))
    assert list(zip(first, length)) == [(0, 8), (1, 8), (2, 8), (3, 8), (4, 8), (12, 4)]


def test_spans_of_rows_that_share_an_id(docs):
    rng = random.Random(8)

    def passage():
        return " ".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(6)) + "." for _ in range(4))

    a, b, c = passage(), passage(), passage()
    rows = [(None, f"{a} {passage()}") for _ in range(5)] + [(7, f"{b} {passage()}") for _ in range(3)] + [(9, c)] * 3 + [(8, c)]
    got = [(r.doc_id, r.text) for r in spans.remove_repeats(docs(rows)).collect()]
    assert len(got) == len(rows) and sorted(i or 0 for i, _ in got) == sorted(i or 0 for i, _ in rows)
    assert [i for i, t in got if a in t] == [None] and [i for i, t in got if b in t] == [7] and [i for i, t in got if c in t] == [8]
    assert sum(t == "" for i, t in got if i == 9) == 3


def word_hash(word, known={}):
    """The hash that decides cuts; the rest of the rule is restated below."""
    if word not in known:
        data = np.frombuffer(word.encode(), np.uint8)
        known[word] = int(words.words_of(data, np.array([0, len(data)])).hash[0])
    return known[word]


def pieces_by_words(text):
    """Sentences, cut after the word of least hash (the last of equal ones) of each WINDOW words in them."""
    places, out, sentence = [m.span() for m in WORD.finditer(text)], [], []
    for k, (a, b) in enumerate(places):
        sentence.append((a, b))
        if k + 1 == len(places) or text[b - 1] in ".!?" or "\n" in text[b:places[k + 1][0]]:
            hashes = [word_hash(text[x:y]) for x, y in sentence]
            cuts = {max(range(i, i + spans.WINDOW), key=lambda j: (-hashes[j], j)) for i in range(len(sentence) - spans.WINDOW + 1)}
            now = []
            for j, place in enumerate(sentence):
                now.append(place)
                if j in cuts or j + 1 == len(sentence):
                    out.append(now)
                    now = []
            sentence = []
    return out


def without_grown_repeats(rows):
    """What the registered query returns: local cuts, and runs that grow to LEAST_WORDS words."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        units = pieces_by_words(text)
        said = [tuple(text[a:b] for a, b in u) for u in units]
        gone, own = set(), set()
        for k in range(len(units)):
            end = k + spans.RUN
            while end <= len(units) and sum(map(len, said[k:end])) < spans.LEAST_WORDS:
                end += 1
            if end > len(units):
                continue
            run = tuple(said[k:end])
            if run in own or run in seen:
                gone |= set(range(k, end))
            own.add(run)
        seen |= own
        cuts = [0, *(u[0][0] for u in units[1:]), len(text)]
        out[i] = ("".join(text[cuts[k]:cuts[k + 1]] for k in range(len(units)) if k not in gone) if units else text, len(units), len(gone))
    return out


def test_spans_as_registered(docs):
    rng = random.Random(12)
    vocabulary = [f"{c}{k}" for c in "aéz" for k in range(12)]
    pool = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40))) + rng.choice([".", "!", "\n", "", "?\n"]) for _ in range(30)]
    rows = [(i, rng.choice(["", " "]) + rng.choice([" ", "\n"]).join(rng.choice(pool) for _ in range(rng.randint(0, 10)))) for i in range(150)]
    got = {r.doc_id: tuple(r)[1:] for r in spans.remove_repeats(docs(rows), local_cuts=True, grow=True).collect()}
    assert got == without_grown_repeats(rows) and sum(v[2] for v in got.values()) > 100
