"""N-gram Jaccard join by parity sketches (operator 6).

A document's set holds the hashes of its distinct 5-word shingles. Each hash is XORed into one of P
64-bit words of a sketch, chosen by the hash, so two sketches differ in at most |A xor B| words. Sets
are joined per size band: linked sets of a band differ in at most D shingles, so P = D + 1 + E sketches
words leave at least E + 1 equal ones (pigeonhole). A set enters the join with its D + 1 strongest words
by an order that is a function of the word alone (shingles that few documents share first); the strongest
equal word is then kept on both sides, so no link is lost and words of common passages stay out.

Sets that share a word are compared with the smallest set of the bucket; then, in buckets that still hold
several components, with the nearest set of another component, twice; then all pairs that are left, block by
block. A second parity sketch with one bit a shingle bounds
the symmetric difference from below and rejects most candidates; the rest are verified on the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditmill.llm import words as W
from auditmill.llm.batches import bound_batches
from auditmill.llm.components import components
from auditmill.session import store

SHINGLE = 5
SPARE = 0.25          # E as a share of D + 1
SEEDS = 6             # ways to deal shingles to words before empty words count
SLOT_BITS = 22        # counters of shingle frequency; a fixed size whatever the input
COMMON_SHARE = 2000   # a shingle is common if one in so many documents has it
TASK_FLOOR = 4        # counts below this in a task are not reported
FILTER_BITS = 24      # bitmap of the documents whose texts are fetched; a fixed size
MINI_WORDS = 8        # 64-bit words of the folded bit sketch
BLOCK = 4096


def _bands() -> np.ndarray:
    """First sizes of the bands: a set and one up to 5/4 as large are in the same or adjacent bands."""
    first = [1]
    while first[-1] < 1 << 40:
        first.append(max(first[-1] + 1, 5 * (first[-1] - 1) // 4 + 1))
    return np.array(first, dtype=np.int64)


BANDS = _bands()


def most_apart(size: np.ndarray) -> np.ndarray:
    """Most shingles that a set of `size` and a linked one up to 5/4 as large can differ in."""
    return (size + size * 5 // 4) // 9


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct shingles of each text, ordered by both."""
    tokens = W.words_of(data, offsets, lower=True)
    first, hashes = W.windows(tokens, SHINGLE)
    text = tokens.text[first]
    count = np.bincount(tokens.text, minlength=len(offsets) - 1)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):  # the whole sequence, apart from any shingle
        begin = np.concatenate([[0], np.cumsum(count)])
        with np.errstate(over="ignore"):
            total = np.zeros(len(short), dtype=np.uint64)
            factor = np.uint64(1)
            for k in range(SHINGLE - 1):
                at = begin[short] + k
                has = count[short] > k
                total[has] += tokens.hash[at[has]] * factor
                factor = factor * W.BASE
            whole = W.mix(total + W.mix(count[short].astype(np.uint64) + np.uint64(7)))
        text, hashes = np.concatenate([text, short]), np.concatenate([hashes, whole])
    if len(offsets) <= 1 << 14:  # one sort by text and the leading 50 bits, as good as by both
        order = np.argsort((text.astype(np.uint64) << np.uint64(50)) | (hashes >> np.uint64(14)))
    else:
        order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    return text[new], hashes[new]


def _sizes_and_ids(text: np.ndarray, hashes: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size, first element and 64-bit identity of each set."""
    sizes = np.bincount(text, minlength=texts)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    full = np.flatnonzero(sizes)
    ids = np.zeros(texts, dtype=np.uint64)
    if len(full):
        with np.errstate(over="ignore"):
            ids[full] = W.mix(np.add.reduceat(W.mix(hashes), begin[full]) ^ sizes[full].astype(np.uint64))
    return sizes, begin, ids


def _mini(text: np.ndarray, hashes: np.ndarray, texts: int) -> np.ndarray:
    """One parity bit a shingle, folded to MINI_WORDS words; its Hamming distance is at most |A xor B|."""
    bits = MINI_WORDS * 64
    odd = np.bincount(text * bits + (hashes % np.uint64(bits)).astype(np.int64), minlength=texts * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(texts, bits), axis=1)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, identity and sketch of each text's set; columns from the third on pass through."""
    for batch in batches:
        for first, data, offsets in W.slices(batch.column(1)):
            n = len(offsets) - 1
            text, hashes = shingle_sets(data, offsets)
            sizes, _, ids = _sizes_and_ids(text, hashes, n)
            sketch = _mini(text, hashes, n)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(first, n), pa.array(sizes.astype(np.int64)), pa.array(ids.view(np.int64)),
                pa.array([row.tobytes() for row in sketch], pa.binary()), *[c.slice(first, n) for c in batch.columns[2:]]],
                names=["id", "n", "sid", "sketch", *batch.schema.names[2:]])


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters of shingles over the distinct sets of a task."""
    counts = np.zeros(1 << SLOT_BITS, dtype=np.int32)
    for batch in batches:
        for _, data, offsets in W.slices(batch.column(0)):
            text, hashes = shingle_sets(data, offsets)
            _, _, ids = _sizes_and_ids(text, hashes, len(offsets) - 1)
            _, once = np.unique(ids, return_index=True)
            chosen = np.zeros(len(offsets) - 1, dtype=bool)
            chosen[once] = True
            slots, n = np.unique(hashes[chosen[text]] >> np.uint64(64 - SLOT_BITS), return_counts=True)
            counts[slots.astype(np.int64)] += n.astype(np.int32)
    slot = np.flatnonzero(counts >= TASK_FLOOR)
    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(counts[slot].astype(np.int64))], names=["slot", "n"])


def common_shingles(texts: DataFrame) -> np.ndarray:
    """Bitmap of the shingle slots that are common. It only orders words, it never drops a link.

    At most COMMON_SHARE times the mean set size of slots pass, and never more than 2**SLOT_BITS."""
    docs = texts.count()
    found = (texts.mapInArrow(_frequent, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
             .filter(F.col("n") >= max(2 * TASK_FLOOR, docs // COMMON_SHARE)).select("slot").toArrow())
    marks = np.zeros(1 << SLOT_BITS, dtype=bool)
    marks[found.column(0).to_numpy()] = True
    return marks


def sketch_words(text: np.ndarray, hashes: np.ndarray, common: np.ndarray, band: np.ndarray,
                 chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, set number) of the D + 1 strongest sketch words of each chosen set, in its joint band.

    A set with fewer full words than D + 1 is dealt out anew under the next seed as well: a pair without a
    full equal word has two such sets. What is left after the last seed also gives its empty words."""
    keys, owners = [], []
    keep = most_apart(BANDS[band + 1] - 1) + 1
    parts = keep + np.ceil(SPARE * keep).astype(np.int64)
    for seed in range(SEEDS):
        take = chosen[text]
        owner, value = text[take], hashes[take]
        if not len(owner):
            break
        part = ((W.mix(value + np.uint64(seed)) >> np.uint64(32)) * parts[owner].astype(np.uint64)) >> np.uint64(32)
        place = (owner.astype(np.uint64) << np.uint64(32)) | part
        order = np.argsort(place, kind="stable")
        owner, value, place = owner[order], value[order], place[order]
        start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        rare = ~common[(value >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
        tokens = np.diff(np.append(start, len(place)))
        strength = np.minimum(np.add.reduceat(rare.astype(np.int64), start), 3) * 4 + np.minimum(tokens, 3)
        word = np.bitwise_xor.reduceat(value, start)
        owner, part = owner[start], place[start] & np.uint64(0xFFFFFFFF)
        full = np.bincount(owner, minlength=len(chosen))
        lacking = np.flatnonzero(chosen & (full < keep))
        if seed == SEEDS - 1:
            for at in lacking.tolist():
                empty = np.setdiff1d(np.arange(parts[at], dtype=np.uint64), part[owner == at])
                owner = np.append(owner, np.full(len(empty), at))
                part, word = np.append(part, empty), np.append(word, np.zeros(len(empty), np.uint64))
                strength = np.append(strength, np.zeros(len(empty), np.int64))
        with np.errstate(over="ignore"):
            place = part + (band[owner].astype(np.uint64) << np.uint64(40)) + (np.uint64(seed) << np.uint64(56))
            key = W.mix(word + W.mix(place))
        order = np.lexsort((key, -strength, owner))
        owner, key = owner[order], key[order]
        run = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        rank = np.arange(len(owner)) - np.repeat(run, np.diff(np.append(run, len(owner))))
        kept = rank < keep[owner]
        keys.append(key[kept])
        owners.append(owner[kept])
        chosen = np.zeros(len(chosen), dtype=bool)
        chosen[lacking] = True
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def _words(common: np.ndarray):
    """The sketch words of each distinct set of a task: copies in one task count once (8 bytes a set are held)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, data, offsets in W.slices(batch.column(0)):
                text, hashes = shingle_sets(data, offsets)
                sizes, _, ids = _sizes_and_ids(text, hashes, len(offsets) - 1)
                chosen = np.zeros(len(sizes), dtype=bool)
                for at, sid in enumerate(ids.tolist()):
                    if sizes[at] and sid not in seen:
                        seen.add(sid)
                        chosen[at] = True
                band = np.maximum(np.searchsorted(BANDS, sizes, side="right") - 1, 0)
                lower = chosen & (band > 0)
                lower &= sizes <= (BANDS[band] - 1) * 5 // 4
                for joint, some in ((band, chosen), (np.maximum(band - 1, 0), lower)):
                    key, owner = sketch_words(text, hashes, common, joint, some)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(ids[owner].view(np.int64))], names=["key", "sid"])
    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column(2), batch.column(3)
        step = max(1, int(batch.num_rows * W.SLICE_BYTES / max(1, left.nbytes + right.nbytes)))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            both = pa.concat_arrays([part.column(2).cast(pa.large_string()), part.column(3).cast(pa.large_string())])
            n, found, size = part.num_rows, [], np.zeros(2 * part.num_rows, np.int64)
            for first, data, offsets in W.slices(both):
                text, hashes = shingle_sets(data, offsets)
                size[first:first + len(offsets) - 1] = np.bincount(text, minlength=len(offsets) - 1)
                found.append(W.of_text((text + first) % n, hashes))
            keys = np.concatenate(found)
            # A key occurs once a side; one that occurs twice is shared. Its pair: recomputed by position.
            owner = np.repeat(np.arange(2 * n) % n, size)
            order = np.argsort(keys, kind="stable")
            twice = order[1:][keys[order][1:] == keys[order][:-1]]
            shared = np.bincount(owner[twice], minlength=n)
            union = size[:n] + size[n:] - shared
            yes = pa.array((100 * shared >= 80 * union) & (union > 0))
            yield pa.RecordBatch.from_arrays([part.column(0).filter(yes), part.column(1).filter(yes)], names=["a", "b"])


def _close(n_a, n_b, sketch_a, sketch_b):
    """Sizes within 4/5 and Hamming distance within the most that linked sets differ in."""
    apart = F.bit_count(F.lit(0).cast("long"))
    for k in range(MINI_WORDS):
        def word(s, k=k):
            return F.conv(F.hex(F.substring(s, 8 * k + 1, 8)), 16, -10).cast("long")
        apart = apart + F.bit_count(word(sketch_a).bitwiseXOR(word(sketch_b)))
    return (5 * F.least(n_a, n_b) >= 4 * F.greatest(n_a, n_b)) & (9 * apart <= n_a + n_b)


def _links(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of set ids that are linked: sketches first, then whole texts."""
    one = sets.select("sid", "n", "sketch")
    close = (pairs.join(one.toDF("a", "n_a", "s_a"), "a").join(one.toDF("b", "n_b", "s_b"), "b")
             .filter(_close(F.col("n_a"), F.col("n_b"), F.col("s_a"), F.col("s_b"))).select("a", "b"))
    close = store(close)
    wanted = store(close.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
                   .join(sets.select("sid", "rep"), "sid"))
    size = 1 << FILTER_BITS
    slots = (wanted.select(F.pmod(F.xxhash64("rep"), F.lit(size)).alias("slot")).distinct()).toArrow()
    marks = np.zeros(size, dtype=bool)
    marks[slots.column(0).to_numpy()] = True
    marks = np.packbits(marks)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(marks).view(bool)
        for batch in batches:
            some = batch.filter(pa.array(bits[batch.column(2).to_numpy()]))
            for first, data, offsets in W.slices(some.column(1)):
                n = len(offsets) - 1
                _, _, ids = _sizes_and_ids(*shingle_sets(data, offsets), n)
                yield pa.RecordBatch.from_arrays([some.column(0).slice(first, n), pa.array(ids.view(np.int64)),
                                                  some.column(1).slice(first, n)], names=["rep", "sid", "text"])

    texts = (docs.select("id", "text", F.pmod(F.xxhash64("id"), F.lit(size)).alias("slot"))
             .mapInArrow(fetch, "rep long, sid long, text string")
             .join(wanted, ["rep", "sid"]).select("sid", "text"))
    texts = store(texts.dropDuplicates(["sid"]))
    both = (close.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a")
            .select("a", "b", "text_a", "text_b"))
    return store(both.mapInArrow(_verify, "a long, b long"))


def _apart(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, row, Hamming distance) of pairs of different components in a bucket block whose sizes and sketches
    allow a link. Rows come sorted by group."""
    group, comp, n, side = (t.column(c).to_numpy() for c in ("grp", "comp", "n", "side"))
    sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint64).reshape(-1, MINI_WORDS)
    for d in range(1, len(group)):
        i = np.flatnonzero(group[d:] == group[:-d])
        if not len(i):
            break
        j = i + d
        ok = ((comp[i] != comp[j]) & (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j]))
              & ((side[i] != side[j]) | (side[i] == 2)))
        i, j = i[ok], j[ok]
        apart = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1)
        ok = 9 * apart <= n[i] + n[j]
        yield i[ok], j[ok], apart[ok]


def _nearest(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row the pair with the nearest sketch."""
    rows = np.arange(t.num_rows)
    best, partner = np.full(t.num_rows, np.iinfo(np.int64).max), np.full(t.num_rows, -1)
    for i, j, apart in _apart(t):
        for one, other in ((i, j), (j, i)):  # a row occurs once on a side
            nearer = apart < best[one]
            best[one[nearer]], partner[one[nearer]] = apart[nearer], other[nearer]
    has = partner >= 0
    yield rows[has], partner[has]


def _all(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i, j, _ in _apart(t):
        yield i, j


def _cross(choose):
    """Pairs of set ids that `choose` takes from each bucket block; the same pair is given once a batch or so."""
    def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
        sid = t.column("sid").to_numpy()
        for i, j in choose(t):
            if len(i):
                a, b = np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j])
                once = np.unique(np.stack([a, b], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(once[:, 0]), pa.array(once[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            rest = t if rest is None else pa.concat_tables([rest, t])
            group = rest.column("grp").to_numpy()
            cut = int(np.flatnonzero(group != group[-1])[-1]) + 1 if len(group) and (group != group[-1]).any() else 0
            if cut:
                yield from emit(rest.slice(0, cut).combine_chunks())
                rest = rest.slice(cut)
        if rest is not None and rest.num_rows:
            yield from emit(rest.combine_chunks())
    return run


def _open_rows(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, sid, comp, m): the rows of buckets that hold several components, m sets in a bucket. `shared` has a set once a bucket."""
    labelled = (shared.join(labels.toDF("sid", "comp"), "sid", "left")
                .select("key", "sid", F.coalesce("comp", "sid").alias("comp")))
    several = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                          F.count("*").alias("m")).filter("lo <> hi").select("key", "m")
    return labelled.join(several, "key")


def _open_pairs(rows: DataFrame, sets: DataFrame, choose) -> DataFrame:
    """Pairs of sets that share a bucket but not yet a component, within the sketch bound. A bucket is cut into
    blocks of about BLOCK rows; each pair of blocks is a group, so no task holds a whole bucket."""
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("sid"), blocks).cast("int")
    dealt = (rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .select("sid", "comp", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("grp"),
                     F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side")))
    dealt = dealt.join(sets.select("sid", "n", "sketch"), "sid")
    return (dealt.repartition("grp").sortWithinPartitions("grp", "sid")
            .select("grp", "sid", "comp", "n", "side", "sketch").mapInArrow(_cross(choose), "a long, b long").distinct())


LINKABLE = "n > 0 AND id IS NOT NULL"


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, n, sid, sketch, ...) of each row of `docs` (id, text, ... of longs) and (sid, comp, component_id) of each
    set: its component, told apart by a set id, and the smallest id in it."""
    bound_batches(docs.sparkSession)
    raw = store(docs.mapInArrow(_sets, ", ".join(["id long, n long, sid long, sketch binary", *[f"{c} long" for c in docs.columns[2:]]])))
    docs = docs.filter("id IS NOT NULL")
    sets = store(raw.filter(LINKABLE).groupBy("sid").agg(F.min("n").alias("n"), F.min("sketch").alias("sketch"),
                                                        F.min("id").alias("rep")))
    common = common_shingles(docs.select("text"))
    bucket = Window.partitionBy("key")
    shared = store(docs.select("text").mapInArrow(_words(common), "key long, sid long")
                   .withColumns({"lo": F.min("sid").over(bucket), "hi": F.max("sid").over(bucket)})
                   .filter("lo <> hi").select("key", "sid", "lo").distinct())
    first = store(shared.filter("sid <> lo").select(F.col("lo").alias("a"), F.col("sid").alias("b")).distinct())
    links, known = _links(first, sets, docs), first
    buckets, labels = shared.select("key", "sid"), components(links)
    for choose in (_nearest, _nearest, _all):
        rows = store(_open_rows(buckets, labels))
        found = store(_open_pairs(rows, sets, choose))
        if found.isEmpty():
            break
        more = store(found.join(known, ["a", "b"], "left_anti"))
        links, known = links.union(_links(more, sets, docs)), known.union(more)
        buckets, labels = rows.select("key", "sid"), components(links)
    named = (sets.join(labels.toDF("sid", "comp"), "sid", "left")
             .select("sid", "rep", F.coalesce("comp", "sid").alias("comp")))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    return raw, named.join(least, "comp")


def near_groups(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of each row of `documents`: groups of documents linked by a 5-word shingle
    Jaccard similarity of 0.8 or more, named by their smallest id.

    A null or blank text has no shingles and is linked with nothing; equal sets are linked. A row with a null id
    is linked with nothing and its component is null. Repeated rows give repeated rows, an empty table an empty
    one; further columns are not read.
    """
    raw, named = _grouped(documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")))
    linkable = F.expr(LINKABLE)
    grouped = raw.filter(linkable).select("id", "n", "sid").join(named.select("sid", "component_id"), "sid").select("id", "n", "component_id")
    alone = raw.filter(~linkable | F.col("id").isNull()).select("id", "n", F.col("id").alias("component_id"))
    return grouped.union(alone).select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id")


def firsts(documents: DataFrame, mark: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, mark) of the row with the smallest id, then the smallest `mark` (a long that tells rows of one id apart),
    of each group of `near_groups`, and of each row without shingles. Rows with a null id are left out."""
    raw, named = _grouped(documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"), mark.alias("mark")))
    least = F.min(F.struct("id", "mark")).alias("row")
    of_sets = raw.filter(LINKABLE).groupBy("sid").agg(least).select("sid", "row.*")
    of_groups = of_sets.join(named.select("sid", "comp"), "sid").groupBy("comp").agg(least).select("row.*")
    alone = raw.filter("n = 0 AND id IS NOT NULL").select("id", "mark").distinct()
    return of_groups.union(alone).toDF(id_column, "mark")
