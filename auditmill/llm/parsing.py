"""Document fingerprints by locally consistent parsing (operator 4).

A text is a string of symbols, its code points. On each level runs of one symbol become one, deterministic coin
tossing against the symbol on the left reduces names to a few labels, local maxima of the labels open phrases, and a
phrase's hash is its name, a symbol of the next level. Where a phrase begins depends on a few neighbours only, so
equal substrings are cut alike inside, wherever they stand. Phrases at least halve from level to level.

A fingerprint is the name of the whole text and the SKETCH smallest hashes among the names of level LEAST_LEVEL and
above. The likeness of two is the Jaccard similarity of these name sets, estimated from the smallest hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditmill.llm.batches import bound_batches
from auditmill.llm.words import BASE, mix

LEAST_LEVEL = 2
SKETCH = 48
TOSSES = 3
CHARS = 1 << 16        # code points worked on at once, for the processor's cache; a longer text is worked on alone
BUCKETS_PER_TASK = 4


def _toss_table() -> np.ndarray:
    """Label of (label, label on the left) below 128: twice the lowest differing bit, plus the bit."""
    a, b = np.divmod(np.arange(1 << 14), 128)
    low = (a ^ b) & -(a ^ b)
    place = np.bitwise_count(np.maximum(low, 1) - 1)
    return (2 * place + ((a >> place) & 1)).astype(np.uint8)


_TOSS = _toss_table()


def _labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels after TOSSES rounds; neighbours differ. `first` marks the first symbol of a text."""
    left = np.empty_like(names)
    left[0], left[1:] = 0, names[:-1]
    left[first] = 0
    apart = names ^ left
    low = apart & (~apart + np.uint64(1))
    place = np.bitwise_count(low - np.uint64(1)).astype(np.uint64)
    label = (2 * place + ((names >> np.minimum(place, np.uint64(63))) & np.uint64(1))).astype(np.int16)
    label &= 127
    for _ in range(TOSSES - 1):
        left = np.empty_like(label)
        left[0], left[1:] = 127, label[:-1]
        left[first] = 127
        label = _TOSS[(label << 7) | left].astype(np.int16)
    return label


def parse(symbols: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(root name of each text, text number, name) of the phrases of level LEAST_LEVEL and above, and the roots.

    `symbols` are the code points of all texts in order, `text` their text numbers."""
    roots = np.zeros(texts, dtype=np.uint64)
    names, owners, kept = mix(symbols), text, []
    level = 0
    with np.errstate(over="ignore"):
        while len(names):
            first = np.ones(len(names), dtype=bool)
            first[1:] = owners[1:] != owners[:-1]
            # Runs of one symbol.
            begin = first.copy()
            begin[1:] |= names[1:] != names[:-1]
            if not begin.all():
                start = np.flatnonzero(begin)
                length = np.diff(np.append(start, len(names)))
                names, owners, first = names[start], owners[start], first[start]
                long = length > 1
                names[long] = mix(names[long] + length[long].astype(np.uint64) * BASE)
            if level >= LEAST_LEVEL:
                kept.append((owners, names))
            # A text of one symbol is named.
            last = np.append(first[1:], True)
            done = first & last
            if done.any():
                roots[owners[done]] = names[done]
                if level < LEAST_LEVEL:
                    kept.append((owners[done], names[done]))
                names, owners, first = names[~done], owners[~done], first[~done]
                if not len(names):
                    break
            label = _labels(names, first)
            opens = first.copy()
            inner = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~first[1:-1] & ~first[2:]
            opens[1:-1] |= inner
            start = np.flatnonzero(opens)
            length = np.diff(np.append(start, len(names)))
            place = np.arange(len(names)) - np.repeat(start, length)
            powers = np.full(int(length.max()), BASE, dtype=np.uint64)
            powers[0] = 1
            powers = np.cumprod(powers)
            total = np.add.reduceat(names * powers[place], start)
            level += 1
            names, owners = mix(total + mix(length.astype(np.uint64) + (np.uint64(level) << np.uint64(32)))), owners[start]
    if not kept:
        return roots, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return roots, np.concatenate([o for o, _ in kept]), np.concatenate([n for _, n in kept])


def fingerprints(texts: list[str]) -> list[tuple[int, np.ndarray]]:
    """(root name, sorted smallest hashes) of each text."""
    out: list[tuple[int, np.ndarray]] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHARS):
            size += len(texts[end])
            end += 1
        part = texts[at:end]
        symbols = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        lengths = np.array([len(t) for t in part], dtype=np.int64)
        roots, owners, names = parse(symbols, np.repeat(np.arange(len(part)), lengths), len(part))
        key = np.sort((owners.astype(np.uint64) << np.uint64(32)) | (mix(names) >> np.uint64(32)))
        key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        cut = np.searchsorted(key, np.arange(len(part) + 1, dtype=np.uint64) << np.uint64(32))
        low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        out.extend((int(roots[i]), low[cut[i]:cut[i + 1]][:SKETCH]) for i in range(len(part)))
        at = end
    return out


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Estimated Jaccard similarity of the name sets of two fingerprints; 1 for equal ones."""
    if a[0] == b[0]:
        return 1.0
    if not len(a[1]) or not len(b[1]):
        return 0.0
    both, n = np.unique(np.concatenate([a[1], b[1]]), return_counts=True)
    return float((n[:SKETCH] == 2).mean())


def written(fingerprint: tuple[int, np.ndarray]) -> str:
    """A fingerprint as text: the root, then the hashes, in hexadecimal; empty for an empty text."""
    root, hashes = fingerprint
    return f"{root:016x}." + hashes.astype(">u4").tobytes().hex() if len(hashes) else ""


def read(fingerprint: str) -> tuple[int, np.ndarray]:
    """The fingerprint that `written` wrote."""
    if not fingerprint:
        return 0, np.zeros(0, np.uint32)
    root, _, hashes = fingerprint.partition(".")
    return int(root, 16), np.frombuffer(bytes.fromhex(hashes), dtype=">u4").astype(np.uint32)


RESULT = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
GROUP, GROUP_CHARS = 256, 1 << 22  # documents, and code points of their texts, compared together


def _dealt(bounds: np.ndarray, least: int | None):
    """Rows with their bucket. The first document of a bucket goes to the bucket before as well, as its follower;
    the very first follows the last bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            known = ~np.asarray(batch.column(0).is_null())
            plain = np.where(known, np.nan_to_num(ids), 0).astype(np.int64) if not known.all() else ids.astype(np.int64)
            bucket = np.searchsorted(bounds, plain, side="right")
            bucket[~known] = np.arange((~known).sum()) % (len(bounds) + 1)
            kind = np.where(known, 0, 2)
            opens = known & (np.isin(plain, bounds) | (plain == least))
            rows = np.concatenate([np.arange(len(ids)), np.flatnonzero(opens)])
            before = np.where(plain[opens] == least, len(bounds), bucket[opens] - 1)
            out = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([bucket, before]).astype(np.int32)),
                 pa.array(np.concatenate([kind, np.ones(opens.sum(), np.int64)]).astype(np.int32)), *out.columns],
                names=["bucket", "kind", "id", "text", "h"])
    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int | None, str]]:
    for batch in batches:
        for bucket, kind, key, text in zip(*(batch.column(i) for i in range(4))):
            yield bucket.as_py(), kind.as_py(), key.as_py(), text.as_py()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of documents in order; each waits for the one that follows."""
    def result(group: list[tuple[int | None, str, str, bool]]) -> pa.RecordBatch:
        edited = []
        for _, text, follower, _ in group:
            q = len(text) // 4
            edited.append(text[:len(text) - q] + follower[:q])
        # A follower is mostly the next document of the group: its fingerprint is shared.
        whole = fingerprints([text for _, text, _, _ in group])
        shared = [i + 1 < len(group) and group[i][2] is group[i + 1][1] for i in range(len(group))]
        other = iter(fingerprints([g[2] for g, s in zip(group, shared) if not s]))
        following = [whole[i + 1] if s else next(other) for i, s in enumerate(shared)]
        changed = fingerprints(edited)
        return pa.RecordBatch.from_arrays([
            pa.array([g[0] for g in group], pa.int64()), pa.array([len(g[1]) for g in group], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
            pa.array([written(f) for f in whole]), pa.array([written(f) for f in changed]),
            pa.array([likeness(a, b) for a, b in zip(whole, changed)], pa.float64()),
            pa.array([None if g[3] else likeness(a, b) for a, b, g in zip(whole, following, group)], pa.float64())],
            names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    group: list[tuple[int | None, str, str, bool]] = []
    waiting: tuple[int, int | None, str] | None = None
    size = 0
    for bucket, kind, key, text in _rows(batches):
        if waiting is not None and waiting[0] == bucket and kind < 2:
            group.append((waiting[1], waiting[2], text, False))
            size += 3 * len(waiting[2])
            waiting = None
        if kind == 2:
            group.append((key, text, text, True))
            size += 3 * len(text)
        elif kind == 0:
            waiting = (bucket, key, text)
        if len(group) >= GROUP or size > GROUP_CHARS:
            yield result(group)
            group, size = [], 0
    if group:
        yield result(group)


def compare_neighbours(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The edited text is the text with its last floor(n_chars / 4) code points replaced by the first as many (or all) of
    the next document by ascending id, after the last the first. A null text is empty; an empty text has an empty
    fingerprint, like only to another empty one. Rows with the same id follow each other by a hash of their texts. A
    row with a null id has no place in the order: it is edited with its own beginning and near_next is null. An empty
    table gives an empty one; further columns are not read.

    Texts are shuffled once, by ranges of ids; a task needs some 100 bytes a code point of its longest text."""
    bound_batches(documents.sparkSession)
    spark = documents.sparkSession
    docs = documents.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [(k + 1) / (BUCKETS_PER_TASK * tasks) for k in range(BUCKETS_PER_TASK * tasks - 1)]
    marks = docs.agg(F.min("id").alias("least"), F.percentile_approx("id", shares, 100 * len(shares) + 100).alias("bounds")).first()
    bounds = np.unique(np.array([b for b in marks.bounds or [] if b != marks.least], dtype=np.int64))
    dealt = (docs.withColumn("h", F.xxhash64("text")).mapInArrow(_dealt(bounds, marks.least), "bucket int, kind int, id long, text string, h long")
             .repartition(tasks, "bucket").sortWithinPartitions("bucket", "kind", "id", "h"))
    return dealt.select("bucket", "kind", "id", "text").mapInArrow(_compare, RESULT).withColumnRenamed("id", id_column)
