"""Language identification as a mixture (operator 9).

Byte trigrams of the training texts, folded to BINS, give each language a distribution. A document is a mixture: its
proportions maximise the likelihood of its trigrams by expectation-maximisation. The set of languages grows from the
likeliest one: the language that promises most is added while the likelihood gains more than a penalty that grows
with the logarithm of the number of trigrams. The largest proportion names the prediction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditmill.llm import words as W
from auditmill.llm.batches import bound_batches
from auditmill.operators.blocks import Blocks, store_blocks

BINS = 1 << 16
SMOOTHING = 0.5
OVERLAP = 3.0          # a character lies in so many trigrams: log likelihoods count a third
PENALTY = 3.0          # times log(trigrams), for each further language
MOST_LANGUAGES = 256   # languages a worker holds at a time, BINS * 4 bytes each; of more it reads block after block
STEPS = 40
UNDETERMINED = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
for _c in range(128):
    if not chr(_c).isalpha():
        _FOLD[_c] = 32


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bin) of the byte trigrams of each text around each letter byte.

    Letters of ASCII and of the first accented block are lower-cased; other ASCII bytes count as one blank."""
    folded = _FOLD[data]
    accented = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1 if len(data) else []
    folded[accented] += 32
    wide = np.insert(folded, offsets, 32)  # a blank before each text and after the last
    middle = np.flatnonzero(wide != 32)
    code = (wide[middle - 1].astype(np.uint64) << np.uint64(16)) | (wide[middle].astype(np.uint64) << np.uint64(8)) | wide[middle + 1]
    text = np.searchsorted(offsets + np.arange(len(offsets)), middle, side="right") - 1
    return text, (W.mix(code) & np.uint64(BINS - 1)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bin, n) over each slice."""
    for batch in batches:
        for first, data, offsets in W.slices(batch.column(1)):
            langs = batch.column(0).slice(first, len(offsets) - 1).dictionary_encode()
            code = langs.indices.to_numpy(zero_copy_only=False)
            text, bins = trigrams(data, offsets)
            key, n = np.unique(code[text].astype(np.int64) * BINS + bins, return_counts=True)
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(key // BINS)), pa.array(key % BINS), pa.array(n)],
                                             names=["lang", "bin", "n"])


@dataclass
class Model:
    """The probability of each bin by language, stored in the order of the languages: one row of BINS numbers each."""

    blocks: Blocks
    size: int
    most: int = MOST_LANGUAGES

    def reader(self) -> Callable[[], Iterator[tuple[list[str], np.ndarray]]]:
        """(languages, shares) of at most `most` languages at a time; a model of one block is read once."""
        kept: list[tuple[list[str], np.ndarray]] = []

        def read() -> Iterator[tuple[list[str], np.ndarray]]:
            if kept:
                yield from kept
                return
            for table in self.blocks.read(["lang", "share"], self.most):
                share = np.frombuffer(b"".join(table["share"].to_pylist()), dtype=np.float32).reshape(-1, BINS)
                found = table["lang"].to_pylist(), share
                if self.size <= self.most:
                    kept.append(found)
                yield found
        return read


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each language's counts, listed, as its probabilities: one row of BINS numbers."""
    for batch in batches:
        for row in range(batch.num_rows):
            counts = batch.column(1)[row].values
            share = np.full(BINS, SMOOTHING)
            share[counts.field("bin").to_numpy()] += counts.field("n").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([(share / share.sum()).astype(np.float32).tobytes()], pa.binary())],
                                             names=["lang", "share"])


def learn(documents: DataFrame, training: Column, text_column: str = "text", lang_column: str = "lang", most: int = MOST_LANGUAGES) -> Model:
    """The model of the texts that `training` marks and that have a text and a language; any number of languages.

    A language's counts, BINS at most, meet in one task; none come to the driver."""
    bound_batches(documents.sparkSession)
    rows = documents.filter(training & F.col(lang_column).isNotNull() & F.col(text_column).isNotNull()).select(
        F.col(lang_column).cast("string").alias("lang"), F.col(text_column).alias("text"))
    counts = rows.mapInArrow(_counts, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    wordless = rows.select("lang").distinct().select("lang", F.lit(None).cast("long").alias("bin"), F.lit(0).cast("long").alias("n"))
    listed = (counts.unionByName(wordless).groupBy("lang")
              .agg(F.filter(F.collect_list(F.struct("bin", "n")), lambda c: c["bin"].isNotNull()).alias("counts")))
    blocks, stored = store_blocks(listed.mapInArrow(_pack, "lang string, share binary"), "lang")
    return Model(blocks, stored.count(), most)


def _mixture(share: np.ndarray, n: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions by expectation-maximisation, and the mixed probability of each bin."""
    part, total = start, n.sum()
    for _ in range(STEPS):
        mixed = part @ share
        new = part * (share @ (n / mixed)) / total
        if np.abs(new - part).max() < 1e-4:
            part = new
            break
        part = new
    return part, part @ share


@dataclass
class _State:
    """A document's bins and counts, and the mixture chosen so far."""

    bins: np.ndarray
    n: np.ndarray
    names: list[str] = field(default_factory=list)
    shares: list[np.ndarray] = field(default_factory=list)
    part: np.ndarray | None = None
    mixed: np.ndarray | None = None
    best: float = -np.inf
    offer: tuple[float, str, np.ndarray] | None = None

    def hear(self, languages: list[str], share: np.ndarray) -> None:
        """Keep the language that promises most: the likeliest at first, then that of the steepest slope."""
        of_bins = share[:, self.bins].astype(np.float64)
        if self.part is None:
            worth = np.log(of_bins) @ self.n
        else:
            # The likelihood is concave: its slope towards a language bounds the gain from below zero to this.
            worth = of_bins @ (self.n / self.mixed) - self.n.sum()
            worth[[k for k, name in enumerate(languages) if name in self.names]] = -np.inf
        k = int(np.argmax(worth))
        if self.offer is None or worth[k] > self.offer[0]:
            self.offer = (float(worth[k]), languages[k], of_bins[k])

    def take(self) -> bool:
        """Add the kept language if it is worth its penalty; false when the set is complete."""
        value, name, share = self.offer
        self.offer = None
        if self.part is None:
            self.names, self.shares, self.part, self.mixed, self.best = [name], [share], np.ones(1), share, value
            return True
        worth = PENALTY * np.log(self.n.sum() + 1) * OVERLAP
        if value <= worth:
            return False
        tried, mixed = _mixture(np.stack([*self.shares, share]), self.n, np.append(self.part * 0.9, 0.1))
        value = float(np.log(mixed) @ self.n)
        if value - self.best <= worth:
            return False
        self.names, self.shares = [*self.names, name], [*self.shares, share]
        self.part, self.mixed, self.best = tried, mixed, value
        return True


def proportions(read: Callable[[], Iterator[tuple[list[str], np.ndarray]]], documents: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[list[str], np.ndarray]]:
    """(languages, proportions) of documents with `n` trigrams in each of `bins`. Each round reads the model once for all."""
    states = [_State(bins, n) for bins, n in documents]
    growing = states
    while growing:
        for languages, share in read():
            for state in growing:
                state.hear(languages, share)
        growing = [s for s in growing if s.offer is not None and s.take()]
        growing = [s for s in growing if s.part is not None]
    return [(s.names, s.part / s.part.sum()) for s in states]


def identify(documents: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang_pred, score, languages) of each row; languages lists the chosen set with its proportions.

    A null text, one without a letter, and every text under a model without languages are `und` with score 0. Ties
    go to the language first by code point. Null ids and repeated rows are kept; an empty table gives an empty one."""
    bound_batches(documents.sparkSession)
    docs = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = model.reader()
        for batch in batches:
            for first, data, offsets in W.slices(batch.column(1)):
                rows = len(offsets) - 1
                text, bins = trigrams(data, offsets)
                key, n = np.unique(text * BINS + bins, return_counts=True)
                cut = np.searchsorted(key, np.arange(rows + 1) * BINS)
                lettered = []
                for row in range(rows):
                    # Only texts without ASCII letters can be without any letter.
                    body = data[offsets[row]:offsets[row + 1]]
                    if model.size and cut[row] < cut[row + 1] and (
                            bool((_FOLD[body[:64]] - 97 < 26).any()) or any(c.isalpha() for c in bytes(body).decode("utf-8", "replace"))):
                        lettered.append(row)
                found = proportions(read, [(key[cut[r]:cut[r + 1]] - r * BINS, n[cut[r]:cut[r + 1]].astype(np.float64)) for r in lettered])
                names, scores, sets = [UNDETERMINED] * rows, [0.0] * rows, [[] for _ in range(rows)]
                for row, (languages, part) in zip(lettered, found):
                    order = sorted(range(len(part)), key=lambda k: (-part[k], languages[k]))
                    names[row], scores[row] = languages[order[0]], float(min(1.0, part[order[0]]))
                    sets[row] = [{"lang": languages[k], "share": float(part[k])} for k in order]
                kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, rows), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, kind)],
                    names=["id", "lang_pred", "score", "languages"])

    kind = docs.schema["id"].dataType.simpleString()
    return (docs.mapInArrow(run, f"id {kind}, lang_pred string, score double, languages array<struct<lang:string,share:double>>")
            .withColumnRenamed("id", id_column))


def held_out(id_column: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; a null id is held out."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 5 == 0
