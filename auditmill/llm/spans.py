"""Substring deduplication by sliding sentence spans (operator 7).

Sentences end at a word that ends in . ! or ? or their wide forms, at a line end, or after LONGEST words; in scripts that
leave no blanks between words each character is a word. With local cuts, long ones are
instead cut where their own words decide: after the word of the least hash (of equal ones the last) of every WINDOW
words within a sentence. So a cut depends on the WINDOW - 1 words on either side only, a passage is cut alike wherever
it stands, and no piece has more than WINDOW words. Every run of RUN consecutive sentences with at least LEAST_WORDS
words is hashed, or, where runs grow, from each sentence on the shortest run of RUN sentences or more that has so many
words; runs are joined over all documents, and sentences covered by a run that occurred before, in a document with a
smaller id or earlier in the same one, are removed. Documents are rows: those of one id are ordered by the hash of
their text, equal ones by a stored number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditmill.llm import words as W
from auditmill.llm.batches import bound_batches
from auditmill.session import store

RUN = 3
LEAST_WORDS = 8
LONGEST = 16
WINDOW = 8             # words among which local cuts choose
LAST = (1 << 63) - 1   # stands for a null id, which comes after all others

_END = np.zeros(256, dtype=bool)
_END[list(b".!?")] = True
# Scripts without blanks: a character of U+3000 to U+9FFF, three bytes that open with E3 to E9, is a word of its own.
_WIDE = np.zeros(256, dtype=bool)
_WIDE[0xE3:0xEA] = True
WIDE_ENDS = tuple(int.from_bytes(c.encode(), "big") for c in "。！？．")


def words_or_characters(data: np.ndarray, offsets: np.ndarray) -> W.Words:
    """Words, cut further before and after each character of a script without blanks."""
    words = W.words_of(data, offsets)
    wide = np.flatnonzero(_WIDE[data])
    if not len(wide):
        return words
    after = wide + 3
    inside = after[after < len(data)]
    inside = inside[~W.BLANK[data[inside]] & ~np.isin(inside, offsets)]
    start = np.unique(np.concatenate([words.start, wide, inside]))
    stop = words.end[np.searchsorted(words.start, start, side="right") - 1]
    end = np.minimum(stop, np.append(start[1:], len(data)))
    return W.Words(np.searchsorted(offsets, start, side="right") - 1, start, end, W.hash_pieces(data, start, end - start))


def _ends_sentence(data: np.ndarray, words: W.Words) -> np.ndarray:
    """Whether a word is the last of its sentence."""
    last = words.end - 1
    ends = _END[data[last]]
    some = np.flatnonzero((words.end - words.start >= 3) & (data[last] >= 0x80))
    at = words.end[some].astype(np.int64)
    code = (data[at - 3].astype(np.int64) << 16) | (data[at - 2].astype(np.int64) << 8) | data[at - 1]
    ends[some] |= np.isin(code, WIDE_ENDS)
    return ends


@dataclass
class Runs:
    """Sentences of a slice (text number, first byte) and its runs (first sentence, text number, hash, sentences)."""

    sentence_text: np.ndarray
    sentence_start: np.ndarray
    first: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    length: np.ndarray


def _grown(text: np.ndarray, hashes: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first sentence, hash, sentences) of the shortest run from each sentence on that has RUN sentences and
    LEAST_WORDS words and ends in its text."""
    n = len(text)
    length = np.maximum(RUN, np.searchsorted(total, total[:-1] + LEAST_WORDS) - np.arange(n))
    first = np.flatnonzero(np.arange(n) + length <= np.searchsorted(text, text, side="right"))
    length = length[first]
    run = np.zeros(len(first), dtype=np.uint64)
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(int(length.max(initial=0))):
            some = length > k
            run[some] += hashes[first[some] + k] * factor
            factor = factor * W.BASE
        return first, W.mix(run + W.mix(length.astype(np.uint64))), length


def _local_cuts(hashes: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """`opens` with the words after the cuts of each sentence marked too."""
    out = opens.copy()
    count = len(hashes) - WINDOW + 1
    if count <= 0:
        return out
    least, at = hashes[:count].copy(), np.zeros(count, dtype=np.int64)
    for k in range(1, WINDOW):
        lower = hashes[k:k + count] <= least
        least[lower] = hashes[k:k + count][lower]
        at[lower] = k
    sentence = np.cumsum(opens)
    whole = np.flatnonzero(sentence[:count] == sentence[WINDOW - 1:])
    after = whole + at[whole] + 1
    out[after[after < len(hashes)]] = True
    return out


def runs_of(data: np.ndarray, offsets: np.ndarray, local_cuts: bool = False, grow: bool = False) -> Runs:
    words = words_or_characters(data, offsets)
    n = len(words.start)
    if not n:
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, none, np.zeros(0, np.uint64), none)
    breaks = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum(data == 10, out=breaks[1:])
    opens = np.ones(n, dtype=bool)
    opens[1:] = ((words.text[1:] != words.text[:-1]) | _ends_sentence(data, words)[:-1]
                 | (breaks[words.start[1:]] > breaks[words.end[:-1]]))
    if local_cuts:
        opens = _local_cuts(words.hash, opens)
    start = np.flatnonzero(opens)
    place = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
    start = np.flatnonzero(place % LONGEST == 0)
    length = np.diff(np.append(start, n))
    place %= LONGEST
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(LONGEST - 1, W.BASE, np.uint64)]))
        hashes = W.mix(np.add.reduceat(words.hash * powers[place], start) + length.astype(np.uint64))
    text = words.text[start]
    total = np.concatenate([[0], np.cumsum(length)])
    if grow:
        first, run, sentences = _grown(text, hashes, total)
    else:
        first, run = W.windows(W.Words(text, start, start, hashes), RUN)
        enough = total[first + RUN] - total[first] >= LEAST_WORDS
        first, run = first[enough], run[enough]
        sentences = np.full(len(first), RUN)
    return Runs(text, words.start[start], first, text[first], run, sentences)


def _hashes(local_cuts: bool, grow: bool):
    """Each document's distinct runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in W.slices(batch.column(1)):
                runs = runs_of(data, offsets, local_cuts, grow)
                once = ~W.seen_before(W.of_text(runs.text, runs.hash))
                of_rows = [batch.column(c).slice(at, len(offsets) - 1).take(pa.array(runs.text[once])) for c in (0, 2)]
                yield pa.RecordBatch.from_arrays([pa.array(runs.hash[once].view(np.int64)), *of_rows], names=["h", "row", "at"])
    return run


def _apply(local_cuts: bool, grow: bool):
    """Texts without covered sentences; column 2 lists the document's runs that occur in earlier ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in W.slices(batch.column(1)):
                rows = len(offsets) - 1
                runs = runs_of(data, offsets, local_cuts, grow)
                lists = batch.column(2).slice(at, rows)
                sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                earlier = lists.flatten().to_numpy().view(np.uint64)
                owner = np.repeat(np.arange(rows), sizes)
                gone = W.seen_before(W.of_text(runs.text, runs.hash))
                gone |= np.isin(W.of_text(runs.text, runs.hash), W.of_text(owner, earlier))
                depth = np.zeros(len(runs.sentence_text) + 1, dtype=np.int32)
                np.add.at(depth, runs.first[gone], 1)
                np.add.at(depth, runs.first[gone] + runs.length[gone], -1)
                covered = np.cumsum(depth[:-1]) > 0
                n = np.bincount(runs.sentence_text, minlength=rows)
                n_gone = np.bincount(runs.sentence_text[covered], minlength=rows)
                begin = runs.sentence_start.copy()
                opens = np.ones(len(begin), dtype=bool)
                opens[1:] = runs.sentence_text[1:] != runs.sentence_text[:-1]
                begin[opens] = offsets[runs.sentence_text[opens]]  # blanks before the first sentence belong to it
                end = np.append(begin[1:], len(data))
                closes = np.append(opens[1:], True)
                end[closes] = offsets[runs.sentence_text[closes] + 1]
                edge = np.zeros(len(data) + 1, dtype=np.int32)
                np.add.at(edge, begin[covered], 1)
                np.add.at(edge, end[covered], -1)
                keep = np.cumsum(edge[:-1]) == 0
                sizes = np.concatenate([[0], np.cumsum(W.count_in_texts(keep, offsets))])
                null = batch.column(1).slice(at, rows).is_null()
                texts = pa.LargeStringArray.from_buffers(rows, pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(data[keep].tobytes()))
                texts = pc.if_else(null, pa.scalar(None, pa.large_string()), texts).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), texts, pa.array(n), pa.array(n_gone)],
                                                 names=["id", "text", "n_sentences", "n_removed"])
    return run


def remove_repeats(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", local_cuts: bool = False,
                   grow: bool = False) -> DataFrame:
    """(id, text, n_sentences, n_removed) of each row, the text without sentences of repeated runs.

    `local_cuts` cuts long sentences where their own words decide, instead of every LONGEST words from their first.
    `grow` lets a run of fewer than LEAST_WORDS words go on to further sentences, instead of leaving it out.

    The first occurrence, by id, hash of the text and then place, stays. A null text stays null, an empty one empty.
    Rows with a null id come last; each row is a document of its own, whether its id is null, shared or neither, so of
    equal rows one stays whole. A document all of whose sentences repeat keeps its row with an empty text. An empty
    table gives an empty one; further columns are not read."""
    bound_batches(documents.sparkSession)
    text = F.col(text_column)
    docs = store(documents.select(F.monotonically_increasing_id().alias("row"), text.alias("text"), F.col(id_column).cast("long").alias("id"),
                                  F.xxhash64(text).alias("th")))
    # Hashed twice, which takes less than to store the runs.
    rows = docs.select("row", "text", F.coalesce("id", F.lit(LAST)).alias("at")).mapInArrow(_hashes(local_cuts, grow), "h long, row long, at long")
    firsts = rows.groupBy("h").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").select("h", "first")
    met = store(rows.join(firsts, "h").select("h", "row", (F.col("at") > F.col("first")).alias("later")))
    ties = met.filter("NOT later").select("h", "row")
    winners = ties.join(docs.select("row", "th"), "row").groupBy("h").agg(F.min(F.struct("th", "row"))["row"].alias("first"))
    later = met.filter("later").select("row", "h").union(ties.join(winners, "h").filter("row <> first").select("row", "h"))
    lists = later.groupBy("row").agg(F.collect_set("h").alias("earlier"))  # at most a row's own runs
    joined = docs.join(lists, "row", "left").select("id", "text", F.coalesce("earlier", F.array().cast("array<bigint>")).alias("earlier"))
    out = joined.mapInArrow(_apply(local_cuts, grow), "id long, text string, n_sentences long, n_removed long")
    return out.select(F.col("id").alias(id_column), F.col("text").alias(text_column), "n_sentences", "n_removed")
