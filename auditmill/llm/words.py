"""Words, lines and their hashes for whole Arrow batches of texts, without Python objects per word.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r, as `[^\\x20\\x09-\\x0D]+` on UTF-8.
Memory is a few times the bytes of one slice; `slices` cuts batches so that a slice holds about
SLICE_BYTES or one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
WORD = r"[^\x20\x09-\x0D]+"

_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x5851F42D4C957F2D)  # odd


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser of each value."""
    x = np.asarray(x, dtype=np.uint64) + _STEP
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
BYTE_HASH = mix(np.arange(256, dtype=np.uint64))
_WORD_HASH = np.where(BLANK, np.uint64(0), BYTE_HASH)
_LOWER_HASH = _WORD_HASH.copy()
_LOWER_HASH[65:91] = _WORD_HASH[97:123]
_LINE_HASH = BYTE_HASH.copy()
_LINE_HASH[10] = 0


def slices(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(offsets, dtype=width)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1)
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def count_in_texts(marked: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of marked bytes of each text."""
    running = np.zeros(len(marked) + 1, dtype=np.int64)
    np.cumsum(marked, out=running[1:])
    return np.diff(running[offsets])


def _hash_pieces(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each piece; bytes between pieces must have 0 in the table."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    spans = np.diff(np.concatenate([[0], starts, [len(data)]]))
    place = np.arange(len(data), dtype=np.int32) - np.repeat(np.concatenate([[0], starts]).astype(np.int32), spans)
    powers = np.full(int(place.max()) + 1, BASE, dtype=np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    values = table[data] * powers[place]
    return mix(np.add.reduceat(values, starts) + lengths.astype(np.uint64) * _STEP)


def hash_pieces(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of pieces of text with nothing but blanks between them, equal for equal bytes."""
    return _hash_pieces(data, starts, lengths, _WORD_HASH)


@dataclass
class Words:
    """Words of a slice in order: text number, first byte, end byte, hash."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~BLANK[data]
    starts_at = inside[1:-1] & ~inside[:-2]
    ends_at = inside[1:-1] & ~inside[2:]
    full = offsets[:-1][np.diff(offsets) > 0]  # a text may end in a word and the next begin with one
    starts_at[full] = inside[1:-1][full]
    edge = full[full > 0] - 1
    ends_at[edge] = inside[1:-1][edge]
    start, end = np.flatnonzero(starts_at), np.flatnonzero(ends_at) + 1
    text = np.searchsorted(offsets, start, side="right") - 1
    return Words(text, start, end, _hash_pieces(data, start, end - start, _LOWER_HASH if lower else _WORD_HASH))


def lines_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Pieces between line feeds, empty ones left out, in the form of `Words`."""
    breaks = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    start = start[start < len(data)]
    stop = np.unique(np.concatenate([breaks, offsets[1:]]))
    end = start.copy()
    filled = data[start] != 10
    end[filled] = stop[np.searchsorted(stop, start[filled], side="right")]
    text = np.searchsorted(offsets, start, side="right") - 1
    # Bytes of an empty line hold a line feed only, which hashes to 0 and ends the piece before.
    hashes = _hash_pieces(data, start, end - start, _LINE_HASH)
    keep = end > start
    return Words(text[keep], start[keep], end[keep], hashes[keep])


def windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the first word, hash) of each run of `size` words of one text."""
    count = len(words.hash) - size + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(count, dtype=np.uint64)
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(size):
            total += words.hash[k:k + count] * factor
            factor = factor * BASE
    first = np.flatnonzero(words.text[:count] == words.text[size - 1:])
    return first, mix(total[first])


def of_text(text_number: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes made different between texts, to find repeats within a text by one sort."""
    with np.errstate(over="ignore"):
        return mix(hashes + mix(text_number.astype(np.uint64)))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Marks values that occur twice or more."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, dtype=bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), dtype=bool)
    out[order] = same[:-1] | same[1:]
    return out


def seen_before(keys: np.ndarray) -> np.ndarray:
    """Marks values equal to an earlier one."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), dtype=bool)
    out[order[1:]] = keys[order][1:] == keys[order][:-1]
    return out
