"""Product codes of vectors by exact integer Lloyd rounds with Drake-Hamerly adaptive bounds (operator 12).

A vector's components become floor(256 * x) and are cut into PARTS equal parts; each part position has a codebook. After an
assignment each part keeps its entry, its b next closest entries, ordered lower bounds of their distances and one outer
bound for all the rest. When entries move, bounds shrink by the moves; the exact distance to the part's own entry tells
how many bounds it may have passed. Entries behind those bounds are compared in integers, and all entries only if the
outer bound is passed. Bounds are whole numbers of a grid, always rounded to the safe side, so results are those of the
plain rounds. b starts at an eighth of the entries and shrinks to what nearly all parts needed in the round before.

State is stored between rounds as Parquet, one row a vector; only codebooks and sums (PARTS x ENTRIES rows) reach the
driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from auditmill.llm.batches import bound_batches
from auditmill.session import store

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
LIMIT = 1 << 26        # whole components are smaller, so that squared distances fit 64 bits
TOP = 65535            # of the grid; a lower bound above it is cut to it
SPARE = 0.01           # share of parts that may need more bounds than the next round keeps


def finite(vector: Column) -> Column:
    """A vector that is there, without null, NaN or infinite components."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, good), F.lit(False))


def whole(values: np.ndarray) -> np.ndarray:
    scaled = np.floor(SCALE * values.astype(np.float64))
    if scaled.size and np.abs(scaled).max() >= LIMIT:
        raise ValueError(f"a component is not below {LIMIT // SCALE} in size")
    return scaled.astype(np.int64)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, in integers."""
    return (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)


@dataclass(frozen=True)
class Grid:
    """Distances as whole numbers; a distance of 1 is `unit` steps."""

    unit: float

    @staticmethod
    def of(books: np.ndarray) -> Grid:
        """A power of two that leaves room for four times the widest codebook."""
        widest = max((float(np.sqrt(distances(b, b).max())) for b in books if b.size), default=1.0)
        return Grid(2.0 ** min(10, np.floor(np.log2(TOP / (4 * max(widest, 1.0))))))

    def low(self, squared: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(np.sqrt(squared.astype(np.float64)) * self.unit).astype(np.int64) - 1, 0, TOP)

    def high(self, squared: np.ndarray) -> np.ndarray:
        steps = np.ceil(np.sqrt(squared.astype(np.float64)) * self.unit).astype(np.int64) + 1
        return np.where(squared == 0, 0, steps)


@dataclass
class Kept:
    """What a part position keeps of each row: own entry, next entries, bounds (the outer one last)."""

    own: np.ndarray     # (rows,)
    near: np.ndarray    # (rows, b)
    bounds: np.ndarray  # (rows, b + 1), rising

    def shrunk(self, b: int) -> Kept:
        """Only the first b entries; the next bound holds for all the others, since bounds rise."""
        return Kept(self.own, self.near[:, :b], self.bounds[:, :b + 1]) if b < self.near.shape[1] else self


def _rising(bounds: np.ndarray) -> np.ndarray:
    return np.minimum.accumulate(bounds[:, ::-1], axis=1)[:, ::-1]


def assign_all(x: np.ndarray, book: np.ndarray, b: int, grid: Grid) -> tuple[Kept, np.ndarray]:
    """Compare with every entry; equal distances go to the lower index."""
    squared = distances(x, book)
    order = np.argsort(squared, axis=1, kind="stable")[:, :b + 2]
    ranked = np.take_along_axis(squared, order, axis=1)
    bounds = np.full((len(x), b + 1), TOP, dtype=np.int64)  # no entry is left out beyond the last: nothing to pass
    bounds[:, :ranked.shape[1] - 1] = grid.low(ranked[:, 1:])
    return Kept(order[:, 0], order[:, 1:b + 1], bounds), ranked[:, 0] if len(x) else np.zeros(0, np.int64)


def assign_again(x: np.ndarray, book: np.ndarray, moved: np.ndarray, kept: Kept, grid: Grid) -> tuple[Kept, np.ndarray, np.ndarray]:
    """(kept, squared distance, number of bounds passed) after the entries moved by at most `moved` steps."""
    b = kept.near.shape[1]
    gap = x - book[kept.own]
    squared = (gap * gap).sum(1)
    shrink = np.concatenate([moved[kept.near], np.full((len(x), 1), moved.max(initial=0))], axis=1)
    bounds = _rising(np.maximum(kept.bounds - shrink, 0))
    passed = (bounds <= grid.high(squared)[:, None]).sum(1)
    own, near = kept.own.copy(), kept.near.copy()
    some = np.flatnonzero((passed > 0) & (passed <= b))
    if len(some):
        chosen = np.concatenate([own[some, None], near[some]], axis=1)
        chosen.sort(axis=1)
        apart = x[some, None, :] - book[chosen]
        exact = (apart * apart).sum(2)
        order = np.argsort(exact, axis=1, kind="stable")
        chosen, exact = np.take_along_axis(chosen, order, axis=1), np.take_along_axis(exact, order, axis=1)
        own[some], near[some], squared[some] = chosen[:, 0], chosen[:, 1:], exact[:, 0]
        bounds[some, :b] = grid.low(exact[:, 1:])
        bounds[some] = _rising(bounds[some])
    rest = np.flatnonzero(passed > b)
    if len(rest):
        fresh, squared[rest] = assign_all(x[rest], book, b, grid)
        own[rest], near[rest], bounds[rest] = fresh.own, fresh.near, fresh.bounds
    return Kept(own, near, bounds), squared, passed


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a matrix."""
    rows = np.ascontiguousarray(rows)
    width = rows.dtype.itemsize * int(np.prod(rows.shape[1:]))
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(rows.tobytes())])


def _numbers(column: pa.Array, kind: type, *shape: int) -> np.ndarray:
    """The matrix back, as 64-bit numbers."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, dtype=kind).reshape(len(column), *shape).astype(np.int64)


def _pack(x: np.ndarray) -> pa.Array:
    return _binary(x.astype(np.int16 if not x.size or np.abs(x).max() < 1 << 15 else np.int32))


def _unpack(column: pa.Array, width: int) -> np.ndarray:
    values = column.to_pylist()
    out = np.zeros((len(values), width), dtype=np.int64)
    for kind in (np.int16, np.int32):
        rows = [i for i, v in enumerate(values) if len(v) == width * np.dtype(kind).itemsize]
        if rows and width:
            out[rows] = np.frombuffer(b"".join(values[i] for i in rows), dtype=kind).reshape(len(rows), width)
    return out


class _Sums:
    """Sums and counts of the parts given to each entry, and how many bounds were passed."""

    def __init__(self, books: np.ndarray) -> None:
        self.sums, self.count, self.passed = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64), {}

    def add(self, part: int, own: np.ndarray, x: np.ndarray, passed: np.ndarray | None) -> None:
        np.add.at(self.sums[part], own, x)
        self.count[part] += np.bincount(own, minlength=len(self.count[part]))
        if passed is not None:
            for depth, n in zip(*np.unique(passed, return_counts=True)):
                self.passed[int(depth)] = self.passed.get(int(depth), 0) + int(n)

    def rows(self) -> list[tuple[int, int, int, list[int]]]:
        used = [(int(p), int(e), int(self.count[p, e]), self.sums[p, e].tolist()) for p, e in zip(*np.nonzero(self.count))]
        return used + [(-1, depth, n, []) for depth, n in self.passed.items()]


_SUM_NAMES = ["part", "entry", "n", "sums"]
_SUM_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
_STATE_NAMES = ["vec", "own", "near", "bounds"]


class _Step:
    """One assignment over Arrow batches of vectors (no state yet) or of states."""

    def __init__(self, books: np.ndarray, moved: np.ndarray | None, grid: Grid, b: int, kept_b: int, last: bool, types: list) -> None:
        self.books, self.moved, self.grid, self.b, self.kept_b, self.last = books, moved, grid, b, kept_b, last
        self.types = types

    def vectors(self, batch: pa.RecordBatch) -> np.ndarray:
        """(rows, parts, width of a part)."""
        parts, _, d = self.books.shape
        if self.moved is not None:
            return _unpack(batch.column("vec"), parts * d).reshape(-1, parts, d)
        column = batch.column("vector")
        lengths = column.value_lengths().to_numpy()
        if len(lengths) and (lengths != parts * d).any():
            raise ValueError(f"vectors of {parts * d} components expected, found {sorted(set(lengths.tolist()))[:5]}")
        return whole(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, parts, d)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, _ = self.books.shape
        sums = _Sums(self.books)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = self.vectors(batch)
            own, error = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
            near, bounds = np.zeros((n, parts, self.kept_b), np.uint8), np.zeros((n, parts, self.kept_b + 1), np.uint16)
            if self.moved is not None:
                old = [_numbers(batch.column("own"), np.uint8, parts), _numbers(batch.column("near"), np.uint8, parts, self.b),
                       _numbers(batch.column("bounds"), np.uint16, parts, self.b + 1)]
            for p in range(parts):
                mine, book = np.ascontiguousarray(x[:, p]), self.books[p]
                if self.moved is None:
                    (kept, squared), passed = assign_all(mine, book, self.b, self.grid), None
                else:
                    kept, squared, passed = assign_again(mine, book, self.moved[p], Kept(*[o[:, p] for o in old]), self.grid)
                error += squared
                own[:, p] = kept.own
                if not self.last:
                    kept = kept.shrunk(self.kept_b)
                    near[:, p], bounds[:, p] = kept.near, kept.bounds
                    sums.add(p, kept.own, mine, passed)
            ids = [batch.column(c) for c in ("id", "label")]
            if self.last:
                digits = own.tobytes().hex()
                codes = [digits[i:i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(codes, pa.string()), pa.array(error)], names=["id", "label", "code", "error"])
            else:
                empty = [pa.nulls(n, t) for t in _SUM_TYPES]
                yield pa.RecordBatch.from_arrays([*ids, _pack(x.reshape(n, -1)), _binary(own), _binary(near), _binary(bounds), *empty],
                                                 names=["id", "label", *_STATE_NAMES, *_SUM_NAMES])
        if not self.last and (rows := sums.rows()):
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(rows), t) for t in self.types], *[pa.nulls(len(rows), pa.binary())] * 4,
                                              *[pa.array(c, t) for c, t in zip(zip(*rows), _SUM_TYPES)]], names=["id", "label", *_STATE_NAMES, *_SUM_NAMES])


@dataclass
class Coded:
    """rows: (id, label, code, error) of each kept vector, stored; books: (parts, entries, width) of whole numbers."""

    rows: DataFrame
    books: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _first_entries(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The parts of the vectors with the smallest ids (null last; equal ids by vector)."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    vectors = [r.vector for r in first]
    if not vectors:
        return np.zeros((parts, 0, 1), dtype=np.int64)
    widths = {len(v) for v in vectors}
    if len(widths) > 1 or min(widths) % parts:
        raise ValueError(f"vectors must be equally long, a multiple of {parts}; found {sorted(widths)}")
    return whole(np.array(vectors, dtype=np.float64).reshape(len(vectors), -1)).reshape(len(vectors), parts, -1).transpose(1, 0, 2)


def _moved_books(books: np.ndarray, sums: DataFrame) -> tuple[np.ndarray, dict[int, int]]:
    """Entries at the floor of their parts' mean, unused ones as they were; and counts of parts by bounds passed."""
    new, counts, passed = books.copy(), {}, {}
    for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n")).collect():
        (passed if r.part < 0 else counts)[r.entry if r.part < 0 else (r.part, r.entry)] = r.n
    each = sums.select("part", "entry", F.posexplode("sums").alias("at", "value")).groupBy("part", "entry", "at")
    for r in each.agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total")).collect():
        new[r.part, r.entry, r.at] = int(r.total) // counts[r.part, r.entry]
    return new, passed


def next_b(b: int, passed: dict[int, int]) -> int:
    """The least b that all but SPARE of the parts could have done with; those that passed the outer bound need all entries anyway."""
    within = {depth: n for depth, n in passed.items() if depth <= b}
    total, most = sum(within.values()), 1
    while most < b and sum(n for depth, n in within.items() if depth > most) > SPARE * total:
        most += 1
    return min(b, most)


def encode(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str | None = "label",
           parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Coded:
    """Codes of all vectors that are `finite`.

    Codebooks start as the parts of the vectors with the smallest ids. Each round gives every part to its nearest entry
    (equal distances: the lower index) and moves each used entry to the floor of its parts' mean; at last parts are given
    out again. Repeated rows and ids each count; fewer vectors than `entries` make smaller codebooks; an empty table gives
    an empty one. Null labels stay null; other columns are not looked at. Vectors of unlike length, or of a length that
    `parts` does not divide, and components of LIMIT / SCALE or more are refused."""
    bound_batches(vectors.sparkSession)
    label = F.col(label_column) if label_column else F.lit(None).cast("int")
    rows = (vectors.select(F.col(id_column).alias("id"), label.alias("label"), F.col(vector_column).alias("vector")).filter(finite(F.col("vector"))))
    books = _first_entries(rows, parts, entries)
    kinds = {f.name: f.dataType for f in rows.schema}
    ids = f"id {kinds['id'].simpleString()}, label {kinds['label'].simpleString()}"
    types = [to_arrow_type(kinds["id"]), to_arrow_type(kinds["label"])]
    state = ids + ", vec binary, own binary, near binary, bounds binary, part int, entry int, n long, sums array<long>"
    b, grid, moved, now = max(0, min(max(1, entries // 8), books.shape[1] - 1)), Grid.of(books), None, rows
    keep = b
    if books.shape[1]:
        for _ in range(rounds):
            step = _Step(books, moved, grid, b, keep, False, types)
            found = store(now.mapInArrow(step, state))
            new, passed = _moved_books(books, found.filter("part IS NOT NULL").select(*_SUM_NAMES))
            gap = new - books
            moved, books = grid.high((gap * gap).sum(2)), new
            b, keep = keep, next_b(keep, passed) if passed else keep
            now = found.filter("part IS NULL").select("id", "label", *_STATE_NAMES)
    last = _Step(books, moved, grid, b, keep, True, types)
    return Coded(store(now.mapInArrow(last, f"{ids}, code string, error long")), books)


def with_label_error(coded: Coded, id_column: str = "vec_id") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256): label_error is the sum over equal labels, null ones together."""
    sums = coded.rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    joined = coded.rows.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias(id_column), "code", "error", "label_error", F.lit(coded.digest()).alias("codebooks_sha256"))
