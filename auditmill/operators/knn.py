"""Nearest-neighbour join: per query row, the k knowledge rows of highest cosine similarity.

Exact, and without a cross product of rows, a shuffle of queries or a broadcast of knowledge: the knowledge table is
stored once in the order of its ids and streamed in blocks past each share of queries (see `blocks`), which keeps a
running list of the k best. Every pair is scored, as a matrix product of a block with a part of a share.

Similarities are compared to nine decimals and ties go to the smaller knowledge id. A vector of length zero, or none, has
no similarity (null) to anything and ranks last, and so has one of another width than most knowledge rows; queries that
are all of another width are refused. `vector_widths` counts them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyspark.cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from auditmill.operators.blocks import Blocks, in_shares, store_blocks

DIGITS = 9
SCORE_CELLS = 1_000_000
HIT_WORDS = 8   # what a hit that is held takes, in doubles
# Below any cosine: a pair without similarity ranks last, an excluded one is never taken.
NO_SIMILARITY, EXCLUDED = -3.0, -4.0


@dataclass(frozen=True)
class KnnParams:
    """`mode` is how languages count: 'none'; 'post', which drops hits of other languages after
    the k best were taken; or 'pre', which takes the k best among rows of the language. With
    `empty_means_all` a knowledge row without languages fits every language. A task holds `share_bytes` of query
    vectors with their hits so far and scores `block_bytes` of knowledge vectors at a time, both as doubles."""

    k: int = 5
    mode: str = "none"
    empty_means_all: bool = False
    block_bytes: int = 16 * 1024 * 1024
    share_bytes: int = 64 * 1024 * 1024


def language_fits(languages: Column, language: Column, empty_means_all: bool = False) -> Column:
    """Membership of a language in a list."""
    fits = F.coalesce(F.array_contains(languages, language), F.lit(False))
    return fits | (F.size(languages) == 0) if empty_means_all else fits


def _unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of unit length, and which rows have a usable vector."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, dtype=int)
    if column.null_count == 0 and (lengths == dim).all():
        raw = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    else:
        raw = np.zeros((len(column), dim))
        for i, value in enumerate(column.to_pylist()):
            if value is not None and len(value) == dim:
                raw[i] = value
    # In place: `raw` is a copy of its own, and a second and third one would be the most that a task holds.
    np.nan_to_num(raw, copy=False)
    length = np.sqrt(np.einsum("ij,ij->i", raw, raw))
    usable = length > 0
    raw /= np.where(usable, length, 1.0)[:, None]
    return raw, usable


def _best(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, similarity, rank) of the k highest values per row; ties go to the lower column.

    Columns stand in id order. The k-th highest of the maxima of column groups is a lower bound
    for the k-th value; only what reaches it is rounded and sorted."""
    count = sims.shape[1]
    width = max(1, count // (32 * k))
    groups = count // width
    bar = np.full(len(sims), EXCLUDED)
    if groups > k:
        tops = sims[:, :groups * width].reshape(len(sims), groups, width).max(axis=2)
        bar = np.partition(tops, groups - k, axis=1)[:, groups - k]
    rows, cols = np.nonzero(sims >= (bar - 2 * 10.0**-DIGITS)[:, None])
    values = np.round(sims[rows, cols], DIGITS)
    taken = values > EXCLUDED
    rows, cols, values = rows[taken], cols[taken], values[taken]
    order = np.lexsort((cols, -values, rows))
    rows, cols, values = rows[order], cols[order], values[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, np.arange(sims.shape[0]))[rows] + 1
    keep = rank <= k
    return rows[keep], cols[keep], values[keep], rank[keep]


class _Block:
    """Some knowledge rows as a matrix, in id order."""

    def __init__(self, table: pa.Table, dim: int):
        self.ids = table["id"].combine_chunks().to_numpy(zero_copy_only=False)
        self.units, self.usable = _unit(table["vec"], dim)
        self._fit: dict[Any, np.ndarray] = {}
        if "tags" in table.column_names:
            lists = table["tags"].combine_chunks()
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            self._bare = sizes == 0
            self._owner = np.repeat(np.arange(len(lists)), sizes)
            self._tag = lists.flatten()

    def fits(self, tag: Any, empty_means_all: bool) -> np.ndarray:
        if tag not in self._fit:
            fit = self._bare.copy() if empty_means_all else np.zeros(len(self.ids), dtype=bool)
            if tag is not None:
                same = pa.compute.equal(self._tag, pa.scalar(tag, self._tag.type)).fill_null(False)
                fit[self._owner[same.to_numpy(zero_copy_only=False)]] = True
            self._fit[tag] = fit
        return self._fit[tag]

    def top(self, vectors: np.ndarray, usable: np.ndarray, tags: list | None, p: KnnParams, bar: np.ndarray):
        """(first query, query row, knowledge row, similarity, rank, fits) of the k best, in steps of bounded size, of the
        queries that have a row here above their `bar`."""
        step = max(1, SCORE_CELLS // max(1, len(self.ids)))
        for at in range(0, len(vectors), step):
            part = slice(at, at + step)
            sims = (self.units @ vectors[part].T).T  # so laid out that the maxima of queries are taken side by side
            if not self.usable.all():
                sims[:, ~self.usable] = NO_SIMILARITY
            if not usable[part].all():
                sims[~usable[part]] = NO_SIMILARITY
            fit = None
            if tags is not None and p.mode != "none":
                fit = np.stack([self.fits(t, p.empty_means_all) for t in tags[part]])
            if p.mode == "pre":
                sims[~fit] = EXCLUDED
            # What rounds to the bar or less comes after what is held. Most blocks of a long table hold nothing for most queries.
            some = np.flatnonzero(sims.max(axis=1) > bar[part] + 0.4 * 10.0**-DIGITS)
            if not len(some):
                continue
            rows, cols, sim, rank = _best(np.ascontiguousarray(sims[some]), p.k)
            rows = some[rows]
            yield at, rows, cols, sim, rank, np.ones(len(rows), dtype=bool) if fit is None else fit[rows, cols]


class _KBest:
    """The running k best of a share of queries. Blocks come in id order, so of equal similarities the earlier stays."""

    def __init__(self, rows: int, k: int):
        self.k = k
        self.sim = np.full((rows, k), EXCLUDED)
        self.id = np.full((rows, k), None, dtype=object)
        self.fits = np.zeros((rows, k), dtype=bool)

    def add(self, block: _Block, found: Iterator[tuple]) -> None:
        for at, rows, cols, sim, rank, good in found:
            if not len(rows):
                continue
            here = np.unique(rows)
            place = np.searchsorted(here, rows)
            new = np.full((len(here), self.k), EXCLUDED)
            ids = np.full((len(here), self.k), None, dtype=object)
            fits = np.zeros((len(here), self.k), dtype=bool)
            new[place, rank - 1], ids[place, rank - 1], fits[place, rank - 1] = sim, block.ids[cols], good
            mine = here + at
            both = np.concatenate([self.sim[mine], new], axis=1)
            order = np.argsort(-both, axis=1, kind="stable")[:, :self.k]
            self.sim[mine] = np.take_along_axis(both, order, axis=1)
            self.id[mine] = np.take_along_axis(np.concatenate([self.id[mine], ids], axis=1), order, axis=1)
            self.fits[mine] = np.take_along_axis(np.concatenate([self.fits[mine], fits], axis=1), order, axis=1)

    def lists(self, post: bool, id_type: pa.DataType) -> pa.Array:
        """One list of (rank, id, sim) per query, the best first."""
        taken = self.sim > EXCLUDED
        if post:
            taken &= self.fits
        offsets = np.concatenate([[0], np.cumsum(taken.sum(axis=1))]).astype(np.int32)
        rank = np.broadcast_to(np.arange(1, self.k + 1, dtype=np.int32), taken.shape)[taken]
        sim = self.sim[taken]
        hits = pa.StructArray.from_arrays([pa.array(rank), pa.array(self.id[taken].tolist(), id_type), pa.array(sim, mask=sim == NO_SIMILARITY)],
                                          names=["rank", "id", "sim"])
        return pa.ListArray.from_arrays(pa.array(offsets), hits)


def _hit_type(id_type: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([
        T.StructField("rank", T.IntegerType()), T.StructField("id", id_type), T.StructField("sim", T.DoubleType())]))


def _hits(blocks: Blocks, dim: int, p: KnnParams, id_type: T.DataType, vector: Column, tag: Column) -> Column:
    """Hits as a column, made beside the rows."""
    arrow_id = to_arrow_type(id_type)
    block_rows = max(1, p.block_bytes // (8 * max(1, dim)))
    share_rows = max(1, p.share_bytes // (8 * (max(1, dim) + HIT_WORDS * p.k)))
    columns = [c for c in ("id", "vec", "tags") if c in blocks.names]

    def score(share: list[pa.Array]) -> pa.Array:
        vec, tags = share
        share.clear()
        if dim and len(vec) > vec.null_count and not pa.compute.any(pa.compute.equal(vec.value_lengths(), dim)).as_py():
            raise ValueError(f"no query vector has the {dim} components of the knowledge vectors")
        vectors, usable = _unit(vec, dim)
        asked = None if p.mode == "none" else tags.to_pylist()
        del vec, tags  # only the doubles are kept while the knowledge table passes
        best = _KBest(len(vectors), p.k)
        for table in blocks.read(columns, block_rows):
            block = _Block(table, dim)
            best.add(block, block.top(vectors, usable, asked, p, best.sim[:, -1]))
        return best.lists(p.mode == "post", arrow_id)

    @F.arrow_udf(_hit_type(id_type))
    def nearest(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return in_shares(batches, share_rows, score)

    # A filter on the hits would be pushed below this column and score everything a second time.
    return nearest.asNondeterministic()(vector, tag)


def _knowledge_side(knowledge: DataFrame, p: KnnParams, id_column: str, vector: str, languages: str) -> DataFrame:
    tags = [F.coalesce(F.col(languages), F.array()).alias("tags")] if p.mode != "none" else []
    return knowledge.select(F.col(id_column).alias("id"), F.col(vector).alias("vec"), *tags)


def vector_widths(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(width, rows): how many vectors have which number of components; null for missing ones."""
    return rows.groupBy(F.when(F.col(vector).isNotNull(), F.size(vector)).alias("width")).agg(F.count("*").alias("rows"))


def _stored(known: DataFrame) -> tuple[Blocks, int]:
    """The knowledge table as blocks, and its width: that of most vectors, so that a broken row does not decide it;
    0 if there is none."""
    blocks, rows = store_blocks(known, "id")
    return blocks, rows.agg(F.mode(F.when(F.col("vec").isNotNull(), F.size("vec")))).first()[0] or 0


def knn_join(
    queries: DataFrame,
    knowledge: DataFrame,
    params: KnnParams = KnnParams(),
    query_id: str = "chunk_id",
    query_vector: str = "embedding",
    query_language: str = "language",
    knowledge_id: str = "id",
    knowledge_vector: str = "embedding",
    knowledge_languages: str = "languages",
) -> DataFrame:
    """(query id, knowledge id, sim, rank) of the k nearest knowledge rows of each query.

    Ids must be unique on their side."""
    tag = F.col(query_language) if params.mode != "none" else F.lit(None).cast("string")
    asking = queries.select(F.col(query_id).alias("qid"), F.col(query_vector).alias("vec"), tag.alias("tag"))
    known = _knowledge_side(knowledge, params, knowledge_id, knowledge_vector, knowledge_languages)
    out = T.StructType([
        T.StructField(query_id, queries.schema[query_id].dataType),
        T.StructField(knowledge_id if knowledge_id != query_id else f"near_{knowledge_id}",
                      knowledge.schema[knowledge_id].dataType),
        T.StructField("sim", T.DoubleType()),
        T.StructField("rank", T.IntegerType()),
    ])
    blocks, dim = _stored(known)
    hits = _hits(blocks, dim, params, known.schema["id"].dataType, F.col("vec"), F.col("tag"))
    found = asking.select("qid", hits.alias("hits")).select("qid", F.inline("hits"))
    return found.select(F.col("qid").alias(out[0].name), F.col("id").alias(out[1].name), "sim", "rank")


def attach_hits(queries: DataFrame, knowledge: DataFrame, params: KnnParams = KnnParams()) -> DataFrame:
    """Queries (`chunk_id`, `embedding`, `language`, ...) with `hits`, the list of their nearest
    knowledge rows as (rank, id, sim). No row is shuffled or copied."""
    known = _knowledge_side(knowledge, params, "id", "embedding", "languages")
    blocks, dim = _stored(known)
    return queries.withColumn("hits", _hits(blocks, dim, params, known.schema["id"].dataType, F.col("embedding"), F.col("language")))


pyspark.cloudpickle.register_pickle_by_value(sys.modules[__name__])
