"""A stored table streamed past the rows of each partition.

For work that needs all of one table next to every row of another, and neither a broadcast, whose size grows with the
table, nor a join, which would copy or shuffle the large rows. The table is written once as Parquet, in the order of its
id. A column of the other table is then made by an iterator over Arrow batches: batches are held up to a share of bounded
size (Spark keeps the other columns of their rows, on disk if need be), the stored table is read past the share in
blocks, and the share's results are given out. A task reads the table once for each of its shares.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
import pyspark.cloudpickle
from pyspark.sql import DataFrame

from auditmill.session import store
from auditmill.sources.files import open_path

READ_ROWS = 1024
READ_BYTES = 1 << 20   # of each column


@dataclass(frozen=True)
class Blocks:
    """Paths of Parquet files in order; columns in `names`."""

    paths: tuple[str, ...]
    names: tuple[str, ...]

    def read(self, columns: Sequence[str], rows: int) -> Iterator[pa.Table]:
        """Tables of at most `rows` rows, in the stored order. Files are read as streams, a column chunk is never held as a
        whole, and small tables are cut from what is read READ_ROWS rows at a time."""
        for path in self.paths:
            fs, inner = open_path(path)
            with fs.open_input_file(inner) as file:
                stored = pq.ParquetFile(file, buffer_size=READ_BYTES, pre_buffer=False)
                for batch in stored.iter_batches(batch_size=max(rows, READ_ROWS), columns=list(columns)):
                    for at in range(0, batch.num_rows, rows):
                        yield pa.Table.from_batches([batch.slice(at, rows)])


def store_blocks(rows: DataFrame, order: str) -> tuple[Blocks, DataFrame]:
    """`rows` written once in the order of a column, and the stored table."""
    stored = store(rows.orderBy(order))
    paths = sorted(stored.inputFiles(), key=lambda p: p.rsplit("/", 1)[-1])  # part numbers follow the order
    return Blocks(tuple(paths), tuple(rows.columns)), stored


def in_shares(batches: Iterator[tuple[pa.Array, ...]], rows: int, work: Callable[[list[pa.Array]], pa.Array]) -> Iterator[pa.Array]:
    """Run `work` over shares of at most `rows` rows, or one batch, and give its result out batch by batch.

    The batches are let go once they are joined to a share, and `work` may take the columns out of its list to let go of
    them too."""
    held, count = [], 0

    def done() -> Iterator[pa.Array]:
        sizes = [len(batch[0]) for batch in held]
        columns = [pa.concat_arrays([b[i] for b in held]) for i in range(len(held[0]))]
        held.clear()
        result, at = work(columns), 0
        for size in sizes:
            yield result.slice(at, size)
            at += size

    for batch in batches:
        if held and count + len(batch[0]) > rows:
            yield from done()
            count = 0
        held.append(batch)
        count += len(batch[0])
    if held:
        yield from done()


pyspark.cloudpickle.register_pickle_by_value(sys.modules[__name__])
