"""Sharding by a hierarchical weighted hash tree (operator 3).

A row descends from region to rack to shard. At each level every child draws ln(u) / weight with u hashed from the
row's key and the child; the largest draw wins, so a child gets rows in proportion to its weight. A child's weight
is the sum of its shards' weights. If weights change below one child only, all other draws stay, so rows move only
into or out of that subtree. A shard that is added to a tree in use opens a region of its own: rows then move only
into it (in an old rack, rows would also move to its neighbours, since the rack's weight grows).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditmill.llm.draws import unit
from auditmill.llm.order import running_total
from auditmill.session import store


@dataclass(frozen=True)
class Tree:
    """Shards 0 .. shards-1 in racks of rack_size and regions of region_size racks, then `added` ones, each in a
    rack and region of its own."""

    shards: int
    rack_size: int = 5
    region_size: int = 4
    weights: dict[int, float] = field(default_factory=dict)  # of shards; 1 where none is given, 0 takes no rows
    added: int = 0

    @property
    def total(self) -> int:
        return self.shards + self.added

    def grown(self) -> Tree:
        """The tree with one more shard."""
        return replace(self, added=self.added + 1)

    def levels(self) -> list[list[list[tuple[int, float]]]]:
        """For each level and parent the children with their weights; the first level has one parent."""
        shard = [(s, float(self.weights.get(s, 1.0))) for s in range(self.total)]
        def group(nodes: list[tuple[int, float]], size: int) -> list[list[tuple[int, float]]]:
            old = len(nodes) - self.added
            return [nodes[at:min(at + size, old)] for at in range(0, old, size)] + [[node] for node in nodes[old:]]
        racks = group(shard, self.rack_size)
        rack = [(r, sum(w for _, w in children)) for r, children in enumerate(racks)]
        regions = group(rack, self.region_size)
        region = [(g, sum(w for _, w in children)) for g, children in enumerate(regions)]
        return [[region], regions, racks]


def place(key: Column, tree: Tree) -> Column:
    """The shard of a key; all null keys have one shard."""
    at = F.lit(0)
    for level, parents in enumerate(tree.levels()):
        children = F.array(*[F.array(*[F.struct(F.lit(c).alias("id"), F.lit(w).alias("weight")) for c, w in nodes if w > 0])
                             if any(w > 0 for _, w in nodes) else F.lit(None).cast("array<struct<id:int,weight:double>>")
                             for nodes in parents])
        def draw(child: Column, level: int = level) -> Column:
            return F.struct((F.ln(unit(F.lit(level), child["id"], key)) / child["weight"]).alias("draw"),
                            (-child["id"]).alias("order"))
        drawn = F.transform(F.element_at(children, at + 1), lambda child: draw(child))
        at = -F.array_max(drawn)["order"]
    return at


def assign(documents: DataFrame, tree: Tree, grown: Tree | None = None, id_column: str = "doc_id",
           text_column: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of each row.

    The id alone decides the shard (law `key`); rows with a null id share one shard, as do repeated rows. size is
    the UTF-8 length of the text plus 16, a null text counts as empty. Slots number the rows of a shard from 0 by id;
    `grown` is the tree with one more shard, by default. An empty table gives an empty one."""
    grown = grown or tree.grown()
    text = F.coalesce(F.col(text_column), F.lit(""))
    key = F.col(id_column)
    rows = store(documents.select(
        key, (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), place(key, tree).alias("shard"), place(key, grown).alias("grown_shard"),
        F.lit(1).cast("long").alias("_one")))
    numbered = running_total(rows, "shard", [id_column, "text_crc32", "size"], "_one", "slot")
    return numbered.select(id_column, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write(documents: DataFrame, path: str, tree: Tree, tasks_per_shard: int = 8, id_column: str = "doc_id") -> None:
    """Write `documents` under path/_shard=N; each shard is written by `tasks_per_shard` tasks. The folders' column gets
    a longer name where the table has one of that name."""
    def spare(name: str) -> str:
        return spare(name + "_") if name in documents.columns else name
    shard_column, salt_column = spare("_shard"), spare("_salt")
    salt = F.pmod(F.xxhash64(F.lit("salt"), F.col(id_column), F.monotonically_increasing_id()), F.lit(tasks_per_shard))
    (documents.withColumn(shard_column, place(F.col(id_column), tree)).withColumn(salt_column, salt)
     .repartition(tree.total * tasks_per_shard, shard_column, salt_column).drop(salt_column).write.partitionBy(shard_column).parquet(path))
