"""Repair of the structure of conversations by block tables (operator 13; the tables are in `repair_tables`).

Rows are range-partitioned by conversation and order, so a long conversation lies in many partitions. A conversation
that begins and ends within a partition is repaired where it lies. The first and the last one of a partition, and every
one beyond PIECE_ROWS rows or PIECE_CHARS characters, are cut into pieces. Of each piece the block tables give, for every
cost vector that may stand right of it, the vector left of it and the state in which it is left; a chain of these small
rows (one a piece) gives each piece its vector and state, and pieces are spelled out apart from each other. Only the
digest of a repaired conversation needs all its text in order: it is streamed, never held.

Order within a conversation: turn (nulls first), role, first HEAD characters of the text, MD5 of the text. Rows that are
equal in all these are equal. Null ids are one conversation. Turns are whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from auditmill.llm import repair_tables as R
from auditmill.llm.batches import bound_batches
from auditmill.llm.order import running_total
from auditmill.session import store

PIECE_ROWS, PIECE_CHARS = 4096, 1 << 23
HEAD = 100
BLANKS = " \t\n\x0b\x0c\r"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

_ORDER = ["turn", "role", "head", "digest"]
_CONV = ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
_ROW = "key string, piece long, seq int, turn long, role string, text string, digest string, is_blank boolean, is_cut boolean, is_again boolean, there boolean"


def damage(rows: DataFrame) -> DataFrame:
    """`conversations` with faults put in by crc32(conv_id:turn) % 20, and `there`: false for a dropped row, which stays
    only to name its conversation. Null roles and texts, and null parts of the key, are one space."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", blank)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(F.coalesce("role", blank))
    times = F.when(kind == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind != 0).alias("there"),
                       F.explode(F.sequence(F.lit(1), times)).alias("time")).drop("time")


class _Facts:
    """Counts over the rows of a conversation or of a piece of one, in order."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.rows = self.turns = 0
        self.first = self.last = self.low = self.high = None

    def add(self, turn: int | None, initial: str, blank: bool, again: bool, cut: bool) -> int:
        self.rows += 1
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += cut and not blank and not again
        self.illegal += self.last is not None and self.last + initial not in ("su", "ua", "au")
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        return R.symbol(initial, cut, blank or again)

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def _lines(letters: str, state_role: list[str], role: str, text: str) -> Iterator[str]:
    """`role:text` of the rows that a row's letters give; state_role holds the role that comes next and the one after."""
    for letter in letters:
        if letter == "D":
            continue
        if letter == "K" and role[:1] == "s":
            yield f"{role}:{text}"
            continue
        now = state_role[0]
        state_role.reverse()
        yield f"{role}:{text}" if letter == "K" else f"{R.ROLE_NAMES[now]}:{text if letter == 'R' else ''}"


class _Digest:
    """SHA-256 of lines joined by line feeds, fed row by row."""

    def __init__(self) -> None:
        self.sha, self.any, self.roles = hashlib.sha256(), False, ["u", "a"]

    def add(self, letters: str, role: str, text: str) -> None:
        for line in _lines(letters, self.roles, role, text):
            self.sha.update(("\n" + line if self.any else line).encode())
            self.any = True


def _whole(rows: list[tuple]) -> dict:
    """The report of a conversation whose rows are all here."""
    facts, signs, seen = _Facts(), [], set()
    for turn, role, _, digest, blank, cut in rows:
        again = (role, digest) in seen
        seen.add((role, digest))
        signs.append(facts.add(turn, role[:1], blank, again, cut))
    cost, letters = R.tables().repair(signs)
    digest = _Digest()
    for own, row in zip(letters, rows):
        digest.add(own, row[1], row[2])
    return {"gaps": facts.gaps, "blank": facts.blank, "duplicate": facts.duplicate, "truncated": facts.truncated, "illegal": facts.illegal,
            "cost": cost, "audit": "".join(letters), "repaired_sha256": digest.sha.hexdigest()}


def _sort_out(id_type: pa.DataType, piece_rows: int):
    """Reports of the conversations that lie within a partition, rows of the others; over sorted rows."""
    fields = {"conv": id_type} | _fields(f"{_ROW}, {_CONV}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        rows: list[tuple] = []
        key, conv, chars, piece, is_open = None, None, 0, 0, True  # the first one is open

        def as_rows() -> None:
            nonlocal piece
            seen = set()
            for seq, (turn, role, text, digest, blank, cut) in enumerate(rows):
                if digest is None:  # only names its conversation
                    out.append({"conv": conv, "key": key, "piece": piece, "seq": seq, "there": False})
                    continue
                again = (role, digest) in seen
                seen.add((role, digest))
                out.append({"conv": conv, "key": key, "piece": piece, "seq": seq, "turn": turn, "role": role, "text": text, "digest": digest,
                            "is_blank": blank, "is_cut": cut, "is_again": again, "there": True})
            piece += 1
            rows.clear()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({n: pa.array([r.get(n) for r in out], t) for n, t in fields.items()})
            out.clear()
            return batch

        for batch in batches:
            for new, c, part, turn, role, text, digest, blank, cut, there in zip(*[batch.column(i).to_pylist() for i in range(10)]):
                if key is None:
                    piece = part << 32
                if new != key:
                    if key is not None:
                        if is_open:
                            as_rows()
                        else:
                            out.append({"conv": conv, **_whole([r for r in rows if r[3] is not None])})
                        is_open = False
                    key, conv, chars = new, c, 0
                    rows.clear()
                rows.append((turn, role, text, digest if there else None, blank, cut))
                chars += len(text)
                if len(rows) >= piece_rows or chars >= PIECE_CHARS:
                    as_rows()
                    is_open, chars = True, 0
            if out:
                yield flush()
        if key is not None:  # the last one may go on in the next partition
            as_rows()
            yield flush()

    return run


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(),
          "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _fields(schema: str) -> dict[str, pa.DataType]:
    return {name: _ARROW[kind] for name, kind in (f.split() for f in schema.split(", "))}


def _table(rows: list[dict], schema: str) -> pa.Table:
    return pa.Table.from_pylist(rows, pa.schema(list(_fields(schema).items())))


_PIECE = ("key string, piece long, signs binary, seqs array<int>, counts array<long>, ends array<string>, low long, high long, "
          "left_of array<int>, added array<long>, leaves array<int>")


def _pieces(table: pa.Table) -> pa.Table:
    """One row for a piece: its symbols, its counts and what the tables say of it."""
    rows = sorted(table.to_pylist(), key=lambda r: r["seq"])
    facts = _Facts()
    signs = [facts.add(r["turn"], r["role"], r["is_blank"], r["is_again"], r["is_cut"]) for r in rows]
    left, cost, out = R.tables().through(signs)
    return _table([{"key": rows[0]["key"], "piece": rows[0]["piece"], "signs": bytes(signs), "seqs": [r["seq"] for r in rows],
                    "counts": [facts.blank, facts.duplicate, facts.truncated, facts.illegal, facts.turns], "ends": [facts.first, facts.last],
                    "low": facts.low, "high": facts.high, "left_of": left.tolist(), "added": cost.tolist(), "leaves": out.ravel().tolist()}], _PIECE)


_CHAIN = "key string, piece long, right_of int, state int, final boolean, " + ", ".join(f"{c} long" for c in COUNTS)


def _chain(table: pa.Table) -> pa.Table:
    """The vector right of each piece and the state left of it; the last piece carries the conversation's counts."""
    pieces = sorted(table.to_pylist(), key=lambda r: r["piece"])
    vector, cost, rights = 0, 0, []
    for p in reversed(pieces):
        rights.append(vector)
        cost, vector = cost + p["added"][vector], p["left_of"][vector]
    rights.reverse()
    cost += R.tables().vectors[vector][R.START]
    blank, duplicate, truncated, illegal, turns = (sum(p["counts"][k] for p in pieces) for k in range(5))
    state, last, low, high, found = R.START, None, None, None, []
    for p, right in zip(pieces, rights):
        found.append({"key": p["key"], "piece": p["piece"], "right_of": right, "state": state, "final": False, **dict.fromkeys(COUNTS, 0)})
        state = p["leaves"][4 * right + state]
        illegal += last is not None and last + p["ends"][0] not in ("su", "ua", "au")
        last = p["ends"][1]
        if p["low"] is not None:
            turns -= high == p["low"]  # the same turn on both sides of a cut
            low, high = p["low"] if low is None else low, p["high"]
    gaps = 0 if low is None else high - low + 1 - turns
    found[-1] |= {"final": True, "gaps": gaps, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal, "cost": cost}
    return _table(found, _CHAIN)


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The letters of each row of a piece."""
    table = R.tables()
    for batch in batches:
        for row in batch.to_pylist():
            signs = list(row["signs"])
            letters = table.spell_stretch(signs, row["right_of"], row["state"])
            if row["final"]:
                state = row["leaves"][4 * row["right_of"] + row["state"]]
                table.close(letters, state)
            n = len(letters)
            yield pa.RecordBatch.from_arrays([pa.array([row["key"]] * n, pa.string()), pa.array([row["piece"]] * n, pa.int64()),
                                              pa.array(row["seqs"], pa.int32()), pa.array(letters, pa.string())], ["key", "piece", "seq", "letters"])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, audit, digest) over rows sorted by conversation and place; a row of text is held at a time."""
    key, digest, audit = None, _Digest(), []

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (key, "".join(audit), digest.sha.hexdigest())],
                                          ["key", "audit", "repaired_sha256"])

    for batch in batches:
        for new, letters, role, text in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            if new != key:
                if key is not None:
                    yield done()
                key, digest, audit = new, _Digest(), []
            digest.add(letters, role, text)
            audit.append(letters)
    if key is not None:
        yield done()


class Repair:
    """The outcome of `repair`.

    `conversations`: (id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row a
    conversation. `messages()`: the rows of the repaired conversations."""

    def __init__(self, rows: DataFrame, conversations: DataFrame, id_column: str) -> None:
        self._rows, self.conversations, self._id = rows, conversations, id_column

    def messages(self) -> DataFrame:
        """(id, position, role, text) of the repaired conversations, positions from 1; inserted rows have an empty text.

        Rows are numbered by running totals over ranges and joined to their letters by number."""
        rows = running_total(self._rows.filter("there").withColumn("one", F.lit(1)), "key", _ORDER, "one", "nth")
        by_row = F.expr("regexp_extract_all(audit, 'I*[DKR]|I+$', 0)")
        letters = self.conversations.select(F.col(self._id).alias("conv"), _key(F.col(self._id)).alias("key"), F.posexplode(by_row).alias("nth", "own"))
        placed = letters.join(rows.select("key", "nth", "role", "text"), ["key", "nth"], "left").withColumn("gives", F.length(F.translate("own", "D", "")))
        counted = running_total(placed, "key", ["nth"], "gives", "before")
        given = counted.select("*", F.posexplode(F.split(F.translate("own", "D", ""), "")).alias("step", "letter")).filter("letter <> ''")
        given = given.withColumn("position", (F.col("before") + F.col("step") + 1).cast("long"))
        kept = F.col("letter") == "K"
        systems = given.filter((F.col("position") == 1) & kept & F.col("role").startswith("s")).select("key", F.lit(1).alias("first"))
        joined = given.join(systems, "key", "left")
        role = F.when((F.col("position") - F.coalesce("first", F.lit(0))) % 2 == 1, "user").otherwise("assistant")
        return joined.select(F.col("conv").alias(self._id), "position", F.when(kept, F.col("role")).otherwise(role).alias("role"),
                             F.when(F.col("letter") == "I", "").otherwise(F.col("text")).alias("text"))


def _key(conv: Column) -> Column:
    return F.coalesce(F.concat(F.lit("v"), conv.cast("string")), F.lit("n"))


def repair(rows: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text",
           there_column: str | None = None, piece_rows: int = PIECE_ROWS) -> Repair:
    """Find the faults of conversations and repair them at least cost.

    Faults and edits are those of `repair_tables`; null roles and texts count as one space, very long texts are held one
    row at a time, repeated rows are duplicates, other columns are not looked at. A conversation without rows
    (`there_column` false in all) has zeros, an empty audit and the digest of the empty text; an empty table gives none."""
    bound_batches(rows.sparkSession)
    role, text = F.coalesce(role_column, F.lit(" ")), F.coalesce(text_column, F.lit(" "))
    there = F.col(there_column) if there_column else F.lit(True)
    bare = F.rtrim(text, F.lit(BLANKS))
    narrow = rows.select(
        _key(F.col(id_column)).alias("key"), F.col(id_column).alias("conv"), F.col(turn_column).cast("long").alias("turn"), role.alias("role"),
        text.alias("text"), F.md5(text.cast("binary")).alias("digest"), F.substring(text, 1, HEAD).alias("head"),
        (bare == "").alias("is_blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("is_cut"), there.alias("there"))
    sorted_rows = (narrow.repartitionByRange("key", *_ORDER, F.monotonically_increasing_id())
                   .sortWithinPartitions("key", *_ORDER).withColumn("part", F.spark_partition_id().cast("long")))
    id_type = rows.schema[id_column].dataType
    schema = f"conv {id_type.simpleString()}, {_ROW}, {_CONV}"
    columns = ["key", "conv", "part", "turn", "role", "text", "digest", "is_blank", "is_cut", "there"]
    found = store(sorted_rows.select(columns).mapInArrow(_sort_out(to_arrow_type(id_type), piece_rows), schema))
    report = ["conv", *COUNTS, "audit", "repaired_sha256"]
    closed = found.filter("key IS NULL").select(report)
    done = closed.unionByName(_of_pieces(found.filter("key IS NOT NULL")).select(report))
    return Repair(narrow, done.withColumnRenamed("conv", id_column), id_column)


def _of_pieces(rows: DataFrame) -> DataFrame:
    """Reports of the conversations that were cut into pieces."""
    there = rows.filter("there")
    firsts = there.filter("NOT is_again").groupBy("key", "role", "digest").agg(F.min("piece").alias("first_piece"))
    later = (there.filter("NOT is_again").select("key", "role", "digest", "piece", "seq").join(firsts, ["key", "role", "digest"])
             .filter("piece > first_piece").select("key", "piece", "seq", F.lit(True).alias("later")))
    marked = (there.select("key", "piece", "seq", "turn", "role", "is_blank", "is_cut", "is_again").join(later, ["key", "piece", "seq"], "left")
              .select("key", "piece", "seq", "turn", F.substring("role", 1, 1).alias("role"), "is_blank", "is_cut",
                      (F.col("is_again") | F.coalesce("later", F.lit(False))).alias("is_again")))
    pieces = store(marked.groupBy("key", "piece").applyInArrow(_pieces, _PIECE))
    chain = store(pieces.drop("signs", "seqs").groupBy("key").applyInArrow(_chain, _CHAIN))
    letters = (pieces.select("key", "piece", "signs", "seqs", "leaves").join(chain.select("key", "piece", "right_of", "state", "final"), ["key", "piece"])
               .mapInArrow(_spell, "key string, piece long, seq int, letters string"))
    streamed = (there.select("key", "piece", "seq", "role", "text").join(letters, ["key", "piece", "seq"])
                .repartition("key").sortWithinPartitions("key", "piece", "seq").select("key", "letters", "role", "text")
                .mapInArrow(_stream, "key string, audit string, repaired_sha256 string"))
    counts = chain.groupBy("key").agg(*[F.sum(c).alias(c) for c in COUNTS])
    names = rows.groupBy("key").agg(F.first("conv").alias("conv"))
    full = names.join(counts, "key", "left").join(streamed, "key", "left")
    return full.select("conv", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
