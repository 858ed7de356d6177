"""SentencePiece BPE encoding and decoding by a prefix table (operator 5).

For each prefix of a text exactly one token can be the last of the prefix's encoding. An automaton gives the
pieces that end at a position; of these the last token is the one that is compatible with the last token of the
prefix before it: merging the two strings alone gives back the two tokens. The ids are then read from the table
backwards, from the end of the text. Pieces of a model are merged in the order of their scores, the leftmost
pair first.

No piece spans a place where a space mark follows another character, nor a character that occurs in no longer
piece, so texts are cut there and the ids of a cut part are remembered.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditmill.llm.batches import bound_batches


MARK = "▁"
MEMO = 300_000       # parts remembered by a worker, in two generations, and pairs; the older go first
MEMO_LENGTH = 64     # longer parts are not remembered

# Kinds of pieces in a model file, and field numbers of its messages (fixed values of the format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class PieceTable:
    """The pieces of a BPE model with byte fallback, and the prefix tables over them."""

    def __init__(self, model_path: str):
        from sentencepiece import sentencepiece_model_pb2 as messages

        model = messages.ModelProto()
        with open(model_path, "rb") as file:
            model.ParseFromString(file.read())
        spec = model.normalizer_spec
        if (model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or spec.precompiled_charsmap
                or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces
                or any(p.type in (USER_DEFINED, UNUSED) for p in model.pieces)):
            raise ValueError("only BPE models with byte fallback, a leading space mark and no text changes are read")
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = [p.score for p in model.pieces]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        long_ones = [p for p in self.ids if len(p) > 1]
        joinable = sorted({c for p in long_ones for c in p} - {MARK})
        if any(MARK in p.lstrip(MARK) for p in long_ones):
            self.cut = re.compile(f"(?:[{MARK}{re.escape(''.join(joinable))}])+|.", re.DOTALL)
        else:
            letters = re.escape("".join(joinable))
            self.cut = re.compile(f"{MARK}*[{letters}]+|{MARK}+|.", re.DOTALL)
        if any(c not in self.ids for c in joinable) or MARK not in self.ids:
            raise ValueError("every character of a longer piece must be a piece")
        self.lengths = [len(p) for p in self.pieces]
        self.id_texts = [str(i) for i in range(len(self.pieces))]
        self.pairs: list[dict[int, bool]] = [{} for _ in self.pieces]
        self.n_pairs = 0
        self.memo: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}
        self.matcher = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if len(piece) == 1 or self._merge(piece) == [i]:
                self.matcher.add_word(piece, i)
        self.matcher.make_automaton()

    def _merge(self, part: str) -> list[int]:
        """Ids of a short string by plain merging; pieces must cover its characters."""
        symbols: list[str | None] = list(part)
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            joined = symbols[left] + symbols[right]
            at = self.ids.get(joined)
            if at is not None:
                heapq.heappush(queue, (-self.scores[at], left, right, joined))

        for k in range(len(symbols) - 1):
            offer(k, k + 1)
        while queue:
            _, left, right, joined = heapq.heappop(queue)
            if symbols[left] is None or symbols[right] is None or symbols[left] + symbols[right] != joined:
                continue
            symbols[left], symbols[right] = joined, None
            after[left] = after[right]
            if after[left] < len(symbols):
                before[after[left]] = left
                offer(left, after[left])
            if before[left] >= 0:
                offer(before[left], left)
        return [self.ids[s] for s in symbols if s is not None]

    def _compatible(self, left: int, right: int) -> bool:
        if self.n_pairs >= MEMO:
            self.pairs, self.n_pairs = [{} for _ in self.pieces], 0
        self.n_pairs += 1
        known = self.pairs[left][right] = self._merge(self.pieces[left] + self.pieces[right]) == [left, right]
        return known

    def _part(self, part: str) -> list[int]:
        """Ids of a part by its prefix table."""
        if len(part) == 1:
            at = self.ids.get(part)
            return [at] if at is not None else [self.bytes[b] for b in part.encode()]
        last, lengths, pairs = [-1] * len(part), self.lengths, self.pairs
        for end, token in self.matcher.iter(part):
            if last[end] < 0:
                begin = end - lengths[token]
                if begin < 0:
                    last[end] = token
                else:
                    left = last[begin]
                    fits = pairs[left].get(token)
                    if fits is None:
                        fits = self._compatible(left, token)
                        pairs = self.pairs
                    if fits:
                        last[end] = token
        ids, end = [], len(part) - 1
        while end >= 0:
            token = last[end]
            ids.append(token)
            end -= lengths[token]
        ids.reverse()
        return ids

    def parts(self, text: str) -> Iterator[str]:
        """The text with its leading mark and marks for spaces, cut where no piece spans."""
        return self.cut.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for part in self.parts(text) for i in self._part(part)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks are spaces, the mark of the very first piece goes, bytes are read as UTF-8."""
        out, pending = [], bytearray()
        for n, i in enumerate(ids):
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            if self.kinds[i] == CONTROL:
                continue
            piece = " ⁇ " if self.kinds[i] == UNKNOWN else self.pieces[i]
            out.append((piece[1:] if n == 0 and piece[:1] == MARK else piece).replace(MARK, " "))
        out.append(pending.decode("utf-8", "replace"))
        return "".join(out)

    def digest_part(self, part: str) -> tuple[int, str, str]:
        """(number of ids, ids joined by commas, decoded text with the first mark kept as a space)."""
        found = self.older.get(part)
        if found is None:
            ids = self._part(part)
            if len(part) == 1 and part not in self.ids:
                decoded = self.decode([0, *ids])[3:]
            else:  # no byte pieces: decoding joins the pieces
                decoded = "".join([self.pieces[i] for i in ids]).replace(MARK, " ")
            found = (len(ids), ",".join([self.id_texts[i] for i in ids]), decoded)
        if len(part) <= MEMO_LENGTH:
            if len(self.memo) >= MEMO:
                self.memo, self.older = {}, self.memo
            self.memo[part] = found
        return found


_TABLES: dict[str, PieceTable] = {}


def piece_table(model_path: str) -> PieceTable:
    """The table of a model file, built once per Python worker."""
    if model_path not in _TABLES:
        _TABLES[model_path] = PieceTable(model_path)
    return _TABLES[model_path]


def encode_table(documents: DataFrame, model_path: str, text_column: str = "text", ids_column: str = "ids") -> DataFrame:
    """`documents` with the ids of each text as a list; a null or empty text has none."""
    def run(batches):
        table = piece_table(model_path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_column))
            ids = [table.encode(t.as_py() or "") for t in texts]
            yield batch.append_column(ids_column, pa.array(ids, pa.list_(pa.int32())))
    if ids_column in documents.columns:
        raise ValueError(f"the table has a column {ids_column}")
    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField(ids_column, T.ArrayType(T.IntegerType()))]))


def decode_table(tokens: DataFrame, model_path: str, ids_column: str = "ids", text_column: str = "decoded") -> DataFrame:
    """`tokens` with the text of each list of ids; a null list has an empty text."""
    def run(batches):
        table = piece_table(model_path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_column))
            yield batch.append_column(text_column, pa.array([table.decode(x.as_py() or []) for x in lists], pa.string()))
    if text_column in tokens.columns:
        raise ValueError(f"the table has a column {text_column}")
    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField(text_column, T.StringType())]))


def token_digests(documents: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each text, encoded and decoded part by part.

    A null text counts as empty: no ids, digests of the empty string. Null ids and repeated rows are kept as they
    are; an empty table gives an empty one; further columns are not read. Parts are encoded one by one and only
    the digests leave the task, so a very long text needs a few times its own size."""
    def run(batches):
        table = piece_table(model_path)
        digest = table.digest_part
        for batch in batches:
            counts, ids_hash, text_hash = [], [], []
            for text in batch.column(1):
                known = table.memo
                found = [known.get(p) or digest(p) for p in table.parts(text.as_py() or "")]
                counts.append(sum([x[0] for x in found]))
                ids_hash.append(hashlib.sha256(",".join([x[1] for x in found]).encode()).hexdigest())
                text_hash.append(hashlib.sha256("".join([x[2] for x in found])[1:].encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
    bound_batches(documents.sparkSession)
    docs = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    schema = docs.schema["id"].dataType.simpleString()
    return (docs.mapInArrow(run, f"id {schema}, n_tokens long, ids_sha256 string, decoded_sha256 string")
            .withColumnRenamed("id", id_column))
