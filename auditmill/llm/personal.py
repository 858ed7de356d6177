"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score (operator 8).

Only column expressions: a pattern's matches are wrapped in two private-use characters, the text is cut at the
first of them, and positions are running sums of the pieces' lengths, so nothing is searched twice and no row
is exploded. The four base kinds are kept whenever their own test holds; the kinds added here (bank account and
social security numbers) need a score of THRESHOLD.

Patterns are written so that matching is linear: a run is entered at its first character or where the match
before ended, and runs are never given back. This finds the same spans as the plain patterns named in KINDS.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditmill.functions.text import let

OPEN, CLOSE, NEUTRAL = "\ue000", "\ue001", "\ue002"
NEAR = 40            # code points of text on either side that count as context
THRESHOLD = 0.5
BLOCK = 256          # running sums go over blocks of so many matches


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn test."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _mod97(account: Column) -> Column:
    """Whether an account number has the remainder 1: the first four characters go last, letters count from 10."""
    plain = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code >= 65, rest * 100 + code - 55).otherwise(rest * 10 + code - 48) % 97
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _card(match: Column) -> Column:
    return let(_digits(match), lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False))


def _phone(match: Column) -> Column:
    return F.length(_digits(match)).between(8, 15)


_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)"


@dataclass(frozen=True)
class Kind:
    """A kind of span: how to find it, a text it cannot do without, its test, its score and its context words."""

    name: str
    pattern: str
    sign: str
    test: Callable[[Column], Column]
    score: float
    words: str
    against: str = r"\b(?:version|release|section|isbn|sku)\b"
    base: bool = True


KINDS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
         lambda m: F.lit(True), 0.9, r"\b(?:e-?mail|mail|contact|write)\b"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", ".",
         lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"), 0.6, r"\b(?:ip|host|server|address|login)\b"),
    # [0-9]([\x20-]?[0-9])+
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", _card, 0.9, r"\b(?:card|visa|credit|payment)\b"),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", _phone, 0.6, r"\b(?:phone|tel|call|mobile|fax)\b"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
         "", _mod97, 0.7, r"\b(?:iban|account|bank|konto|compte|cuenta)\b", base=False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-",
         lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), 0.3, r"\b(?:ssn|social security|tax id)\b", base=False),
)
BASE = tuple(k for k in KINDS if k.base)
REDACTION_ORDER = ("email", "iban", "phone", "card", "ip", "ssn")


def _running(steps: Column, start: Column) -> Column:
    """Sums of the steps before each one, over blocks so that the copies of growing lists stay small."""
    def sums(values: Column, begin: Column) -> Column:
        return F.aggregate(
            values, F.struct(begin.alias("at"), F.array().cast("array<int>").alias("found")),
            lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["found"], F.array(acc["at"])).alias("found")),
            lambda acc: acc["found"])

    def blocked(all_steps: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_steps) - 1) / BLOCK).cast("int")),
                             lambda b: F.slice(all_steps, b * BLOCK + 1, BLOCK))
        def whole(parts: Column) -> Column:
            totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
            return let(sums(totals, start), lambda begins: F.flatten(F.zip_with(parts, begins, sums)))
        return let(blocks, whole)

    return F.when(F.size(steps) == 0, F.array().cast("array<int>")).when(
        F.size(steps) <= BLOCK, sums(steps, start)).otherwise(let(steps, blocked))


def _marked(text: Column, kind: Kind) -> Column:
    """The text cut before each match; a piece after the first is match, CLOSE, rest."""
    pieces = F.split(F.regexp_replace(text, kind.pattern, f"{OPEN}$0{CLOSE}"), OPEN)
    return F.when(F.contains(text, F.lit(kind.sign)), pieces).otherwise(F.array(text)) if kind.sign else pieces


def _score(kind: Kind, around: Column) -> Column:
    up = F.when(around.rlike(f"(?i){kind.words}"), 0.3).otherwise(0.0)
    down = F.when(around.rlike(f"(?i){kind.against}"), 0.3).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(kind.score) + up - down))


def _found(text: Column, kind: Kind) -> Column:
    """Spans of a kind whose test holds: kind, start, end (code points, end exclusive), score."""
    def from_pieces(pieces: Column) -> Column:
        rests = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
        def spans(rests: Column) -> Column:
            begins = _running(F.transform(rests, lambda p: F.length(p) - 1), F.length(F.element_at(pieces, 1)))
            def span(piece: Column, i: Column, begins: Column) -> Column:
                match = F.substring_index(piece, CLOSE, 1)
                after = F.substring_index(piece, CLOSE, -1)
                before = F.substring_index(F.element_at(pieces, i + 1), CLOSE, -1)
                around = F.concat(F.right(before, F.lit(NEAR)), F.lit(" "), F.left(after, F.lit(NEAR)))
                begin = F.element_at(begins, i + 1)
                return F.struct(F.lit(kind.name).alias("kind"), begin.alias("start"),
                                (begin + F.length(match)).alias("end"),
                                F.when(kind.test(match), _score(kind, around)).alias("score"))
            listed = let(begins, lambda known: F.transform(rests, lambda piece, i: span(piece, i, known)))
            least = 0.0 if kind.base else THRESHOLD
            return F.filter(listed, lambda s: F.coalesce(s["score"] >= least, F.lit(False)))
        return let(rests, spans)
    return let(_marked(text, kind), from_pieces)


def spans(text: Column) -> Column:
    """All spans of a text, in the order of KINDS and then of their starts; private-use marks in it are harmless."""
    clean = F.translate(F.coalesce(text, F.lit("")), OPEN + CLOSE, NEUTRAL * 2)
    return let(clean, lambda t: F.concat(*[_found(t, kind) for kind in KINDS]))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scored) of each row.

    A null or empty text has no spans. Null ids and repeated rows are kept; an empty table gives an empty one;
    further columns are not read. Spans of one kind do not overlap, those of different kinds may."""
    found = documents.select(F.col(id_column), spans(F.col(text_column)).alias("scored"))
    names = [k.name for k in BASE]
    def of(name: str) -> Callable[[Column], Column]:
        return lambda s: s["kind"] == name
    counts = [F.size(F.filter("scored", of(n))).cast("long").alias(f"n_{n}") for n in names]
    base = F.filter("scored", lambda s: s["kind"].isin(names))
    return found.select(id_column, *counts, F.sha2(_joined(base), 256).alias("base_sha256"),
                        _joined(F.col("scored")).alias("spans"), "scored")


# Each pair opens with NEUTRAL, which stands for itself by the pair that is written first and read last.
_PAIRS = ((NEUTRAL, NEUTRAL + "\ue005"), (OPEN, NEUTRAL + "\ue003"), (CLOSE, NEUTRAL + "\ue004"))


def redacted(text: Column) -> Column:
    """The text with [KIND] in place of each span; a null text stays null.

    Kinds are replaced one after the other, those that can hold others first, so overlapping spans go with the
    outer one. Private-use characters of the text that stand for marks here are written as pairs meanwhile."""
    kinds = {k.name: k for k in KINDS}
    def replacing(kind: Kind) -> Callable[[Column], Column]:
        return lambda t: replace(t, kind)
    def replace(t: Column, kind: Kind) -> Column:
        def rebuilt(pieces: Column) -> Column:
            def one(piece: Column, i: Column) -> Column:
                match, after = F.substring_index(piece, CLOSE, 1), F.substring_index(piece, CLOSE, -1)
                before = F.substring_index(F.element_at(pieces, i), CLOSE, -1)
                around = F.concat(F.right(before, F.lit(NEAR)), F.lit(" "), F.left(after, F.lit(NEAR)))
                good = kind.test(match) & (F.lit(True) if kind.base else _score(kind, around) >= THRESHOLD)
                return F.when(i == 0, piece).when(good, F.concat(F.lit(f"[{kind.name.upper()}]"), after)).otherwise(F.concat(match, after))
            return F.when(F.size(pieces) == 1, F.element_at(pieces, 1)).otherwise(F.array_join(F.transform(pieces, one), ""))
        return let(_marked(t, kind), rebuilt)
    out = text
    for char, pair in _PAIRS:
        out = F.replace(out, F.lit(char), F.lit(pair))
    for name in REDACTION_ORDER:
        out = let(out, replacing(kinds[name]))
    for char, pair in reversed(_PAIRS):
        out = F.replace(out, F.lit(pair), F.lit(char))
    return F.when(text.isNotNull(), out)


def redact(documents: DataFrame, text_column: str = "text") -> DataFrame:
    """`documents` with personal data replaced in the text; all other columns and all rows stay."""
    return documents.withColumn(text_column, redacted(F.col(text_column)))
