"""Model replies (JSON) as findings.

A reply is cut into the texts of its items and each item is parsed alone, so one bad item never hides the good
ones: neither a number that is none (`NaN`) nor a member given twice (the last one counts) costs more than its
item. None of it depends on the settings of the session. Each item is either a finding or has a `reason` why it
is none. An item that is itself a text is read as what it spells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditmill import params as P
from auditmill.functions.text import chunk_snippet, let

NUMBER = r"(?i)\A\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?\s*\z"


STRICT = {"allowSingleQuotes": "false"}
MEMBERS = ("cwe_id", "severity", "title", "description", "recommendation", "line_start", "line_end", "confidence")


def reply_items(raw: Column) -> Column:
    """array<string>: JSON of each finding in a reply; empty if it is no JSON or has no such list.

    A second value is put after the reply, so that what follows a whole JSON text is not overlooked."""
    both = F.from_json(F.concat(F.lit("["), raw, F.lit(",{}]")), "array<struct<findings: array<string>>>", STRICT)
    found = let(both, lambda t: F.when(F.size(t) == 2, F.get(t, F.lit(0))["findings"]))
    return F.coalesce(found, F.array().cast("array<string>"))


def item_members(item: Column) -> Column:
    """The members of one item, each a VARIANT; null where missing."""
    return F.from_json(item, ", ".join(f"{name} variant" for name in MEMBERS), STRICT)


class _Field:
    """One member of an item: missing, of a usable type, or neither."""

    def __init__(self, members: Column, name: str):
        self.raw = members[name]
        self.kind = F.schema_of_variant(self.raw)
        self.missing = self.raw.isNull()

    def value(self, kind: str) -> Column:
        return F.try_variant_get(self.raw, "$", kind)

    def text(self, default: Column | str) -> Column:
        """The text, or the default if missing; null if it is no text."""
        default = F.lit(default) if isinstance(default, str) else default
        return F.when(self.missing, default).when(self.kind == "STRING", self.value("string"))

    def integer(self, default: Column) -> Column:
        """A number cut to an integer, or text that is one; null if neither."""
        return F.when(self.missing, default.cast("bigint")).otherwise(self.value("bigint"))

    def number(self, default: float) -> Column:
        plain = (self.kind != "STRING") | self.value("string").rlike(NUMBER)
        return F.when(self.missing, F.lit(default)).when(plain, self.value("double"))


TYPED = ("cwe_id", "severity", "title", "description", "recommendation", "line_start", "confidence")


def read_item(item: Column, chunk_start: Column, code: Column) -> Column:
    """Typed members of one item (JSON), the cited lines, and the `reason` it is no finding (null if
    it is one)."""
    return let(item_members(item), lambda m: _read(item, m, chunk_start, code))


def _read(item: Column, members: Column, chunk_start: Column, code: Column) -> Column:
    def field(name: str) -> _Field:
        return _Field(members, name)

    typed = F.struct(
        field("cwe_id").text(F.lit(None)).alias("cwe_id"),
        F.lower(field("severity").text("medium")).alias("severity"),
        field("title").text("").alias("title"),
        field("description").text("").alias("description"),
        field("recommendation").text("").alias("recommendation"),
        field("line_start").integer(chunk_start).alias("line_start"),
        field("confidence").number(0.5).alias("confidence"),
    )

    def with_end(t: Column) -> Column:
        end = field("line_end").integer(t["line_start"])
        return let(F.struct(*[t[c].alias(c) for c in TYPED], end.alias("line_end")), with_reason)

    def with_reason(t: Column) -> Column:
        no_text = t["title"].isNull() | t["description"].isNull() | t["recommendation"].isNull()
        reason = (
            F.when(~F.coalesce(F.startswith(item, F.lit("{")), F.lit(False)), "not_an_object")
            .when(field("cwe_id").missing, "missing_id")
            .when(t["line_start"].isNull() | t["line_end"].isNull(), "bad_line")
            .when(t["confidence"].isNull() | ~t["confidence"].between(0.0, 1.0), "bad_confidence")
            .when(t["severity"].isNull() | ~t["severity"].isin(*P.SEVERITIES), "bad_severity")
            .when(t["cwe_id"].isNull() | no_text, "bad_text")
        )
        snippet = chunk_snippet(code, chunk_start, t["line_start"], t["line_end"])
        return F.struct(
            *[t[c].alias(c) for c in (*TYPED, "line_end")],
            F.when(reason.isNull(), snippet).alias("code_snippet"),
            reason.alias("reason"),
        )

    return let(typed, with_end)


def parse(answered: DataFrame) -> DataFrame:
    """Replies (`raw`) that stand next to `chunk_start` and `code` of their chunk, with `items`."""
    return answered.withColumn("items", F.transform(
        reply_items(F.col("raw")), lambda item: read_item(item, F.col("chunk_start"), F.col("code"))))


def has_finding(items: Column) -> Column:
    return F.exists(items, lambda item: item["reason"].isNull())


def explode_items(parsed: DataFrame) -> DataFrame:
    """One row per item, with its number in the reply."""
    others = [c for c in parsed.columns if c not in ("raw", "code", "items")]
    # The outer form: the plain one lets Spark test the list's size below the projection, which parses twice.
    exploded = parsed.select(*others, F.posexplode_outer("items").alias("item_no", "item"))
    return exploded.filter("item_no is not null").select(*others, "item_no", "item.*")


def parse_replies(replies: DataFrame, chunks: DataFrame) -> DataFrame:
    """Items of stored replies (chunk_id, attempt, raw), with path and cited lines of their chunk.

    Replies and chunks meet before the items are exploded, so a reply with many items is
    one row of the join."""
    chunk = chunks.select("chunk_id", "file_path", F.col("line_start").alias("chunk_start"), "code")
    return explode_items(parse(replies.join(chunk, "chunk_id")))


def first_attempt_with_findings(findings: DataFrame, key: str = "chunk_id", attempt: str = "attempt") -> DataFrame:
    """Per chunk, the findings of the first attempt that gave any."""
    first = findings.groupBy(key).agg(F.min(attempt).alias(attempt))
    return findings.join(first, [key, attempt], "left_semi")
