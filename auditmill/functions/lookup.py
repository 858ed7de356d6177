"""Keyword rules and name tables as column expressions.

The tables are small parameters, so they become literals of the expression: no join,
no shuffle, and code generation stays on.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditmill import params as P
from auditmill.functions.text import let, strip, suffix

# A word boundary that means the same on every runtime.
WORD = r"[\p{L}\p{N}_]"


def first_match(c: Column, table: Sequence[tuple[str, str]]) -> Column:
    """Value of the first table entry whose keyword occurs in the text, else null."""
    out = None
    for keyword, value in table:
        hit = F.contains(c, F.lit(keyword))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return F.lit(None).cast("string") if out is None else out


def first_tier(c: Column, tiers: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """Name of the first tier with any keyword in the text."""
    out = None
    for name, keywords in tiers:
        hit = F.lit(False)
        for keyword in keywords:
            hit = hit | F.contains(c, F.lit(keyword))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(default)


def guess_severity(name: Column, description: Column, tiers=P.SEVERITY_KEYWORDS, default=P.SEVERITY_DEFAULT) -> Column:
    return let(F.lower(F.concat_ws(" ", name, description)), lambda text: first_tier(text, tiers, default))


def guide_weakness(stem: Column, table=P.GUIDE_WEAKNESSES) -> Column:
    return let(F.translate(F.lower(stem), "- ", "__"), lambda name: first_match(name, table))


def table_value(c: Column, table: Mapping[str, str]) -> Column:
    """Table lookup, null where there is no entry."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.element_at(F.create_map(*entries), c)


def canonical_names(names: Column, table: Mapping[str, str], default: Sequence[str] | None = None) -> Column:
    """Sorted set of known names. With `default`, an empty result becomes that list."""
    found = F.array_sort(F.array_distinct(F.filter(
        F.transform(names, lambda n: table_value(F.lower(n), table)), lambda n: n.isNotNull())))
    if default is None:
        return found
    instead = F.array(*[F.lit(x) for x in default])
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(instead))


def mentioned(c: Column, bank: Sequence[tuple[str, Sequence[str]]] = P.LANGUAGE_WORDS) -> Column:
    """Sorted names of the bank of which a word occurs in the text, in any letter case."""
    # A word's edge after "+" is before a word character: c++11 names the language, "c++ " does not.
    def edged(word: str) -> str:
        return f"{word}(?={WORD})" if word.endswith("+") else f"{word}(?!{WORD})"
    def talks_of(words) -> Column:
        return c.rlike(rf"(?iu)(?<!{WORD})(?:{'|'.join(map(edged, words))})")

    hits = F.array(*[F.when(talks_of(words), name) for name, words in sorted(bank)])
    # One pass for all words first: most texts have none.
    return F.when(talks_of([w for _, words in bank for w in words]), F.filter(hits, lambda n: n.isNotNull())).otherwise(
        F.array().cast("array<string>"))


def file_language(path: Column, table: Mapping[str, str] = P.EXTENSION_LANGUAGES) -> Column:
    return table_value(F.lower(suffix(path)), table)


def fence_language(path: Column) -> Column:
    return F.coalesce(table_value(suffix(path), P.FENCE_LANGUAGES), F.lit(P.FENCE_DEFAULT))


def severity_icon(severity: Column) -> Column:
    return F.coalesce(table_value(severity, P.SEVERITY_ICONS), F.lit("?"))


def severity_rank(severity: Column) -> Column:
    """1 for the gravest; null for a word outside the scale."""
    rank = F.array_position(F.array(*[F.lit(s) for s in P.SEVERITIES]), severity).cast("int")
    return F.when(rank > 0, rank)


def parse_csv(c: Column) -> Column:
    """Items of a comma list, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(c, ",", -1), strip), lambda v: v != "")


def to_csv(c: Column) -> Column:
    return F.coalesce(F.array_join(c, ","), F.lit(""))


def weakness_id(raw: Column) -> Column:
    """Weakness id out of a VARIANT: text that holds one, a bare number, or a list of those."""
    kind = F.schema_of_variant(raw)
    single = F.when(kind.startswith("ARRAY"), F.try_variant_get(raw, "$[0]", "string")).otherwise(
        F.try_variant_get(raw, "$", "string"))

    def composed(text: Column) -> Column:
        named = F.upper(F.regexp_extract(text, r"(?i)(CWE-\d+)", 1))
        return F.when(named != "", named).when(text.rlike(r"\A\d+\z"), F.concat(F.lit("CWE-"), text))

    return let(single, composed)


def first_truthy(*values: Column) -> Column:
    """First VARIANT that is neither null, empty, zero nor false."""
    out = F.lit(None)
    for value in reversed(values):
        text = value.cast("string")
        empty = value.isNull() | F.is_variant_null(value) | text.isin("", "[]", "{}", "0", "false")
        out = F.when(~empty, value).otherwise(out)
    return out
