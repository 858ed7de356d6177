"""Text functions as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that Python calls white space, and the ones that end a line for it.
BLANK = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
BLANKS = "".join(c for c in map(chr, range(0x3001)) if re.fullmatch(BLANK, c))
LINE_END = r"\r\n|[\n-\r\x1c-\x1e\x85\u2028\u2029]"


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends. Only the ends are looked at: a regular expression would try every
    position in between."""
    return F.trim(c, F.lit(BLANKS))


def normalize_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def decode_text(c: Column) -> Column:
    """Binary to text: bad bytes become U+FFFD and every line ends in a newline."""
    return normalize_newlines(F.make_valid_utf8(c.cast("string")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often `body` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def split_lines(c: Column) -> Column:
    """All lines of a text; a line end at the very end opens no further line."""
    return let(F.split(c, LINE_END, -1), lambda parts: F.when(
        F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def line_count(c: Column) -> Column:
    return F.size(split_lines(c))


def number_lines(code: Column, first: Column) -> Column:
    """Put ` N | ` in front of each line; the width is that of the number after the last one."""

    def numbered(s: Column) -> Column:
        return F.array_join(F.transform(s["lines"], lambda line, i: F.concat(
            F.lpad((s["first"] + i).cast("string"), s["width"], " "), F.lit(" | "), line)), "\n")

    return let(split_lines(code), lambda lines: let(
        F.struct(
            lines.alias("lines"),
            first.alias("first"),
            F.length((first + F.size(lines)).cast("string")).alias("width"),
        ),
        numbered,
    ))


def slice_lines(code: Column, skip: Column, count: Column) -> Column:
    """`count` lines after the first `skip` lines, joined again."""
    return F.array_join(F.slice(split_lines(code), skip + 1, count), "\n")


def chunk_snippet(code: Column, chunk_start: Column, line_start: Column, line_end: Column) -> Column:
    """The cited lines of a chunk: at least one line, from the top if the start lies before it."""
    skip = F.greatest(F.lit(0).cast("bigint"), line_start - chunk_start)
    stop = F.greatest(skip + 1, line_end - chunk_start + 1)
    # Positions past the end of the text are the same as its end.
    bound = F.length(code).cast("bigint") + 1
    skip, stop = F.least(skip, bound), F.least(stop, bound + 1)
    return slice_lines(code, skip.cast("int"), (stop - skip).cast("int"))


def file_snippet(text: Column, line_start: Column, line_end: Column) -> Column:
    """Lines `line_start` to `line_end` of a file, clamped to it. Only newlines count here."""
    first = F.greatest(F.lit(1), line_start)

    def cut(lines: Column) -> Column:
        last = F.least(F.size(lines), line_end)
        return F.array_join(F.slice(lines, first, F.greatest(F.lit(0), last - first + 1)), "\n")

    return let(F.split(text, "\n", -1), cut)


def clean_markup(c: Column) -> Column:
    """Drop tags, keep the text of links, and leave at most one empty line in a row."""
    no_tags = F.regexp_replace(c, r"<[^>]+>", "")
    no_links = F.regexp_replace(no_tags, r"\[([^\]]+)\]\([^)]+\)", "$1")
    return strip(F.regexp_replace(no_links, r"\n{3,}", "\n\n"))


def ellipsis(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("..."))).otherwise(c)


def percent(c: Column) -> Column:
    """A share as whole per cent, cut and not rounded."""
    return (c * 100).cast("int")


def join_parts(parts: list[Column], sep: str) -> Column:
    """Join the parts that are neither null nor empty."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), sep)


def labelled(label: str, value: Column) -> Column:
    """`label` and the value, or null for an empty value."""
    return F.when(value != "", F.concat(F.lit(label), value))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def suffix(path: Column) -> Column:
    """Last extension with its dot; a leading dot starts no extension."""
    return F.regexp_extract(base_name(path), r"[^.].*(\.[^.]+)\z", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=[^.])\.[^.]+\z", "")
