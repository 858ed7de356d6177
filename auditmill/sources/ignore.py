"""Ignore-file lines as a predicate over relative paths.

The lines of one ignore file are a handful of patterns, so they become one expression:
the last pattern that matches decides, and a pattern with `!` takes a path back in.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _segment_regex(segment: str) -> str:
    """One path part with its wildcards; none of them crosses a slash."""
    if segment == "*":
        return "[^/]+"
    out, i = "", 0
    while i < len(segment):
        ch = segment[i]
        close = segment.find("]", i + 2) if ch == "[" else -1
        if ch == "\\" and i + 1 < len(segment):
            i += 1
            out += re.escape(segment[i])
        elif ch == "*":
            out += "[^/]*"
        elif ch == "?":
            out += "[^/]"
        elif close > 0:
            body = segment[i + 1:close].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            i = close
        else:
            out += re.escape(ch)
        i += 1
    return out


def ignore_rule(line: str) -> tuple[str, bool] | None:
    """(regex, negated) of one line; None for a blank line or a comment."""
    text = line.rstrip("\r\n")
    if not text.endswith("\\ "):
        text = text.rstrip()
    if not text or text.startswith("#") or text == "/":
        return None
    negated = text.startswith("!")
    text = text[1:] if negated else text
    only_dir = text.endswith("/")
    parts = [p for p in text.split("/") if p]
    if not parts:
        return None
    anchored = text.startswith("/") or len(parts) > 1
    regex = "" if anchored else "(?:.+/)?"
    for n, part in enumerate(parts):
        last = n == len(parts) - 1
        if part == "**":
            regex += ".*" if last else "(?:.+/)?"
        else:
            regex += _segment_regex(part) + ("" if last else "/")
    if parts[-1] != "**":
        regex += "/.*" if only_dir else "(?:/.*)?"
    return rf"\A{regex}\z", negated


def is_ignored(rel_path: Column, lines: Iterable[str]) -> Column:
    """True where the last matching line leaves the path out."""
    verdict = F.lit(False)
    for rule in map(ignore_rule, lines):
        if rule:
            verdict = F.when(rel_path.rlike("(?s)" + rule[0]), F.lit(not rule[1])).otherwise(verdict)
    return verdict
