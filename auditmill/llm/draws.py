"""Numbers in (0, 1) drawn from a key by a hash that every engine has, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 52


def unit(*parts: Column) -> Column:
    """(first 52 bits of the md5 of the parts joined by ':' + 0.5) / 2**52; a null part is left out."""
    digits = F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, BITS // 4)
    return (F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << BITS)


def unit_sql(text: str) -> str:
    """The same of a text expression, in SQL."""
    return f"((('0x' || substr(md5({text}), 1, {BITS // 4}))::BIGINT + 0.5) / {float(1 << BITS)!r})"
