"""Deterministic pseudo-random values: the same on every run, engine and retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_digest(*parts: Column | int | str) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws("-", *[c.cast("string") for c in cols]))


def seeded_hash(*parts: Column | int | str) -> Column:
    """32-bit value from the first eight hex digits of an md5 over the parts."""
    return F.conv(F.substring(seeded_digest(*parts), 1, 8), 16, 10).cast("long")


def md5_mod(c: Column, m: Column) -> Column:
    """The full 128-bit md5 of a string modulo ``m``, folded digit by digit."""
    digits = F.transform(F.split(F.md5(c), ""), lambda h: F.conv(h, 16, 10).cast("long"))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda acc, d: (acc * 16 + d) % m)
