"""Seeded, engine-independent hashes for splits, samples and resampling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def h32(*parts: Column | str | int) -> Column:
    """First 32 bits of md5 over the parts joined by a bar, as BIGINT."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def seeded_digest(key: Column, seed: int) -> Column:
    """Hex md5 of key and seed: a stable random order."""
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))).cast("binary"))


def pick(key: Column, seed: int, options: list[Column | str]) -> Column:
    """One of the options, chosen by hash: a reproducible stand-in for a random choice."""
    cols = [o if isinstance(o, Column) else F.lit(o) for o in options]
    return F.element_at(F.array(*cols), (F.pmod(h32(key, seed), F.lit(len(cols))) + 1).cast("int"))
