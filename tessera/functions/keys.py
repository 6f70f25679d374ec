"""Deterministic keys by SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Field separators of the two key formats (fixed values).
UNIT, TAB = "\u001f", "\t"


def _joined(separator: str, parts: tuple[Column | str, ...]) -> Column:
    # concat_ws skips nulls, which would let different keys meet
    columns = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.concat_ws(separator, *columns)


def stable_hex(*parts: Column | str) -> Column:
    """Hex digest of the parts' texts, joined by the unit separator."""
    return F.sha2(_joined(UNIT, parts), 256)


def ranking_key(*parts: Column | str) -> Column:
    """Hex digest of the parts' texts, joined by tabs."""
    return F.sha2(_joined(TAB, parts), 256)


def stable_int(key: Column) -> Column:
    """The first eight bytes of a hex digest as an unsigned number."""
    return F.conv(F.substring(key, 1, 16), 16, 10).cast("decimal(20,0)")


def surrogate_id(salt: str, key: Column | str) -> Column:
    """Sixteen hex digits that stand for a key under a salt."""
    return F.substring(F.sha2(F.concat(F.lit(salt + "|"), (F.col(key) if isinstance(key, str) else key).cast("string")), 256), 1, 16)


def unit_draw(*parts: Column | str) -> Column:
    """A draw from [0, 1) that depends on the parts alone: 32 bits of their MD5."""
    return F.conv(F.substring(F.md5(_joined(":", parts).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
