"""Deterministic pseudo-randomness from row ids.

Every random choice in the library (sampling, splitting, synthetic points,
tree sampling) is a function of ``md5(concat_ws('|', id, seed, tag))``.  The
value is the same on every executor, for any partitioning, after any task
retry, and DuckDB computes the same number, so the SQL oracles can follow.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 15 hex digits of md5 give a non-negative 60-bit integer.
HASH_HEX_DIGITS = 15
HASH_RANGE = float(1 << 60)


def _key(parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def hash60(*parts) -> Column:
    """60-bit non-negative bigint hash of the parts joined with ``|``."""
    return F.conv(F.substring(F.md5(_key(parts)), 1, HASH_HEX_DIGITS), 16, 10).cast("bigint")


def hex4(*parts) -> Column:
    """16-bit hash (first 4 hex digits of md5)."""
    return F.conv(F.substring(F.md5(_key(parts)), 1, 4), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """Uniform double in [0, 1) derived from :func:`hash60`."""
    return hash60(*parts) / F.lit(HASH_RANGE)


# SQL text of the same functions, for the DuckDB oracles.
def sql_hash60(*parts: str) -> str:
    return (f"cast(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, {HASH_HEX_DIGITS}))"
            " as bigint)")


def sql_hex4(*parts: str) -> str:
    return f"cast(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 4)) as bigint)"


def sql_uniform(*parts: str) -> str:
    return f"({sql_hash60(*parts)} / {HASH_RANGE!r})"
