"""Deterministic pseudo-random draws: the same row always gets the same draw.

A draw hashes its key together with the seed, the epoch and the number of the draw, so
different seeds, epochs and draws are unrelated to each other. Keys of any type and size
will do: their text is hashed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = 1 << 32


def order_key(key, seed: int = 42, epoch: int = 0, draw: int = 0) -> Column:
    """Uniform 32-bit order key: the leading eight hexadecimal digits of an MD5 digest."""
    k = F.col(key) if isinstance(key, str) else key
    text = F.concat(k.cast("string"), F.lit(f":{seed}:{epoch}:{draw}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def unit_draw(key, seed: int = 42, epoch: int = 0, draw: int = 0) -> Column:
    """Draw in [0, 1)."""
    return order_key(key, seed, epoch, draw) / F.lit(float(RANGE))


def is_validation(key, ratio: float, seed: int = 42) -> Column:
    """Order-independent split draw, in steps of one millionth."""
    return (order_key(key, seed) % 1000000) < int(round(ratio * 1000000))


def order_key_sql(key: str, seed: int = 42, epoch: str = "0", draw: int = 0) -> str:
    """The same draw as DuckDB text; ``epoch`` may be an expression."""
    return (f"CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{seed}:' || CAST({epoch} AS VARCHAR) || ':{draw}'), 1, 8) AS BIGINT)")
