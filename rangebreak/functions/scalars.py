"""Column expressions shared by several operators. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def direction_sign(direction: Column) -> Column:
    return F.when(direction == "long", F.lit(1.0)).otherwise(F.lit(-1.0))


def opposite(direction: Column) -> Column:
    return F.when(direction == "long", F.lit("short")).otherwise(F.lit("long"))


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` where the denominator is positive, else NULL."""
    return F.when(bottom > 0, top / bottom)


def count_when(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def logit(p: Column, floor: float, ceiling: float) -> Column:
    clipped = F.least(F.greatest(p, F.lit(floor)), F.lit(ceiling))
    return F.log(clipped / (F.lit(1.0) - clipped))


def expit(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def hash_pick(parts: Iterable[Column], modulus: Column) -> Column:
    """Deterministic uniform integer in ``[0, modulus)`` from the first 32 bits of an MD5.

    The draw depends only on its key, so a retried task or a lost executor repeats it.
    """
    digest = F.md5(F.concat_ws(":", *parts))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), modulus)


def clock(slot: Column, start_minute: int, slot_minutes: int) -> Column:
    """Bar start as ``HH:MM``."""
    minute = F.lit(start_minute) + slot * F.lit(slot_minutes)
    return F.format_string(
        "%02d:%02d", F.floor(minute / 60).cast("int"), F.pmod(minute, F.lit(60)).cast("int")
    )
