"""Groups whose key may be hot: grouped by key and salt, and joined back by key and salt.

A row's salt is a hash of its id (or other unit), so a key's rows are dealt over ``SALTS`` tasks
both ways. Which salts a key has is kept as the bits of one long, so each key comes back to its
rows only as often as it has salts, at most ``SALTS`` times and once for a key of one row. Rows without
an id have a salt by their place in the scan, which another scan need not repeat; so a key that has such
rows comes back on all salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 32
ALL_SALTS = (1 << SALTS) - 1


def salt_of(unit: str) -> Column:
    place = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
    return F.when(F.col(unit).isNull(), place).otherwise(F.pmod(F.xxhash64(unit), F.lit(SALTS))).cast("int")


def salt_bit(unit: str) -> Column:
    """The salt as one bit of a long, all bits without an id; ``bit_or`` gathers the salts of a group."""
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64({unit}), {SALTS}) as int))")
    return F.when(F.col(unit).isNull(), F.lit(ALL_SALTS)).otherwise(bit)


def back_to_rows(groups: DataFrame, salts: str = "salts") -> DataFrame:
    """``groups`` once for each of its salts, the column ``salt`` in place of ``salts``."""
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    held = F.filter(every, lambda k: F.getbit(F.col(salts), k) == 1)
    return groups.withColumn("salt", F.explode(held)).drop(salts)


def with_group(rows: DataFrame, key: str, unit: str, *aggs: Column) -> DataFrame:
    """``rows`` with aggregates of their key: the first half of ``aggs`` within a salt, the rest over salts."""
    half = len(aggs) // 2
    salted = rows.withColumn("salt", salt_of(unit))
    local = salted.groupBy(key, "salt").agg(*aggs[:half])
    whole = local.groupBy(key).agg(*aggs[half:], F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"))
    return salted.join(back_to_rows(whole), [key, "salt"]).drop("salt")
