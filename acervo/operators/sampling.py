"""Seeded samples by hash order: stratified, round-robin, several strata at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_of(key: str, seed: int) -> Column:
    """A reproducible random order of keys."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)


def stratified(df: DataFrame, stratum: str, key: str, allocation: dict[str, int], seed: int = 42) -> DataFrame:
    """A fixed number of rows per stratum."""
    size = F.create_map(*[F.lit(x) for kv in allocation.items() for x in kv])
    w = Window.partitionBy(stratum).orderBy(order_of(key, seed))
    picked = df.where(F.col(stratum).isin(*allocation)).withColumn("pick", F.row_number().over(w))
    # the literal bound lets every task keep its own best rows before the shuffle
    return picked.where(F.col("pick") <= max(allocation.values())).where(F.col("pick") <= size[F.col(stratum)])


def round_robin(df: DataFrame, stratum: str, key: str, size: int, seed: int = 42) -> DataFrame:
    """``size`` rows drawn from the strata in turn."""
    w = Window.partitionBy(stratum).orderBy(order_of(key, seed))
    top = df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= size)
    return top.orderBy("turn", stratum).limit(size)
