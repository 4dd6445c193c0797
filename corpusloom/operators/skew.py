"""Joins that survive a key holding a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of all rows on, so there are never more than 64 hot keys.
HOT_SHARE = 1 / 64
SALTS = 32


def hot_keys(counts: DataFrame, key: str, n: str, total: int | None = None, share: float = HOT_SHARE, least: int = 10_000) -> list:
    """Keys of ``counts`` (one row per key, ``n`` its rows) that hold at least ``share`` of all rows: at most 1/share values."""
    if total is None:
        total = counts.agg(F.sum(n)).first()[0] or 0
    floor = max(int(total * share), least)
    return [r[0] for r in counts.where((F.col(n) >= floor) & F.col(key).isNotNull()).select(key).limit(int(1 / share) + 1).collect()]


def salt_of(key: str, spread: Column, hot: list, salts: int = SALTS) -> Column:
    """0 for ordinary keys; for hot ones a salt taken from ``spread`` (any column that varies among their rows)."""
    if not hot:
        return F.lit(0)
    return F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))


def replicated(df: DataFrame, key: str, hot: list, salt: str = "_salt", salts: int = SALTS) -> DataFrame:
    """The other side of a salted join: hot rows once per salt."""
    if not hot:
        return df.withColumn(salt, F.lit(0))
    many = F.when(F.col(key).isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return df.withColumn(salt, F.explode(many))


def salted_join(big: DataFrame, small: DataFrame, key: str, spread: Column, hot: list, how: str = "inner") -> DataFrame:
    """``big`` join ``small`` (one row per key) on ``key``, the hot keys split over SALTS tasks."""
    left = big.withColumn("_salt", salt_of(key, spread, hot))
    return left.join(replicated(small, key, hot), [key, "_salt"], how).drop("_salt")
