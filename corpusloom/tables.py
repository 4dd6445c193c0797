"""Reading the given tables. Every reader takes the folder of one scale; a table is one parquet file or folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def current_rows(df: DataFrame, keys: list[str], order: str = "updated_at") -> DataFrame:
    """The current row of each key: the latest ``order``; ties fall to the greatest row, so copies count once.

    One partial aggregation, no window: a key with many versions never gathers in one task.
    """
    rest = [c for c in df.columns if c not in keys and c != order]
    best = F.max(F.struct(F.col(order), *[F.col(c) for c in rest])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("_best")[c].alias(c) for c in [order, *rest]])
