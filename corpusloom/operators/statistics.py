"""Aggregates over logs and facts, the trend of a metric, and measures of search quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def query_statistics(log: DataFrame) -> DataFrame:
    """One row from (hit_count, avg_score, latency_ms): n, share without a hit, mean score, mean latency of rows that have one."""
    n = F.count(F.lit(1))
    return log.agg(
        n.alias("n_queries"), ratio(F.sum((F.col("hit_count") == 0).cast("long")), n).alias("zero_rate"), F.coalesce(F.avg("avg_score"), F.lit(0.0)).alias("avg_score"),
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"),
    )


def tokens_used(costs: DataFrame, day: str) -> DataFrame:
    """(day, tokens, n_calls) of the calls of a UTC day that weren't skipped."""
    c = costs.where(F.startswith(F.col("at").cast("string"), F.lit(day)) & ~F.coalesce(F.col("skipped"), F.lit(False)))
    return c.agg(F.lit(day).alias("day"), F.coalesce(F.sum(F.col("tokens_in") + F.col("tokens_out")), F.lit(0)).cast("long").alias("tokens"), F.count(F.lit(1)).alias("n_calls"))


def evidence_shares(hits: DataFrame) -> DataFrame:
    """(tag, n, share) of the evidence tags of hits."""
    t = hits.select(F.explode(F.concat("evidence", F.array(F.lit("")))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    # one pass: the empty tag counts the hits; what is left is a row per tag
    every = F.max(F.when(F.col("tag") == "", F.col("n"))).over(Window.partitionBy(F.lit(0)))
    return t.withColumn("share", ratio(F.col("n").cast("double"), every)).where("tag <> ''")


def event_list(events: DataFrame, type_: str | None = None, source: int | None = None, since: str | None = None, limit: int = 50) -> DataFrame:
    """The latest events that pass the filters. Filters reach the scan; only ``limit`` rows are sorted per task."""
    e = events
    if type_:
        e = e.where(F.col("event_type") == type_)
    if source is not None:
        e = e.where(F.col("user_id") == source)
    if since:
        e = e.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)


def trends(facts: DataFrame, threshold: float = 0.10, lower_is_better: bool = False) -> DataFrame:
    """(metric, n, old_key, old_value, new_key, new_value, drop, verdict) from facts (metric, at, period, value).

    Facts are sorted by period, else at, as text. The latest neighbouring pair whose older value isn't 0 is compared; the
    verdict is regressing, stable, or insufficient if there is no such pair. Metrics are compared trimmed, in lower case.
    """
    f = facts.select(F.lower(F.trim("metric")).alias("metric"), F.coalesce("period", "at").alias("key"), F.col("value").cast("double").alias("value"))
    f = f.where(F.col("metric").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value") & ~F.abs("value").isin(float("inf")))
    w = Window.partitionBy("metric").orderBy("key", "value")
    f = f.withColumn("old_key", F.lag("key").over(w)).withColumn("old_value", F.lag("value").over(w)).withColumn("i", F.row_number().over(w))
    usable = F.col("old_value").isNotNull() & (F.col("old_value") != 0)
    pair = F.max(F.when(usable, F.struct("i", "old_key", "old_value", F.col("key").alias("new_key"), F.col("value").alias("new_value")))).alias("p")
    g = f.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), pair).select("metric", "n", "p.old_key", "p.old_value", "p.new_key", "p.new_value")
    drop = (F.col("old_value") - F.col("new_value")) / F.abs("old_value") * (-1.0 if lower_is_better else 1.0)
    verdict = F.when(F.col("old_value").isNull(), "insufficient").when(drop >= threshold, "regressing").otherwise("stable")
    return g.withColumn("drop", drop).withColumn("verdict", verdict)


def hit_rates(ranked: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row of hit_rate and top1_rate from ranked (query_id, path, rank) and wanted (query_id, part): part occurs in the path."""
    j = wanted.join(ranked, "query_id", "left")
    hit = F.coalesce(F.contains(F.col("path"), F.col("part")), F.lit(False))
    q = j.groupBy("query_id").agg(F.max(hit).alias("hit"), F.max(hit & (F.col("rank") == 1)).alias("top1"))
    return q.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.avg(F.col("top1").cast("double")).alias("top1_rate"))
