"""Groups of records that redirect to one another, by hash-to-min.

Every vertex v holds a cluster C(v), at first itself and its neighbours. In a round v sends C(v) to the least
member m of C(v), and m to all of C(v); the union of what arrives is the next C(v). At the end the least vertex of a
component holds the component, and every other vertex holds that least vertex. Rounds grow with the logarithm of the
longest chain.

A cluster is kept as rows (v, u), never as an array, so the cluster of a hub is spread over tasks: its minimum is a
partial aggregation, and the join that sends it back salts the at most 64 vertices with over 1/64 of all rows.
Each round is checkpointed in the shared folder; convergence is a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.skew import hot_keys, salted_join
from corpusloom.session import cut
from corpusloom.tables import current_rows


def _sum(df: DataFrame) -> tuple:
    r = df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "u"))).first()
    return r[0], r[1]


def hash_to_min(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, label): the least vertex of the component of every vertex of ``edges`` (a, b: strings; null ends are left out).

    Repeated edges, self loops and both directions are fine; an isolated vertex comes in as (a, a). Empty in, empty out.
    """
    e = edges.select("a", "b").where("a is not null and b is not null")
    ends = F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")), F.struct(F.col("a").alias("v"), F.col("a").alias("u")), F.struct(F.col("b").alias("v"), F.col("b").alias("u")))).alias("e")
    rows = cut(e.select(ends).select("e.v", "e.u").distinct())
    state = _sum(rows)
    for _ in range(max_rounds):
        least = rows.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n"))
        hot = hot_keys(least, "v", "n", state[0])
        sent = salted_join(rows, least.select("v", "m"), "v", F.col("u"), hot)
        both = F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")
        rows = cut(sent.select(both).select("e.v", "e.u").distinct())
        now = _sum(rows)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"no stable clusters after {max_rounds} rounds")
    return rows.groupBy("v").agg(F.min("u").alias("label"))


SEP = "\x01"


def redirect_groups(registry: DataFrame) -> DataFrame:
    """(brain_id, slug, group_slug) of every existing record whose group has at least two existing records.

    Current rows only. Merged rows (any case, trimmed) link their slug to canonical_slug (trimmed, lower case) within the
    brain; a target that doesn't exist joins those that point at it. group_slug is the least existing slug. Null brain,
    slug or target makes no link; a redirect to itself makes none; rings are groups.
    """
    now = current_rows(registry.select("brain_id", "slug", "status", "canonical_slug", "updated_at"), ["brain_id", "slug"]).where("brain_id is not null and slug is not null")
    target = F.lower(F.trim("canonical_slug"))
    merged = now.where(F.lower(F.trim("status")) == "merged").select("brain_id", "slug", target.alias("to")).where("to != '' and to != slug")
    exists = now.select("brain_id", F.col("slug").alias("to"), F.lit(True).alias("there"))
    # one row per target, however many records point at it
    targets = merged.select("brain_id", "to").distinct().join(exists, ["brain_id", "to"], "left")
    key = lambda b, s: F.concat(b, F.lit(SEP), s)
    absent = targets.where("there is null").select(key(F.col("brain_id"), F.col("to")).alias("v"))
    labels = hash_to_min(merged.select(key(F.col("brain_id"), F.col("slug")).alias("a"), key(F.col("brain_id"), F.col("to")).alias("b")))
    labels = cut(labels.join(absent.withColumn("absent", F.lit(True)), "v", "left"))
    sizes = labels.where("absent is null").groupBy("label").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("n"))
    hot = hot_keys(sizes, "label", "n")
    found = salted_join(labels.where("absent is null"), sizes.where("n > 1").select("label", "least"), "label", F.col("v"), hot)
    part = lambda c, i: F.split_part(F.col(c), F.lit(SEP), F.lit(i))
    return found.select(part("v", 1).alias("brain_id"), part("v", 2).alias("slug"), part("least", 2).alias("group_slug"))


def resolved_records(registry: DataFrame) -> DataFrame:
    """Every current record with its group: its own slug where it is alone. n is the number of records of the group."""
    now = current_rows(registry.select("brain_id", "slug", "updated_at"), ["brain_id", "slug"]).where("brain_id is not null and slug is not null")
    g = redirect_groups(registry)
    all_ = now.select("brain_id", "slug").join(g, ["brain_id", "slug"], "left")
    return all_.select("brain_id", "slug", F.coalesce("group_slug", "slug").alias("group_slug"))
