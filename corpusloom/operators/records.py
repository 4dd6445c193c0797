"""The registry of people and things: lookup by name, redirects, conflicts, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.skew import hot_keys, salted_join
from corpusloom.tables import current_rows


def current_records(registry: DataFrame) -> DataFrame:
    """Current rows with status and canonical_slug trimmed in lower case; the target of a row that isn't merged is its slug."""
    now = current_rows(registry.where("brain_id is not null and slug is not null"), ["brain_id", "slug"])
    now = now.withColumn("status", F.lower(F.trim("status")))
    target = F.lower(F.trim("canonical_slug"))
    return now.withColumn("canonical_slug", F.when((F.col("status") == "merged") & (F.coalesce(target, F.lit("")) != ""), target).otherwise(F.col("slug")))


def name_table(records: DataFrame) -> DataFrame:
    """(brain_id, name, slug): every name of a record: slug, title and aliases, in lower case."""
    aliases = F.coalesce(F.from_json("aliases_json", "array<string>"), F.array().cast("array<string>"))
    names = F.array_distinct(F.transform(F.concat(F.array("slug", "title"), aliases), lambda x: F.lower(F.trim(x))))
    return records.select("brain_id", F.explode(F.filter(names, lambda x: x.isNotNull() & (x != ""))).alias("name"), "slug")


def _key(brain: str, name: str) -> Column:
    return F.concat(brain, F.lit("\x01"), name).alias("_key")


def resolved(records: DataFrame, steps: int = 2) -> DataFrame:
    """(brain_id, slug, target, steps): where at most ``steps`` redirects lead. A missing target is where it ends."""
    hop = records.select(_key("brain_id", "slug"), F.col("canonical_slug").alias("_next"))
    out = records.select("brain_id", "slug", F.col("canonical_slug").alias("target"), (F.col("slug") != F.col("canonical_slug")).cast("int").alias("steps"))
    for _ in range(steps - 1):
        keyed = out.withColumn("_key", _key("brain_id", "target"))
        # a record that very many others redirect to is spread over tasks
        hot = hot_keys(keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("n")), "_key", "n")
        keyed = salted_join(keyed, hop, "_key", F.col("slug"), hot, "left")
        out = keyed.select("brain_id", "slug", F.coalesce("_next", "target").alias("target"), (F.col("steps") + F.coalesce((F.col("_next") != F.col("target")).cast("int"), F.lit(0))).alias("steps"))
    return out


def alias_conflicts(records: DataFrame) -> DataFrame:
    """(brain_id, name, n, least_slug): names that two or more active records of a brain share."""
    return name_table(records.where("status = 'active'")).groupBy("brain_id", "name").agg(F.count_distinct("slug").alias("n"), F.min("slug").alias("least_slug")).where("n > 1")


def mentions(links: DataFrame, records: DataFrame) -> DataFrame:
    """(id, slug): links to a name, with the record of the link's brain that has it; of several the least slug."""
    named = name_table(records).groupBy("brain_id", "name").agg(F.min("slug").alias("slug"))
    bare = links.where(F.col("to_ref").isNotNull() & ~F.col("to_ref").rlike(r"[/\\]")).select("id", "brain_id", F.lower(F.trim("to_ref")).alias("name")).distinct()
    bare, named = bare.select("id", _key("brain_id", "name")), named.select(_key("brain_id", "name"), "slug")
    hot = hot_keys(bare.groupBy("_key").agg(F.count(F.lit(1)).alias("n")), "_key", "n")
    return salted_join(bare, named, "_key", F.col("id"), hot).select("id", "slug")


def merged_members(records: DataFrame) -> DataFrame:
    """(brain_id, target, slug, alias): what merging puts together, a row for each alias and at least one for each record."""
    r = resolved(records).join(records.select("brain_id", "slug", F.coalesce(F.from_json("aliases_json", "array<string>"), F.array().cast("array<string>")).alias("a")), ["brain_id", "slug"])
    return r.select("brain_id", "target", "slug", F.explode_outer("a").alias("alias"))


def merged_records(records: DataFrame) -> DataFrame:
    """(brain_id, target, n, slugs, n_aliases): what merging makes of the records that redirect to a target.

    The slugs of a target are one value and must fit in memory; ``merged_members`` has them, and the aliases, as rows.
    """
    g = merged_members(records).groupBy("brain_id", "target").agg(F.count_distinct("slug").alias("n"), F.count_distinct("alias").cast("int").alias("n_aliases"), F.array_sort(F.collect_set("slug")).alias("slugs"))
    return g.where("n > 1").select("brain_id", "target", "n", "slugs", "n_aliases")
