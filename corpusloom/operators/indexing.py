"""Building and maintaining the tables that searches read: chunks, postings, and the incremental sync by content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T

POSTING_BUCKETS = 64


def chunk_table(pages: DataFrame, text: str = "body_text", key: str = "path") -> DataFrame:
    """(id, key, chunk_index, text): the pieces of every page, in place."""
    return pages.select(key, F.posexplode(T.chunks(F.col(text))).alias("chunk_index", "text")).select(F.concat(F.col(key).cast("string"), F.lit("#"), "chunk_index").alias("id"), key, "chunk_index", "text")


def postings(pages: DataFrame) -> DataFrame:
    """(brain_id, term, field, path, positions): the inverted index; ``write_postings`` keeps it."""

    def of(field: str) -> DataFrame:
        return pages.select("brain_id", "path", F.lit(field).alias("field"), F.posexplode(T.words(F.coalesce(field, F.lit("")))).alias("pos", "term"))

    both = of("title").unionByName(of("body_text"))
    return both.groupBy("brain_id", "term", "field", "path").agg(F.array_sort(F.collect_list(F.col("pos") + 1)).alias("positions"))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(POSTING_BUCKETS)).cast("int")


def write_postings(pages: DataFrame, path: str) -> None:
    """Write the inverted index once: a folder per bucket of terms, sorted by term, so that a query reads its own terms only."""
    p = postings(pages).withColumn("bucket", _bucket(F.col("term")))
    p.repartitionByRange("bucket", "term", "path").sortWithinPartitions("bucket", "term", "path").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_postings(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """The postings of ``terms``: other buckets aren't opened, and the files of a bucket are skipped by their ranges of terms."""
    p = spark.read.parquet(path)
    return p.where(F.col("bucket").isin([_bucket(F.lit(t)) for t in terms]) & F.col("term").isin(terms)).drop("bucket")


def term_statistics(pages: DataFrame) -> DataFrame:
    """(term, n_pages, n_occurrences) over all pages; counted before the shuffle."""
    w = pages.select(F.explode(T.words(F.col("body_text"))).alias("term"), "path")
    return w.groupBy("term", "path").agg(F.count(F.lit(1)).alias("c")).groupBy("term").agg(F.count(F.lit(1)).alias("n_pages"), F.sum("c").alias("n_occurrences"))


def sync_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, action): insert, update, unchanged or delete, from (path, content_hash) of the index and of the files.

    A full outer join on the path; a parquet table has no MERGE, so the sink rewrites the partitions of the brains touched.
    """
    o, n = old.select("path", F.col("content_hash").alias("_old")), new.select("path", F.col("content_hash").alias("_new"))
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("update")
    return o.join(n, "path", "full_outer").select("path", action.alias("action"))


def synced(old: DataFrame, new: DataFrame) -> DataFrame:
    """The index after a sync: new and changed rows from ``new``, the others as they are, vanished ones gone."""
    plan = sync_plan(old, new)
    keep = old.join(plan.where("action = 'unchanged'").select("path"), "path", "left_semi")
    take = new.join(plan.where("action in ('insert', 'update')").select("path"), "path", "left_semi")
    return keep.unionByName(take.select(*keep.columns))


def unique_links(links: DataFrame) -> DataFrame:
    """Links with an id once: the row with the earliest synced_at; ties fall to the least row."""
    rest = [c for c in links.columns if c not in ("id", "synced_at")]
    first = links.groupBy("id").agg(F.min(F.struct("synced_at", *rest)).alias("_r"))
    return first.select("id", "_r.*")


def replaced_links(old: DataFrame, new: DataFrame, changed_paths: DataFrame) -> DataFrame:
    """Links after a sync: those of changed pages are replaced, ids once."""
    kept = old.join(changed_paths.select(F.col("path").alias("from_path")).distinct(), "from_path", "left_anti")
    return kept.select(*old.columns).unionByName(new.select(*old.columns)).dropDuplicates(["id"])
