"""Vector search by brute force: exact, one scan, with a top-k per page."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import vector as V

#: Queries that are broadcast, or held by a task, at once; and numbers of a product of chunks and queries (32 MB).
MAX_QUERIES = 5000
MAX_PRODUCT = 4_000_000


def vector_search(chunks: DataFrame, query: list[float], limit: int = 10, pages: DataFrame | None = None) -> DataFrame:
    """(path, score, text): pages by their best chunk; of equal scores the least text stays. Unusable vectors score 0.

    ``pages`` (already filtered) restricts the search by a semi join before any vector is looked at.
    """
    c = chunks.where(F.col("embedding").isNotNull())
    if pages is not None:
        c = c.join(pages.select("path"), "path", "left_semi")
    q = F.array(*[F.lit(float(x)) for x in query])
    size = sum(float(x) ** 2 for x in query) ** 0.5
    scored = c.select("path", "text", V.cosine(F.col("embedding"), q, norm_b=F.lit(size)).alias("score"))
    best = scored.groupBy("path").agg(F.max("score").alias("score"), F.max_by("text", F.col("score")).alias("text"))
    return best.orderBy(F.desc("score"), "path").limit(limit)


def batch_vector_search(chunks: DataFrame, queries: DataFrame, k: int = 10, block: int = MAX_QUERIES) -> DataFrame:
    """(query_id, path, score, rank): the same for any number of queries (query_id, vector).

    Up to ``block`` queries are broadcast as a matrix. More are split into blocks that never pass the driver: every block meets
    every chunk in a shuffle, where a task holds one block and streams the chunks by. Each Arrow batch of chunks is one
    product with a block, pooled per page, of which the k best of each query (and their ties) leave the task: a page's
    best chunk is among them wherever it lies. Unusable vectors score 0.
    """
    n, dim = queries.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    dim = max(dim or 0, 0)
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    qtype = "bigint" if kind(queries, "query_id") in ("bigint", "int") else "string"
    asked = queries.select(F.col("query_id").cast(qtype).alias("query_id"), "vector")
    usable = chunks.where("embedding is not null and path is not null").select("path", "embedding")
    out = f"query_id {qtype}, path {kind(chunks, 'path')}, score double"

    def unit(rows: list) -> np.ndarray:
        x = np.array([r if r is not None and len(r) == dim and None not in r else [0.0] * dim for r in rows], float).reshape(len(rows), dim)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        good = np.isfinite(n) & (n > 0)
        return np.where(good, x / np.where(good, n, 1), 0.0)

    def best_of(paths: pa.Array, vectors: pa.Array, ids: pa.Array, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = max(1, MAX_PRODUCT // max(1, len(ids)))
        for at in range(0, len(paths) if len(ids) else 0, rows):
            sims = unit(vectors.slice(at, rows).to_pylist()) @ q
            coded = paths.slice(at, rows).dictionary_encode()
            group = coded.indices.to_numpy(zero_copy_only=False)
            by = np.argsort(group, kind="stable")
            start = np.flatnonzero(np.concatenate([[True], np.diff(group[by]) > 0]))
            pooled = np.maximum.reduceat(sims[by], start, axis=0)
            kth = np.partition(pooled, max(0, len(pooled) - k), axis=0)[max(0, len(pooled) - k)]
            page, query = np.nonzero(pooled >= kth)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(query)), coded.dictionary.take(pa.array(group[by][start][page])), pa.array(pooled[page, query])], names=["query_id", "path", "score"])

    if n <= block:
        held = asked.collect()
        ids = pa.array([r[0] for r in held], pa.int64() if qtype == "bigint" else pa.string())
        shared = chunks.sparkSession.sparkContext.broadcast((ids, unit([r[1] for r in held]).T))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from best_of(b.column(0), b.column(1), *shared.value)

        found = usable.mapInArrow(run, out)
    else:

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, ids, vectors, q = None, [], [], None
            for b in batches:
                at = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in range(3)], axis=1)
                cuts = [0, *(np.flatnonzero((np.diff(at, axis=0) != 0).any(axis=1)) + 1).tolist(), len(at)] if len(at) else [0]
                for s, e in zip(cuts, cuts[1:], strict=False):
                    part, own = b.slice(s, e - s), tuple(at[s, :2])
                    if at[s, 2] == 0:  # the queries of a block come before its chunks
                        if own != key:
                            key, ids, vectors = own, [], []
                        ids.append(part.column(3))
                        vectors += part.column(5).to_pylist()
                        q = None
                    elif own == key:
                        if q is None:
                            ids, q = [pa.concat_arrays(ids)], unit(vectors).T
                            vectors = []
                        yield from best_of(part.column(4), part.column(5), ids[0], q)

        blocks = -(-n // block)
        tasks = max(blocks, int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        slices = -(-tasks // blocks)
        # dealt out in turn, so blocks and slices are of one size whatever the paths
        left = asked.repartition(blocks).select(F.spark_partition_id().alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_c"), F.lit(0).alias("_k"), "query_id", F.lit(None).cast(kind(chunks, "path")).alias("path"), "vector")
        right = usable.withColumn("_c", F.pmod(F.monotonically_increasing_id(), F.lit(slices)).cast("int"))
        right = right.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"), "_c", F.lit(1).alias("_k"), F.lit(None).cast(qtype).alias("query_id"), "path", F.col("embedding").alias("vector"))
        found = left.unionByName(right).repartition(tasks, "_b", "_c").sortWithinPartitions("_b", "_c", "_k").mapInArrow(stream, out)
    best = found.groupBy("query_id", "path").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "path"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)
