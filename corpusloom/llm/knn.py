"""The most similar vectors of every vector.

Method: vectors are routed to shards of a bounded size, each shard is a robust-pruned directed graph (``vamana``), and a
beam search of each shard that a vector is routed to gives its most similar ones.

* Shards are the cells of a two-level spherical k-means fitted on at most SAMPLE_ROWS rows (documented bound, 64 MB). A
  vector is indexed in its nearest cell and searches up to PROBES cells, those whose centre is almost as near.
* Cells are counted. One of over MOST_ROWS rows, because it is dense or because there are CELLS cells at most, is split by a
  k-means of its own, fitted in a task on a bounded sample, and so on until every cell is small: what a task holds doesn't
  grow with the data.
* One shuffle carries the vectors (256 bytes each) to their cells; results of a row's probes meet in a second, small one.
* Copies are vectors of one direction (to four decimals), whatever their lengths. Within a shard they are one node. A
  direction that a large part of all rows share is found first by a count of hashes; only its k + 1 least ids go into the
  index, and the other copies get theirs from a table of at most 1/COPY_SHARE such directions. Ties in similarity fall to
  the lesser id, so nothing is lost by that.

Cases: null vectors, other lengths than DIM, zeros, NaN, infinities and null numbers take no part; a row sent
twice counts once; vectors need not have length one; empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.vamana import NONE, Graph
from corpusloom.session import cut

DIM = 64
K = 10
SHARD_ROWS = 3000
#: Cells of the first level, whose centres are broadcast (16 MB); rows from which a cell is split, into PARTS at most at a time.
CELLS = 65_536
MOST_ROWS = 9000
PARTS, PART_SAMPLE = 256, 100
#: Rows that one task assigns to the parts of a split cell.
SALT_ROWS = 50_000
#: A cell is split so many times at most; equal vectors, which no k-means can split, are one node anyway.
LEVELS = 8
SAMPLE_ROWS = 250_000
SAMPLE_PER_CELL = 200
PROBES = 4
#: A cell is probed if its centre's similarity is within this of the nearest one's.
MARGIN = 0.08
DEGREE, BEAM, SEARCH_BEAM = 20, 40, 20
#: Vectors that at least this share of all rows (and COPY_ROWS rows) hold are kept out of the index but for k + 1 copies.
COPY_SHARE, COPY_ROWS = 1 / 2000, 2000


def usable(column: pa.Array, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors of a list column, and the vectors at length one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    fits = np.flatnonzero(np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float), nan=-1) == dim)
    flat = column.take(pa.array(fits)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # nulls come as NaN
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    good = np.isfinite(norm) & (norm > 0)
    return fits[good], (x[good] / norm[good, None]).astype(np.float32)


def directions(x: np.ndarray) -> np.ndarray:
    """Unit vectors to four decimals: equal for vectors that differ in their length alone."""
    return np.round(x * 1e4).astype(np.int16)


def hashes(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the direction of every unit vector."""
    odd = np.random.default_rng(5).integers(1, 1 << 62, x.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h = (directions(x).astype(np.int64).view(np.uint64) * odd).sum(axis=1, dtype=np.uint64)
    h ^= h >> np.uint64(31)
    return (h * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = np.concatenate([np.argmax(x[s : s + 8192] @ c.T, axis=1) for s in range(0, len(x), 8192)])
        size = np.bincount(at, minlength=k)
        total = np.zeros((k, x.shape[1]))
        np.add.at(total, at, x)
        empty = size == 0
        total[empty] = x[rng.integers(len(x), size=int(empty.sum()))]
        # a cell far over the average gives up half its place to an empty or tiny one
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = (total / np.where(norm == 0, 1, norm)).astype(np.float32)
    return c, np.argmax(x @ c.T, axis=1) if len(x) * k < 5e7 else at


class Cells:
    """Two levels of centres: groups of cells, and the cells of each group."""

    def __init__(self, sample: np.ndarray, cells: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        groups = max(1, round(cells**0.5)) if cells > 256 else 1
        self.top, at = _kmeans(sample, groups, rng) if groups > 1 else (np.zeros((1, sample.shape[1]), np.float32), np.zeros(len(sample), int))
        self.leaf: list[np.ndarray] = []
        for g in range(len(self.top)):
            own = sample[at == g]
            # a dense group gets its share of the cells
            k = max(1, round(cells * len(own) / len(sample)))
            self.leaf.append(_kmeans(own, k, rng)[0] if len(own) else self.top[g : g + 1])
        self.first = np.cumsum([0, *map(len, self.leaf)])

    def nearest(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, probes) cells and similarities of their centres, nearest first; -1 where there are fewer."""
        m = len(x)
        near = np.argsort(-(x @ self.top.T), axis=1)[:, :3] if len(self.top) > 1 else np.zeros((m, 1), int)
        ids = np.full((m, near.shape[1] * probes), NONE, np.int64)
        val = np.full(ids.shape, -2, np.float32)
        for g in np.unique(near):
            r, j = np.nonzero(near == g)
            sims = x[r] @ self.leaf[g].T
            p = min(probes, sims.shape[1])
            top = np.argpartition(-sims, p - 1, axis=1)[:, :p] if p < sims.shape[1] else np.broadcast_to(np.arange(p), (len(r), p))
            for i in range(p):
                ids[r, j * probes + i] = self.first[g] + top[:, i]
                val[r, j * probes + i] = np.take_along_axis(sims, top[:, i : i + 1], 1)[:, 0]
        by = np.argsort(-val, axis=1, kind="stable")[:, :probes]
        return np.take_along_axis(ids, by, 1), np.take_along_axis(val, by, 1)


def search_shard(ids: np.ndarray, x: np.ndarray, member: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, neighbour id, similarity) of one shard. Members are indexed; members and guests are searched for.

    Equal vectors are one node; of a node's members the k + 1 least ids stand for it.
    """
    order = np.argsort(ids, kind="stable")
    ids, x, member = ids[order], x[order], member[order]
    own = np.flatnonzero(member)
    if not len(own):
        return ids[:0], ids[:0], np.empty(0, np.float32)
    same = np.concatenate([[False], ids[own][1:] == ids[own][:-1]])
    own = own[~same]  # a row sent twice
    raw = directions(x[own]).view(np.dtype((np.void, x.shape[1] * 2)))[:, 0]
    _, first, node = np.unique(raw, return_index=True, return_inverse=True)
    by = np.argsort(node, kind="stable")  # members of each node, ids ascending
    size = np.bincount(node)
    start = np.cumsum(size) - size
    g = Graph(x[own[first]], DEGREE, BEAM, note=least)
    guests = np.flatnonzero(~member)
    width = max(SEARCH_BEAM, k + 6)

    def best(rows: np.ndarray, nodes: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """rows: query rows, nodes: what they met. Nodes become their members; then the k best of each row stay."""
        n = np.minimum(size[nodes], k + 1)
        at = np.repeat(start[nodes], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit, q, sim = own[by[at]], np.repeat(rows, n), np.repeat(sims, n)
        other = ids[hit] != ids[q]
        hit, q, sim = hit[other], q[other], sim[other]
        o = np.lexsort((hit, -sim, q))  # row order is id order
        hit, q, sim = hit[o], q[o], sim[o]
        i = np.arange(len(q))
        rank = i - np.maximum.accumulate(np.where(np.concatenate([[True], q[1:] != q[:-1]]), i, 0)) if len(q) else i
        keep = rank < k
        return ids[q[keep]], ids[hit[keep]], sim[keep]

    def flat(rows: np.ndarray, found: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, c = np.nonzero((found != NONE) & (sims >= least))
        return rows[r], found[r, c], sims[r, c]

    nodes = np.arange(len(first), dtype=np.int32)
    met = [g.proposed()]
    for at in range(0, len(nodes), 1024):
        q = nodes[at : at + 1024]
        met.append(flat(q, *g.search(g.x[q], width, start=np.concatenate([q[:, None], g.out[q]], axis=1))))
    a, b, s = (np.concatenate([m[i] for m in met]) for i in range(3))
    _, once = np.unique(a.astype(np.int64) * len(nodes) + b, return_index=True)
    a, b, s = a[once], b[once], s[once]
    # a node asks for all its members
    n = size[a]
    rows = own[by[np.repeat(start[a], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]]
    out = [best(rows, np.repeat(b, n), np.repeat(s, n))]
    for at in range(0, len(guests), 1024):
        q = guests[at : at + 1024]
        out.append(best(*flat(q, *g.search(x[q], width))))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def _sample(vectors: DataFrame, rows: int, want: int) -> np.ndarray:
    """Unit vectors of about ``want`` rows; at most SAMPLE_ROWS come to the driver."""
    part = vectors.sample(min(1.0, 1.3 * want / max(1, rows)), 5).select("embedding") if rows > want else vectors.select("embedding")
    x = usable(part.limit(want).toArrow()["embedding"])[1]
    return np.unique(x, axis=0)


def _vectors(column: pa.Array, dim: int = DIM) -> np.ndarray:
    """The vectors of a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), dim)


def _bytes(x: np.ndarray) -> pa.Array:
    flat = pa.py_buffer(np.ascontiguousarray(x))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1] * 4), len(x), [None, flat]).cast(pa.binary())


ROUTED = "cell long, id string, v binary, member boolean"


def _split(routed: DataFrame, crowded: DataFrame) -> DataFrame:
    """The rows of the ``crowded`` cells (cell, n) in new cells, each cell split into n / SHARD_ROWS parts, at most PARTS."""
    margin, probes = MARGIN, PROBES
    parts = F.least(F.lit(PARTS), F.ceil(F.col("n") / SHARD_ROWS)).cast("int")
    plan = crowded.select("cell", "n", parts.alias("parts"), F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts"))
    rows = routed.join(plan, "cell")

    def fit(table: pa.Table) -> pa.Table:
        x = np.unique(_vectors(table["v"].combine_chunks()), axis=0)
        k = table["parts"][0].as_py()
        c = _kmeans(x[:: max(1, len(x) // (2 * PART_SAMPLE * k))], k, np.random.default_rng(13))[0]
        return pa.table({"cell": table["cell"].slice(0, 1), "centres": pa.array([c.tobytes()], pa.binary())})

    some = rows.where(F.col("member") & (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_000)) < F.col("parts") * PART_SAMPLE * 1_000_000 / F.col("n")))
    centres = cut(some.select("cell", "parts", "v").groupBy("cell").applyInArrow(fit, "cell long, centres binary"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).select("cell", "salt", "id", "v", "member")
    spread = centres.join(plan, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "centres")

    def assign(table: pa.Table, its: pa.Table) -> pa.Table:
        if not table.num_rows or not its.num_rows:
            return pa.table({"cell": pa.array([], pa.int64()), "id": pa.array([], pa.string()), "v": pa.array([], pa.binary()), "member": pa.array([], pa.bool_())})
        x, c = _vectors(table["v"].combine_chunks()), np.frombuffer(its["centres"][0].as_py(), np.float32).reshape(-1, DIM)
        member = table["member"].to_numpy(zero_copy_only=False)
        sims = x @ c.T
        near = np.argsort(-sims, axis=1, kind="stable")[:, :probes]
        val = np.take_along_axis(sims, near, 1)
        # a member is a guest of the other parts, a guest of two parts at most
        r, j = np.nonzero((val >= val[:, :1] - margin) & (member[:, None] | (np.arange(near.shape[1]) < 2)))
        of = np.uint64(table["cell"][0].as_py() & 0xFFFFFFFFFFFFFFFF) * np.uint64(0x9E3779B97F4A7C15)
        new = ((of ^ (near[r, j].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1 << 63)).view(np.int64)
        return pa.table({"cell": pa.array(new), "id": table["id"].combine_chunks().take(pa.array(r)), "v": _bytes(x[r]), "member": pa.array(member[r] & (j == 0))})

    return salted.groupBy("cell", "salt").cogroup(spread.groupBy("cell", "salt")).applyInArrow(assign, ROUTED)


def neighbours(chunks: DataFrame, k: int = K, least: float = -1.0, id_col: str = "id") -> DataFrame:
    """(id, neighbour, similarity): the k vectors most similar to every vector, those below ``least`` left out."""
    spark = chunks.sparkSession
    chunks = chunks.select(F.col(id_col).alias("id"), "embedding").where("id is not null and embedding is not null")
    out = "id string, neighbour string, similarity float"
    rows = chunks.count()
    if not rows:
        return spark.createDataFrame([], out)
    cells = max(1, min(CELLS, -(-rows // SHARD_ROWS)))
    sample = _sample(chunks, rows, min(SAMPLE_ROWS, SAMPLE_PER_CELL * cells))
    if not len(sample):
        return spark.createDataFrame([], out)
    shared = spark.sparkContext.broadcast(Cells(sample, cells))  # at most CELLS + 256 centres of 256 bytes
    probes, margin = PROBES, MARGIN

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = usable(batch.column(0))[1]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.nearest(x, 1)[0][:, 0]), pa.array(hashes(x))], names=["cell", "h"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = usable(batch.column(1))
            h = hashes(x)
            its = np.isin(h, common)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[its])), pa.array(h[its])], names=["id", "h"])

    # how many rows go where, and which directions many rows share
    counts = cut(chunks.select("embedding").mapInArrow(place, "cell long, h long").groupBy("cell", "h").agg(F.count(F.lit(1)).alias("n")))
    floor = max(COPY_ROWS, int(rows * COPY_SHARE))
    common = counts.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > floor).select("h").limit(int(1 / COPY_SHARE)).collect()
    common = np.array(sorted(r[0] for r in common), np.int64)
    kept = counts.where(~F.col("h").isin(common.tolist())) if len(common) else counts
    crowded = cut(kept.groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > MOST_ROWS))

    heads: dict[int, set] = {}
    extra = None
    if len(common):
        held = cut(chunks.mapInArrow(hashed, "id string, h long").dropDuplicates(["id"]))
        # the k + 1 least ids of each such direction, by way of 1024 salts, so that no task sorts them all
        by = Window.partitionBy("h", F.pmod(F.xxhash64("id"), F.lit(1024))).orderBy("id")
        some = held.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1)
        some = some.withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("id"))).where(F.col("r") <= k + 1)
        firsts = cut(some.groupBy("h").agg(F.sort_array(F.collect_list("id")).alias("heads")))
        heads = {r["h"]: set(r["heads"]) for r in firsts.collect()}  # at most k + 1 ids of 1/COPY_SHARE directions
        extra = held.join(F.broadcast(firsts), "h").where(~F.array_contains("heads", F.col("id")))
        extra = extra.select("id", F.explode(F.slice("heads", 1, k)).alias("neighbour"), F.lit(1.0).cast("float").alias("similarity"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = usable(batch.column(1))
            if len(common) and len(at):
                h = hashes(x)
                stays = ~np.isin(h, common)
                for i in np.flatnonzero(~stays).tolist():
                    stays[i] = batch.column(0)[int(at[i])].as_py() in heads[int(h[i])]
                at, x = at[stays], x[stays]
            if not len(at):
                continue
            ids, sims = shared.value.nearest(x, probes)
            ok = (ids != NONE) & (sims >= sims[:, :1] - margin)
            r, j = np.nonzero(ok)
            yield pa.RecordBatch.from_arrays([pa.array(ids[r, j]), batch.column(0).take(pa.array(at[r])), _bytes(x[r]), pa.array(j == 0)], names=["cell", "id", "v", "member"])

    def shard(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids = np.array(table["id"].to_pylist(), dtype=object)
        a, b, s = search_shard(ids, _vectors(table["v"].combine_chunks()), table["member"].to_numpy(zero_copy_only=False), k, least)
        return pa.table({"id": pa.array(a, pa.string()), "neighbour": pa.array(b, pa.string()), "similarity": pa.array(s, pa.float32())})

    routed = chunks.mapInArrow(route, ROUTED)
    for _ in range(LEVELS):
        if crowded.isEmpty():
            break
        routed = cut(routed) if _ == 0 else routed
        parts = cut(_split(routed, crowded))
        routed = routed.join(crowded.select("cell"), "cell", "left_anti").unionByName(parts)
        crowded = cut(parts.where("member").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_ROWS))
    # a cell or so a task, whatever the size of the data
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // SHARD_ROWS))
    found = routed.repartition(tasks, "cell").groupBy("cell").applyInArrow(shard, out)
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    found = found.dropDuplicates(["id", "neighbour"]).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")
    return found if extra is None else found.unionByName(extra)


def near_pairs(chunks: DataFrame, k: int = K, least: float = 0.90) -> DataFrame:
    """(id_a, id_b), id_a < id_b: one of the two is among the k most similar of the other, and their cosine is at least ``least``.

    The float32 product stands for the cosine; pairs within 1e-6 below ``least`` count.
    """
    n = neighbours(chunks, k, least - 1e-6)
    return n.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
