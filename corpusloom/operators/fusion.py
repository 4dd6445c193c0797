"""Fusion of ranked lists and the signals that reorder the result. All of it is column work over a few dozen rows a query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.vector import let
from corpusloom.operators.skew import hot_keys, salted_join

RRF_K = 60
#: Weights of keyword, semantic, graph, title and path, entity, by intent; without vectors, and without a graph.
WEIGHTS = {
    "general": (0.35, 0.20, 0.20, 0.10, 0.15),
    "task": (0.35, 0.20, 0.20, 0.10, 0.15),
    "relation": (0.20, 0.15, 0.45, 0.10, 0.10),
    "person": (0.25, 0.15, 0.15, 0.10, 0.35),
    "experience": (0.30, 0.25, 0.15, 0.15, 0.15),
}
NO_VECTORS = (0.55, 0.0, 0.30, 0.10, 0.05)
NO_VECTORS_RELATION = (0.30, 0.0, 0.55, 0.10, 0.05)
CONSERVATIVE = (0.75, 0.0, 0.15, 0.05, 0.05)
NO_GRAPH = (0.45, 0.45, 0.0, 0.10, 0.0)
NO_GRAPH_CONSERVATIVE = (0.90, 0.0, 0.0, 0.10, 0.0)
EXPERIENCE_BONUS = 0.3
TIE = 0.002


@dataclass(frozen=True)
class Options:
    rescale: bool = True
    per_arm_min: float = 0.7
    fused_min: float = 0.05
    cosine_share: float = 0.3
    half_life_days: float = 30.0
    heat: float = 0.15
    limit: int = 10


def rrf(arms: DataFrame, k: int = RRF_K) -> DataFrame:
    """(arm, path, rank, rrf) from (arm, path, score): 1 / (k + rank), the best place of a path in an arm."""
    rank = F.row_number().over(Window.partitionBy("arm").orderBy(F.desc(F.round("score", 9)), "path"))
    return arms.withColumn("rank", rank).groupBy("arm", "path").agg(F.min("rank").alias("rank")).withColumn("rrf", 1.0 / (k + F.col("rank")))


def scaled(rrf_: Column, opts: Options, k: int = RRF_K) -> Column:
    """The first place becomes 1; what falls below per_arm_min counts nothing."""
    s = rrf_ * (k + 1) if opts.rescale else rrf_
    return F.when(s >= opts.per_arm_min, s).otherwise(0.0)


def weights_of(intent: str = "general", semantic: bool = True, mode: str = "balanced", graph: bool = True) -> tuple[float, float, float, float, float]:
    """What each part of a score weighs. ``semantic``: there are hits by vectors; ``graph``: the graph was asked."""
    semantic = semantic and mode != "conservative"
    if not graph:
        return NO_GRAPH if semantic else NO_GRAPH_CONSERVATIVE
    if mode == "conservative":
        return CONSERVATIVE
    if not semantic:
        return NO_VECTORS_RELATION if intent == "relation" else NO_VECTORS
    return WEIGHTS[intent]


def fused(arms: DataFrame, boosts: DataFrame | None = None, intent: str = "general", semantic: bool = True, opts: Options = Options(), mode: str = "balanced", graph: bool = True) -> DataFrame:
    """(path, keyword, semantic, graph, title_path, entity, score, evidence) from arms (arm, path, score).

    boosts: (path, title_path, entity), either of the two may be missing. ``evidence`` names the parts that count. An
    experience page counts as an entity by EXPERIENCE_BONUS more where experience is asked for.
    """
    r = rrf(arms).withColumn("s", scaled(F.col("rrf"), opts))
    one = lambda a: F.coalesce(F.max(F.when(F.col("arm") == a, F.col("s"))), F.lit(0.0)).alias(a)
    wide = r.groupBy("path").agg(one("keyword"), one("semantic"), one("graph"))
    if mode == "conservative":
        wide = wide.withColumn("semantic", F.lit(0.0))
    if boosts is not None:
        wide = wide.join(boosts, "path", "left")
    for c in ("title_path", "entity"):
        wide = wide.withColumn(c, F.coalesce(F.col(c) if boosts is not None and c in boosts.columns else F.lit(0.0), F.lit(0.0)))
    if intent == "experience":
        wide = wide.withColumn("entity", F.when(F.col("path").contains("/experiences/"), F.least(F.lit(1.0), F.col("entity") + EXPERIENCE_BONUS)).otherwise(F.col("entity")))
    parts = ("keyword", "semantic", "graph", "title_path", "entity")
    score = sum((w * F.col(c) for w, c in zip(weights_of(intent, semantic, mode, graph), parts, strict=True)), F.lit(0.0))
    named = {"keyword": F.col("keyword") > 0, "semantic": F.col("semantic") > 0, "graph": F.col("graph") > 0, "entity": F.col("entity") > 0, "title": F.col("title_path") >= 0.7, "path": (F.col("title_path") > 0) & (F.col("title_path") < 0.7)}
    evidence = F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()])))
    return wide.withColumn("score", score).withColumn("evidence", evidence).where(F.col("score") >= opts.fused_min)


def title_path_boost(title: Column, path: Column, query: str) -> Column:
    """.7 if the title holds the query, .3 if the path does."""
    q = F.lit(query.strip().lower())
    return F.least(F.lit(1.0), F.when(F.contains(F.lower(F.coalesce(title, F.lit(""))), q), 0.7).otherwise(0.0) + F.when(F.contains(F.lower(path), q), 0.3).otherwise(0.0))


def asked_entities(entities: DataFrame, query: str, most: int = 20) -> DataFrame:
    """(brain_id, slug, title): the first ``most`` records, merged ones aside, whose slug, title or aliases hold the query."""
    q = F.lit(query.strip().lower())
    has = F.lit(False)
    for c in ("slug", "title", "aliases_json"):
        has = has | F.contains(F.lower(F.coalesce(c, F.lit(""))), q)
    e = entities.where(F.coalesce(F.col("status"), F.lit("")) != "merged").where(has & (q != ""))
    return e.select("brain_id", F.coalesce(F.when(F.col("canonical_slug") != "", F.col("canonical_slug")), "slug").alias("slug"), "title").orderBy("brain_id", "slug", "title").limit(most)


def entity_mentions(pages: DataFrame, links: DataFrame, asked: DataFrame, most: int = 50) -> DataFrame:
    """(path, kind) for ``entity_boost``: pages of the brain that link to an entity, its own page, and the first ``most`` that name it."""
    a = F.broadcast(asked.select("brain_id", F.lower("slug").alias("_slug"), F.lower(F.coalesce("title", "slug")).alias("_title"), F.col("slug").alias("_as")))
    linked = links.where("from_path is not null").select("brain_id", F.lower("to_ref").alias("_slug"), F.col("from_path").alias("path")).join(a, ["brain_id", "_slug"]).select("path", "_slug", "_title").distinct()
    own = asked.select(F.concat(F.lit("brains/"), "brain_id", F.lit("/entities/"), "slug", F.lit(".md")).alias("path"))
    text = F.lower(F.concat_ws("\n", "title", "body_text"))
    named = pages.select("brain_id", "path", text.alias("_text")).join(a, "brain_id").where(F.contains("_text", F.col("_slug")) | F.contains("_text", F.col("_title")))
    rank = F.row_number().over(Window.partitionBy("brain_id", "_slug", "_title").orderBy("path"))
    named = named.select("path", "brain_id", "_slug", "_title").withColumn("_r", rank).where(F.col("_r") <= most)
    kind = lambda df, k: df.select("path", F.lit(k).alias("kind"))
    return kind(linked, "link").unionByName(kind(own, "entity")).unionByName(kind(named, "mention"))


def entity_boost(mentions: DataFrame) -> DataFrame:
    """(path, entity) from (path, kind): .5 per linking page, .8 for the entity's own page, .45 for a mention, at most 1."""
    part = F.when(F.col("kind") == "link", 0.5).when(F.col("kind") == "entity", 0.8).otherwise(0.45)
    return mentions.groupBy("path").agg(F.least(F.lit(1.0), F.sum(part)).alias("entity"))


def cosine_rescored(hits: DataFrame, share: float = 0.3) -> DataFrame:
    """score becomes (1 - share) score + share max(0, cos); a hit without a cosine counts 0."""
    return hits.withColumn("score", (1 - share) * F.col("score") + share * F.greatest(F.lit(0.0), F.coalesce("cos", F.lit(0.0))))


def hub_signal(hits: DataFrame, links: DataFrame, few: bool = False) -> DataFrame:
    """score x 1.05 for hits that two or more links among the hits touch. ``few``: the hits are a top-k and may be broadcast."""
    pairs = links.select("from_path", "to_ref")
    if few:
        p = F.broadcast(hits.select("path"))
        inside = pairs.join(p.withColumnRenamed("path", "from_path"), "from_path", "left_semi").join(p.withColumnRenamed("path", "to_ref"), "to_ref", "left_semi").withColumn("n", F.lit(1))
    else:
        # equal links are counted first, so the other end spreads what is left of a hub
        inside = pairs.groupBy("from_path", "to_ref").agg(F.count(F.lit(1)).alias("n"))
        for end, other in (("from_path", "to_ref"), ("to_ref", "from_path")):
            hot = hot_keys(pairs.groupBy(end).agg(F.count(F.lit(1)).alias("n")), end, "n")
            inside = salted_join(inside, hits.select(F.col("path").alias(end)), end, F.col(other), hot, "left_semi")
    d = inside.select(F.explode(F.array("from_path", "to_ref")).alias("path"), "n").groupBy("path").agg(F.sum("n").alias("_d"))
    return hits.join(d, "path", "left").withColumn("score", F.col("score") * F.when(F.col("_d") >= 2, 1.05).otherwise(1.0)).drop("_d")


def cross_source_signal(hits: DataFrame, links: DataFrame, few: bool = False) -> DataFrame:
    """score x 1.10 for hits that links of two kinds, or from two sources, lead to. ``few``: the hits are a top-k and may be broadcast."""
    named = hits.select("path", F.explode(F.array("path", T.basename(F.col("path")))).alias("to_ref"))
    # two kinds differ in their least and greatest: one row for each target, however many links
    ends = lambda *cs: [f(c).alias(f"{n}{c}") for c in cs for f, n in ((F.min, "_lo"), (F.max, "_hi"))]
    into = links.select("to_ref", "source", T.source_prefix(F.col("from_path")).alias("prefix"))
    if few:
        into = into.join(F.broadcast(named), "to_ref").groupBy("path").agg(*ends("source", "prefix"))
    else:
        into = into.groupBy("to_ref").agg(*ends("source", "prefix"))
        hot = hot_keys(named.groupBy("to_ref").agg(F.count(F.lit(1)).alias("n")), "to_ref", "n")
        met = salted_join(named, into, "to_ref", F.col("path"), hot)
        into = met.groupBy("path").agg(*[f(c).alias(c) for c in ("_losource", "_loprefix", "_hisource", "_hiprefix") for f in [F.min if c.startswith("_lo") else F.max]])
    two = (F.col("_losource") != F.col("_hisource")) | (F.col("_loprefix") != F.col("_hiprefix"))
    return hits.join(into.select("path", two.alias("_two")), "path", "left").withColumn("score", F.col("score") * F.when(F.col("_two"), 1.10).otherwise(1.0)).drop("_two")


def diversified(hits: DataFrame) -> DataFrame:
    """score x 0.95 for all but the best hit of each source."""
    w = Window.partitionBy(T.source_prefix(F.col("path"))).orderBy(F.desc("score"), "path")
    return hits.withColumn("score", F.col("score") * F.when(F.row_number().over(w) > 1, 0.95).otherwise(1.0))


def hotness(age_days: Column, half_life: float = 30.0) -> Column:
    """1 now, half after ``half_life`` days; .5 if the age isn't known."""
    return F.when(age_days.isNull(), 0.5).otherwise(F.exp(-F.log(F.lit(2.0)) * F.greatest(F.lit(0.0), age_days) / half_life))


def heated(hits: DataFrame, now: str, opts: Options = Options()) -> DataFrame:
    """score x (1 + heat x hotness) by updated_at; ``now`` is given, so a result can be repeated."""
    # between times without zone, so no session setting changes it
    age = F.timestamp_diff("MICROSECOND", F.col("updated_at").cast("timestamp_ntz"), F.lit(now).cast("timestamp_ntz")) / 86_400e6
    return hits.withColumn("score", F.col("score") * (1 + opts.heat * hotness(age, opts.half_life_days)))


def directories_first(hits: DataFrame) -> DataFrame:
    """(…, dir, dir_score, dir_rank, place): hits by the summed score of their folder, then by score. Nothing is dropped."""
    h = hits.withColumn("dir", T.parent_dir(F.col("path")))
    h = h.join(h.groupBy("dir").agg(F.sum("score").alias("dir_score")), "dir")
    h = h.withColumn("dir_rank", F.dense_rank().over(Window.orderBy(F.desc("dir_score"), "dir")))
    return h.withColumn("place", F.row_number().over(Window.orderBy("dir_rank", F.desc("score"), "path")))


def local_rerank(snippet: Column, title: Column, query: str) -> Column:
    """3 for the phrase in title and snippet, 2 for it in the title, .5 for each bigram of the query in title and snippet."""
    q = query.strip().lower()
    if not q:
        return F.lit(0.0)
    head = F.lower(F.coalesce(title, F.lit("")))
    t = F.concat(head, F.lit(" "), F.lower(F.coalesce(snippet, F.lit(""))))
    flat = "".join(q.split())
    grams = [flat[i : i + 2] for i in range(max(1, len(flat) - 1))]
    return sum((F.when(t.contains(g), 0.5).otherwise(0.0) for g in grams), F.when(t.contains(q), 3.0).otherwise(0.0) + F.when(head.contains(q), 2.0).otherwise(0.0))


def layer_tie_order(hits: DataFrame) -> DataFrame:
    """``hits`` with ``place``: by score, but the layer decides between two less than TIE apart.

    That comparison isn't transitive, so the order is defined by insertion: from (score, path) order, each hit moves up past
    those it goes before, until one that it doesn't. ``hits`` is a search's top-k: its rows are one array.
    """
    row = F.struct("score", T.layer_key(F.col("path")).alias("layer"), "path")

    def stays(a: Column, b: Column) -> Column:
        """Whether ``a``, which came later, stays behind ``b``."""
        d = b["score"] - a["score"]
        behind = (d > 0) | ((d == 0) & (a["path"] >= b["path"]))
        return F.when((F.abs(d) < TIE) & (a["layer"] != b["layer"]), a["layer"] > b["layer"]).otherwise(behind)

    def insert(placed: Column, x: Column) -> Column:
        at = F.array_max(F.transform(placed, lambda y, i: F.when(stays(x, y), i + 1).otherwise(0)))
        return let(F.coalesce(at, F.lit(0)), lambda n: F.concat(F.slice(placed, F.lit(1), n), F.array(x), F.slice(placed, n + 1, F.greatest(F.size(placed) - n, F.lit(0)))))

    kind = "array<struct<score:double,layer:int,path:string>>"
    first = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("_s"), F.col("path").alias("_p"), row.alias("r")))), lambda x: x["r"])
    rows = hits.agg(first.cast(kind).alias("rows")).select(F.aggregate("rows", F.array().cast(kind), insert).alias("rows"))
    placed = rows.select(F.posexplode("rows").alias("_i", "r")).select(F.col("r.path").alias("path"), (F.col("_i") + 1).alias("place"))
    return hits.join(placed, "path")
