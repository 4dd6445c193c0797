"""The whole search: three arms, fusion, signals, top-k. Nothing is collected but the query's own vector."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import fusion as X
from corpusloom.operators.graph import graph_search, parse_relation
from corpusloom.operators.keyword import keyword_scores
from corpusloom.operators.semantic import vector_search
from corpusloom.session import cut


#: Patterns of a relation, then words of an intent in the order in which they are looked for.
RELATION_PATTERNS = [r"谁\s*(负责|提到|提及)", r"(.+?)\s*的\s*(负责人|依赖|引用)", r"(?i)\breferences\b", r"提到了"]
INTENT_WORDS = [("person", ["谁", "@", "负责人", "人员"]), ("experience", ["经验", "lesson", "踩坑", "experience"]), ("task", ["issue", "工单", "需求", "bug", "任务"])]
OF, OF_CHARS = r"^.+的.+$", 40


def intent_of(question: str) -> str:
    """relation, person, experience, task or general. An @ asks for a person where a name follows it."""
    q = question.strip()
    if any(re.search(p, q) for p in RELATION_PATTERNS):
        return "relation"
    named = re.search(r"@[a-zA-Z0-9_-]+", q) is not None
    for intent, words in INTENT_WORDS:
        if any(named if w == "@" else w in q.lower() for w in words):
            return intent
    return "relation" if len(q) <= OF_CHARS and re.match(OF, q) else "general"


def arms(pages: DataFrame, query: str, limit: int, chunks: DataFrame | None = None, vector: list[float] | None = None, links: DataFrame | None = None, start: DataFrame | None = None) -> DataFrame:
    """(arm, path, score): the best 3 x limit of each arm that has what it needs."""
    k = 3 * limit
    out = keyword_scores(pages, query).orderBy(F.desc(F.round("score", 9)), "path").limit(k).select(F.lit("keyword").alias("arm"), "path", "score")
    if chunks is not None and vector is not None:
        out = out.unionByName(vector_search(chunks, vector, k, pages).select(F.lit("semantic").alias("arm"), "path", "score"))
    if links is not None and start is not None:
        verb = (parse_relation(query) or (None, None))[1]
        out = out.unionByName(graph_search(pages, links, start, k, verb).select(F.lit("graph").alias("arm"), "path", "score"))
    return out


def hybrid_search(
    pages: DataFrame, query: str, now: str, chunks: DataFrame | None = None, vector: list[float] | None = None, links: DataFrame | None = None, start: DataFrame | None = None, opts: X.Options = X.Options(),
    entities: DataFrame | None = None, mode: str = "balanced",
) -> DataFrame:
    """(path, title, score, evidence, keyword, semantic, graph, title_path, entity, snippet): the best ``opts.limit`` pages.

    ``pages`` comes filtered (``operators.pages.readable``), so filters hold before any top-k. The parts of the score stay as
    columns: they are the explanation.
    """
    if mode == "conservative":
        vector = None
    a = arms(pages, query, opts.limit, chunks, vector, links, start)
    boosts = pages.select("path", X.title_path_boost(F.col("title"), F.col("path"), query).alias("title_path")).where("title_path > 0")
    if entities is not None and links is not None:
        named = X.entity_boost(X.entity_mentions(pages, links, X.asked_entities(entities, query)))
        boosts = boosts.join(named, "path", "full_outer")
    # at most 9 x limit rows from here on, read by every signal: the arms run once
    a = cut(a)
    hits = X.fused(a, boosts, intent_of(query), vector is not None, opts, mode, graph=start is not None)
    if vector is not None:
        cos = a.where("arm = 'semantic'").select("path", F.col("score").alias("cos"))
        hits = X.cosine_rescored(hits.join(cos, "path", "left"), opts.cosine_share).drop("cos")
    hits = cut(hits)
    if links is not None:
        hits = X.cross_source_signal(X.hub_signal(hits, links, few=True), links, few=True)
    hits = X.diversified(hits)
    meta = pages.select("path", "title", "updated_at", T.snippet(F.col("body_text"), query).alias("snippet"))
    hits = X.heated(meta.join(F.broadcast(hits), "path"), now, opts)
    return hits.orderBy(F.desc("score"), "path").limit(opts.limit).drop("updated_at")


def search_key(query: str, brain_id: str | None, opts: X.Options, **filters) -> str:
    """The key of a cached result: the query and every option that it depends on."""
    import hashlib
    import json
    from dataclasses import asdict

    return hashlib.sha256(json.dumps([query.strip(), brain_id, asdict(opts), filters], sort_keys=True, default=str).encode()).hexdigest()


def think(hits: DataFrame) -> DataFrame:
    """(bucket, n, best): how many hits are skills, experiences and notes, and the best of each. The hits themselves stay rows."""
    place = F.struct((-F.round("score", 9)).alias("s"), "path")
    return hits.groupBy(T.bucket(F.col("path")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min(place)["path"].alias("best"))
