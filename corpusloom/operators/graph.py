"""Search over the link graph: what a question asks for, where to start, and pages within two steps."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

SEEDS, TITLE_SEEDS, DEPTH = 8, 20, 2
#: Questions that name a relation, in order: the pattern, the group with the seed, and the type of link.
RELATIONS = [
    (r"^谁提到了\s*(.+)$", 1, "mentions"),
    (r"^谁\s*(?:负责|提到|提及)\s*(.+)$", 1, "works_on"),
    (r"^(.+?)\s*的\s*(负责人|依赖|引用)$", 1, None),
    (r"(?i)^(.+?)\s+references$", 1, "references"),
    (r"^(.+?)\s*提到了?\s*(.+)$", 2, "mentions"),
    (r"^提到了?\s*(.+)$", 1, "mentions"),
    (r"(?i)^who\s+works\s+at\s+(.+)$", 1, "works_at"),
    (r"(?i)^who\s+founded\s+(.+)$", 1, "founded"),
]
#: The type of link behind a noun, where the pattern names none.
NOUNS = {"负责人": "works_on", "依赖": "references", "引用": "references"}
STOP_WORDS = ["the", "a", "an", "of", "and", "or", "is", "的", "了", "和", "与", "谁", "什么", "如何"]
SEED_CHARS = 64


def parse_relation(question: str) -> tuple[str, str | None] | None:
    """(seed, type of link) of a question that names a relation; a seed must say something and have SEED_CHARS at most."""
    text = question.strip()
    for pattern, group, verb in RELATIONS:
        m = re.match(pattern, text)
        seed = m[group].strip() if m else ""
        if seed and len(seed) <= SEED_CHARS and seed.lower() not in STOP_WORDS and re.search(r"[^\W_]", seed):
            return seed, verb or NOUNS.get(m[m.lastindex])
    return None


def needle_in(query: Column, needle: Column) -> Column:
    """Whether a name occurs in a question: one with Han characters, of two or more, anywhere; another one, of three ASCII letters or
    digits or more, as a word. Stop words are no names."""
    n, q = F.lower(F.trim(needle)), F.lower(query)
    # words are compared as words: an equality, not a pattern built from data
    whole = n.rlike("^[a-z0-9]{3,}$") & F.array_contains(F.split(q, "[^a-z0-9_]+"), n)
    return F.coalesce(~n.isin(STOP_WORDS) & F.when(n.rlike(r"\p{IsHan}"), (F.length(n) >= 2) & F.contains(q, n)).otherwise(whole), F.lit(False))


def edges_of(links: DataFrame) -> DataFrame:
    """(a, b, type): every link in both directions."""
    e = links.where("from_path is not null and to_ref is not null").select("from_path", "to_ref", "type")
    return e.select(F.col("from_path").alias("a"), F.col("to_ref").alias("b"), "type").unionByName(e.select(F.col("to_ref").alias("a"), F.col("from_path").alias("b"), "type"))


def seeds(entities: DataFrame, links: DataFrame, query: str) -> DataFrame:
    """(ref): at most SEEDS of the slugs of active entities whose slug, title or alias occurs in the query, and of the link targets
    that do, in order."""
    q = F.lit(query)
    names = F.concat(F.array("slug", "title"), F.coalesce(F.from_json("aliases_json", "array<string>"), F.array().cast("array<string>")))
    named = entities.where("lower(trim(status)) = 'active'").where(F.exists(names, lambda n: needle_in(q, n))).select(F.col("slug").alias("ref"))
    linked = links.where(F.col("to_ref").isNotNull()).select(F.col("to_ref").alias("ref")).distinct().where(needle_in(q, F.col("ref")))
    return named.unionByName(linked).distinct().orderBy("ref").limit(SEEDS)


def is_page(ref: Column) -> Column:
    return F.contains(ref, F.lit("/")) | F.endswith(ref, F.lit(".md"))


def start_of(entities: DataFrame, links: DataFrame, query: str) -> DataFrame:
    """(ref): the seed of a question that names a relation, else the names that occur in it."""
    relation = parse_relation(query)
    return entities.sparkSession.createDataFrame([(relation[0],)], "ref string") if relation else seeds(entities, links, query)


def frontier(pages: DataFrame, links: DataFrame, start: DataFrame) -> DataFrame:
    """(ref): pages at the ends of links that name a seed in either end, and the TITLE_SEEDS first pages whose title or path names it.

    ``start`` has SEEDS rows at most, so it is held against every row in place.
    """
    s = F.broadcast(start.select(F.lower("ref").alias("_s")))
    holds = lambda c: F.contains(F.lower(c), F.col("_s"))
    ends = links.where("from_path is not null and to_ref is not null").select("from_path", "to_ref").join(s, holds(F.col("to_ref")) | holds(F.col("from_path")))
    ends = ends.select(F.explode(F.array("from_path", F.when(F.contains("to_ref", F.lit("/")), F.col("to_ref")))).alias("ref")).where("ref is not null")
    titled = pages.select("path", "title").join(s, holds(F.coalesce("title", F.lit(""))) | holds(F.col("path")))
    first = F.row_number().over(Window.partitionBy("_s").orderBy("path"))
    return ends.unionByName(titled.withColumn("_r", first).where(F.col("_r") <= TITLE_SEEDS).select(F.col("path").alias("ref"))).distinct()


def within(links: DataFrame, start: DataFrame, depth: int = DEPTH, verb: str | None = None, pages_only: bool = False) -> DataFrame:
    """(node, depth): nodes at most ``depth`` steps from ``start`` (ref), with the fewest steps. Steps are joins, no point
    queries; a verb restricts every step; ``pages_only`` leaves out nodes that are no paths."""
    e = edges_of(links if not verb else links.where(F.col("type") == verb))
    if pages_only:
        e = e.where(is_page(F.col("b")))
    seen = start.select(F.col("ref").alias("node"), F.lit(0).alias("depth"))
    front = seen
    for d in range(1, depth + 1):
        front = front.select(F.col("node").alias("a")).join(e, "a").select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(front)
    return seen


def graph_search(pages: DataFrame, links: DataFrame, start: DataFrame, limit: int = 10, verb: str | None = None) -> DataFrame:
    """(path, depth, score): readable pages at most two steps from the pages that name a seed; score 1 / rank, by depth and path."""
    near = within(links, frontier(pages, links, start), verb=verb, pages_only=True)
    hits = pages.select("path").join(near.withColumnRenamed("node", "path"), "path").orderBy("depth", "path").limit(limit)
    return hits.withColumn("score", 1.0 / F.row_number().over(Window.orderBy("depth", "path")))


def degree_table(links: DataFrame) -> DataFrame:
    """(node, in_links, out_links, sources): degrees of every end of a link, counted before the shuffle."""
    i = links.where("to_ref is not null").groupBy(F.col("to_ref").alias("node")).agg(F.count(F.lit(1)).alias("in_links"), F.lit(0).cast("long").alias("out_links"), F.collect_set("source").alias("kinds"))
    o = links.where("from_path is not null").groupBy(F.col("from_path").alias("node")).agg(F.lit(0).cast("long").alias("in_links"), F.count(F.lit(1)).alias("out_links"), F.array().cast("array<string>").alias("kinds"))
    return i.unionByName(o).groupBy("node").agg(F.sum("in_links").alias("in_links"), F.sum("out_links").alias("out_links"), F.max(F.size("kinds")).alias("source_kinds"))


def is_temporary(front: Column) -> Column:
    """A front matter (JSON) that says so itself, by a flag or a tag."""
    flag = F.lit(False)
    for f in ("temporary", "ephemeral"):
        flag = flag | (F.get_json_object(front, f"$.{f}") == "true")
    tags = F.from_json(F.get_json_object(front, "$.tags"), "array<string>")
    return F.coalesce(flag, F.lit(False)) | F.coalesce(F.exists(tags, lambda t: F.lower(t).isin("temporary", "tmp", "ephemeral")), F.lit(False))


def orphan_notes(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(path, temporary): pages that no link of their brain leads to, by path or by file name, and that link nowhere. Upkeep archives
    the temporary ones."""
    to = links.where("to_ref is not null and brain_id is not null").select("brain_id", "to_ref").distinct()
    by_name = to.where(F.contains("to_ref", F.lit("/"))).select("brain_id", F.substring_index("to_ref", "/", -1).alias("name")).distinct()
    out = links.where("from_path is not null").select(F.col("from_path").alias("path")).distinct()
    alone = pages.select("path", "brain_id", is_temporary(F.col("frontmatter_json")).alias("temporary")).join(out, "path", "left_anti").join(to.withColumnRenamed("to_ref", "path"), ["brain_id", "path"], "left_anti")
    return alone.withColumn("name", F.substring_index("path", "/", -1)).join(by_name, ["brain_id", "name"], "left_anti").select("path", "temporary")
