"""Keyword search: weighted rank over an inverted index, with boosts for substrings of title, path and aliases."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.vector import let

#: Fixed values of the ranking: weights of the parts, and of a word at label D.
WEIGHTS = {"title": 3.0, "body": 1.0, "title_ngrams": 2.0, "body_ngrams": 0.8, "in_title": 2.5, "in_path": 1.5, "in_aliases": 3.0}
LABEL_D = 0.1
ZETA_2 = 1.64493406685
RRF_K = 60


def best_first(score: str) -> Column:
    """Descending order in which scores that differ by rounding only are ties, which the path then decides."""
    return F.desc(F.round(score, 9))


def query_words(query: str) -> list[str]:
    return list(dict.fromkeys(w for w in re.split(r"[\W_]+", query.lower()) if w))


def query_bigrams(query: str) -> list[str]:
    t = "".join(query.lower().split())
    return list(dict.fromkeys(t[i : i + 2] for i in range(max(1, len(t) - 1)))) if t else []


def _positions(words: Column, word: str) -> Column:
    return F.filter(F.transform(words, lambda w, i: F.when(w == word, i + 1)), lambda p: p.isNotNull())


def word_rank(words: Column, terms: list[str]) -> Column:
    """Rank of an array of words for terms that are all asked for.

    One term: the sum of w / j^2 over its occurrences, scaled. Several: 1 - product of (1 - closeness) over all pairs of
    occurrences of different terms. 0 if no term (or for several terms, no pair) occurs.
    """
    if not terms:
        return F.lit(0.0)
    # the words are split once and the places of each term found once
    places = let(words, lambda w: F.array(*[_positions(w, t) for t in terms]))
    if len(terms) == 1:
        return let(places, lambda at: F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(at[0]), F.lit(1))), F.lit(0.0), lambda s, j: s + F.when(F.size(at[0]) >= j, LABEL_D / (j * j)).otherwise(0.0))) / ZETA_2

    def missed(at: Column) -> Column:
        out = F.lit(1.0)
        for i in range(len(terms)):
            for j in range(i + 1, len(terms)):
                out = out * _apart(at[i], at[j])
        return out

    return 1 - let(places, missed)


def _apart(a: Column, b: Column) -> Column:
    """The product of 1 - closeness over all pairs of places of two arrays."""
    return F.aggregate(a, F.lit(1.0), lambda m, p: m * F.aggregate(b, F.lit(1.0), lambda n, q: n * (1 - _closeness(F.abs(p - q)))))


def _closeness(distance: Column) -> Column:
    wd = F.when(distance > 100, F.lit(1e-30)).otherwise(1 / (1.005 + 0.05 * F.exp(distance / 1.5 - 2)))
    return F.sqrt(F.lit(LABEL_D * LABEL_D) * wd)


def gram_share(text: Column, grams: list[str]) -> Column:
    """LABEL_D / zeta(2) if all bigrams of the query occur in the text without its white space, else 0.

    One look at each gram instead of an index of all grams: CJK text is found without word boundaries.
    """
    if not grams:
        return F.lit(0.0)
    t = F.regexp_replace(F.lower(text), r"\s+", "")
    every = F.lit(True)
    for g in grams:
        every = every & t.contains(g)
    return F.when(every, LABEL_D / ZETA_2).otherwise(0.0)


def keyword_scores(pages: DataFrame, query: str) -> DataFrame:
    """(path, title, score, evidence): every page of ``pages`` that a word, gram or substring of the query hits."""
    terms, grams, q = query_words(query), query_bigrams(query), query.strip().lower()
    title, body = F.coalesce(F.col("title"), F.lit("")), F.coalesce(F.col("body_text"), F.lit(""))
    has = lambda c: (F.instr(F.lower(c), F.lit(q)) > 0) if q else F.lit(False)
    in_title, in_path, in_aliases = has(title), has(F.col("path")), F.coalesce(F.exists("aliases", lambda a: has(a)), F.lit(False))
    parts = {
        "title": word_rank(T.words(title), terms), "body": word_rank(T.words(body), terms), "title_ngrams": gram_share(title, grams), "body_ngrams": gram_share(body, grams),
        "in_title": in_title.cast("double"), "in_path": in_path.cast("double"), "in_aliases": in_aliases.cast("double"),
    }
    # pages without any of the words or grams are gone before ranks are worked out
    near = F.lit(False)
    for t in terms:
        near = near | F.lower(body).contains(t) | F.lower(title).contains(t)
    if grams:
        flat = F.regexp_replace(F.lower(F.concat_ws(" ", title, body)), r"\s+", "")
        near = near | flat.contains(grams[0])
    score = sum((WEIGHTS[k] * v for k, v in parts.items()), F.lit(0.0))
    words = parts["title"] + parts["body"] + parts["title_ngrams"] + parts["body_ngrams"]
    tags = F.array_compact(F.array(F.when(words > 0, "keyword"), F.when(in_title, "title"), F.when(in_path, "path"), F.when(in_aliases, "alias")))
    return pages.where(near | in_path | in_aliases | in_title).select("path", "title", score.alias("score"), tags.alias("evidence")).where("score > 0")


def keyword_search(pages: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """(path, title, score, evidence, snippet): the best ``limit`` pages; ties by path."""
    best = keyword_scores(pages, query).orderBy(best_first("score"), "path").limit(limit)
    text = pages.select("path", T.snippet(F.coalesce(F.get_json_object("frontmatter_json", "$.abstract"), "body_text"), query.strip()).alias("snippet"))
    return text.join(F.broadcast(best), "path").select("path", "title", "score", "evidence", "snippet")


def indexed_search(postings: DataFrame, query: str, limit: int = 10, brain_id: str | None = None) -> DataFrame:
    """(path, score): the word part of the rank from the inverted index; only the postings of the query's words are read."""
    terms = query_words(query)
    p = postings.where(F.col("term").isin(*terms))
    if brain_id:
        p = p.where(F.col("brain_id") == brain_id)
    weight = F.when(F.col("field") == "title", WEIGHTS["title"]).otherwise(WEIGHTS["body"])
    if len(terms) == 1:
        one = F.aggregate(F.sequence(F.lit(1), F.size("positions")), F.lit(0.0), lambda s, j: s + LABEL_D / (j * j)) / ZETA_2
        scored = p.select("path", (weight * one).alias("s"))
    else:
        g = p.groupBy("path", "field").agg(F.collect_list(F.struct("term", "positions")).alias("t"))
        pairs = F.aggregate(
            "t", F.lit(1.0), lambda m, x: m * F.aggregate(F.filter("t", lambda y: y["term"] > x["term"]), F.lit(1.0), lambda n, y: n * F.aggregate(x["positions"], F.lit(1.0), lambda o, a: o * F.aggregate(y["positions"], F.lit(1.0), lambda r, b: r * (1 - _closeness(F.abs(a - b))))))
        )
        scored = g.select("path", (weight * (1 - pairs)).alias("s"))
    return scored.groupBy("path").agg(F.sum("s").alias("score")).where("score > 0").orderBy(best_first("score"), "path").limit(limit)


#: Words and Chinese characters that say nothing, and what is added to a query that has no other form.
STOP_WORDS = {"the", "a", "an", "of", "for", "to", "in", "on", "and", "or", "is", "at"}
STOP_CHARS = set("的了吗呢是在和与或及等被把就都也")
RELATED = " 相关"


def expanded(query: str, most: int = 2) -> list[str]:
    """The query and at most ``most`` other ways to ask it: without stop words, its Han characters apart, its words turned round."""
    words = query.split()
    if not words:
        return []
    plain = " ".join(query.split())
    kept = "".join(c for c in " ".join(w for w in words if w.lower() not in STOP_WORDS) if c not in STOP_CHARS)
    han = re.findall(r"[㐀-䶿一-鿿豈-﫿]", query)
    forms = [plain, " ".join(kept.split()), " ".join(han) if len(han) > 1 else "", " ".join(words[::-1]) if len(words) > 1 else ""]
    forms = list(dict.fromkeys(f for f in forms if f))
    return (forms if len(forms) > 1 else [plain, plain + RELATED])[: most + 1]


def merged_groups(hits: DataFrame) -> DataFrame:
    """(path, rrf): hits of several forms of a query (group, path, score) put together by the sum of 1 / (60 + rank)."""
    rank = F.row_number().over(Window.partitionBy("group").orderBy(best_first("score"), "path"))
    return hits.withColumn("_r", rank).groupBy("path").agg(F.sum(1.0 / (RRF_K + F.col("_r"))).alias("rrf"))


def expected_rank(occurrences: int) -> float:
    """word_rank of one term, for tests."""
    return sum(LABEL_D / j**2 for j in range(1, occurrences + 1)) / ZETA_2 if occurrences else 0.0


def expected_closeness(distance: int) -> float:
    return LABEL_D * math.sqrt(1e-30 if distance > 100 else 1 / (1.005 + 0.05 * math.exp(distance / 1.5 - 2)))
