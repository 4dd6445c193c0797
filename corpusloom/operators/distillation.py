"""From notes to experiences to skills: what isn't distilled yet, outcomes, clusters, and undoing a change."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vector as V
from corpusloom.operators.semantic import batch_vector_search

#: What an outcome does to an experience, and when one is mature.
SUCCESS, FAILURE, START = 0.1, -0.2, 0.5
ARCHIVE_BELOW = 0.4
MATURE_ETA, MATURE_SUPPORT = 0.7, 2


def undistilled(sources: DataFrame, experiences: DataFrame) -> DataFrame:
    """Sources (path) that no active experience (source_paths, status) names."""
    used = experiences.where("status = 'active'").select(F.explode("source_paths").alias("path")).distinct()
    return sources.join(used, "path", "left_anti")


def outcome_fold(outcomes: DataFrame, key: str, at: str, success: Column, start: float = START) -> DataFrame:
    """(key, eta, support, failures, archived): outcomes of a key in order, eta kept within 0 and 1 after every step.

    A step x -> clamp(x + d) is no sum, but such steps compose to x -> clamp(x + a, lo, hi). So equal outcomes of one instant
    are counted, and instants composed by hundredths of a second (at most 20,000 of them), these by minutes (6,000), minutes
    by days (1,440), and then the days of a key: no array holds more, however many outcomes a key has.
    """
    bound = lambda x, lo, hi: F.greatest(lo, F.least(hi, x))
    none = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    then = lambda f, g: F.struct((f["a"] + g["a"]).alias("a"), bound(f["lo"] + g["a"], g["lo"], g["hi"]).alias("lo"), bound(f["hi"] + g["a"], g["lo"], g["hi"]).alias("hi"))
    zero, one, d = F.lit(0.0), F.lit(1.0), F.col("_n") * F.when(F.col("_ok"), SUCCESS).otherwise(FAILURE)
    us = F.unix_micros(F.col(at).cast("timestamp"))
    o = outcomes.select(key, us.alias("_t"), success.alias("_ok")).groupBy(key, "_t", "_ok").agg(F.count(F.lit(1)).alias("_n"))
    o = o.select(key, "_t", F.struct(F.col("_t").alias("t"), F.col("_ok").alias("ok")).alias("_at"), F.struct(d.alias("a"), bound(d, zero, one).alias("lo"), bound(one + d, zero, one).alias("hi")).alias("f"), F.when(F.col("_ok"), F.col("_n")).otherwise(0).alias("s"), F.when(~F.col("_ok"), F.col("_n")).otherwise(0).alias("x"))
    composed = F.aggregate(F.array_sort(F.collect_list(F.struct("_at", "f"))), none, lambda f, x: then(f, x["f"])).alias("f")
    for size in (10_000, 60_000_000, 86_400_000_000, None):
        piece = [F.floor(F.col("_t") / size).cast("long").alias("_p")] if size else []
        o = o.groupBy(key, *piece).agg(composed, F.sum("s").alias("s"), F.sum("x").alias("x"))
        if size:
            o = o.select(key, (F.col("_p") * size).alias("_t"), F.struct(F.col("_p").alias("t"), F.lit(True).alias("ok")).alias("_at"), "f", "s", "x")
    eta = bound(F.lit(start) + F.col("f.a"), F.col("f.lo"), F.col("f.hi"))
    return o.select(key, eta.alias("eta"), F.col("s").alias("support"), F.col("x").alias("failures"), (F.round(eta, 9) < ARCHIVE_BELOW).alias("archived"))


def mature(eta: Column, support: Column, counter_examples: Column) -> Column:
    return (F.coalesce(eta, F.lit(0.0)) >= MATURE_ETA) & (F.coalesce(support, F.lit(0)) >= MATURE_SUPPORT) & (F.coalesce(F.size(counter_examples), F.lit(0)) <= 0)


def crystallized(experiences: DataFrame) -> DataFrame:
    """(trigger, n, eta, support, skill): experiences with the same trigger put together, and the name of the skill."""
    trigger = F.lower(F.trim("trigger"))
    g = experiences.withColumn("trigger", F.when(F.coalesce(trigger, F.lit("")) == "", F.col("id").cast("string")).otherwise(trigger))
    g = g.groupBy("trigger").agg(F.count(F.lit(1)).alias("n"), F.avg("eta").alias("eta"), F.max("support").alias("support"))
    return g.withColumn("skill", skill_name(F.col("trigger")))


def skill_name(trigger: Column) -> Column:
    """The slug of the trigger's ASCII letters and digits, or skill- and part of its hash."""
    ascii_ = F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(F.lower(trigger), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 48), "-+$", "")
    return F.when(F.length(ascii_) >= 3, ascii_).otherwise(F.concat(F.lit("skill-"), F.substring(F.sha2(trigger, 256), 1, 16)))


def reverted(pages: DataFrame, diffs: DataFrame) -> DataFrame:
    """Pages after undoing diffs (op, path, before): created pages go, patched ones get their text back."""
    d = diffs.select("path", F.col("op").alias("_op"), F.col("before").alias("_before"))
    j = pages.join(d, "path", "left").where("_op is null or _op not in ('create', 'skill_create')")
    return j.withColumn("body_text", F.when(F.col("_op").isin("merge", "supersede", "patch"), F.coalesce("_before", "body_text")).otherwise(F.col("body_text"))).drop("_op", "_before")


def extracted(windows: DataFrame, extractor: Callable[[str], list[dict]]) -> DataFrame:
    """(session_id, window, type, title, body) from (session_id, window, text) by a Python callable, one batch at a time.

    A callable that fails gives one row of type ``error`` with the message, so a window is never lost.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for s, w, t in zip(b["session_id"], b["window"], b["text"], strict=True):
                try:
                    rows += [(s, w, str(i.get("type") or "note"), str(i.get("title") or ""), str(i.get("body") or "")) for i in extractor(t or "")]
                except Exception as e:  # noqa: BLE001
                    rows.append((s, w, "error", "", str(e)))
            yield pd.DataFrame(rows, columns=["session_id", "window", "type", "title", "body"])

    return windows.select("session_id", "window", "text").mapInPandas(run, "session_id string, window int, type string, title string, body string")


def contract_json(text: Column) -> Column:
    """The JSON object of an extractor's answer: what a code fence or else the outermost braces hold; null if that is no object."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    body = F.when(fenced != "", fenced).otherwise(F.regexp_extract(text, r"(?s)\{.*\}", 0))
    alone = F.concat(F.lit("["), body, F.lit("]"))  # the parser would take a first object and leave the rest
    return F.when((body != "") & F.try_parse_json(alone).isNotNull() & (F.json_array_length(alone) == 1), body)


def recent_duplicates(new: DataFrame, existing: DataFrame, key: str, text: str, at: str, most: int = 200, least: float = 0.95) -> DataFrame:
    """(key, nearest, score, repeats): for every item of ``new`` the one of the ``most`` latest of ``existing`` whose text is most similar,
    by the cosine of their hash embeddings; it repeats that one from ``least`` on.

    The window is the feature: an item is held against the latest ones only, so that side is small, and any number of new items
    passes by it in batches.
    """
    vector = V.hash_embedding(T.letter_pairs(F.coalesce(text, F.lit(""))))
    recent = existing.select(key, text, at).orderBy(F.desc(at), key).limit(most)
    found = batch_vector_search(recent.select(F.col(key).alias("path"), vector.alias("embedding")), new.select(F.col(key).alias("query_id"), vector.alias("vector")), 1)
    return found.select(F.col("query_id").alias(key), F.col("path").alias("nearest"), "score", (F.col("score") >= least).alias("repeats"))


def first_of_each(items: DataFrame, order: str, existing: DataFrame | None = None) -> DataFrame:
    """Items (title, body, …) whose normalised text is new: not in ``existing`` and the first of its kind by ``order``."""
    rest = [c for c in items.columns if c != order]
    keyed = items.withColumn("_key", F.md5(T.dedupe_key(F.col("title"), F.col("body"))))
    if existing is not None:
        keyed = keyed.join(existing.select(F.md5(T.dedupe_key(F.col("title"), F.col("body"))).alias("_key")).distinct(), "_key", "left_anti")
    return keyed.groupBy("_key").agg(F.min(F.struct(order, *rest)).alias("_r")).select("_r.*")
