"""The queries of the problems tagged llm, and the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.llm import abuse, bpe, components, conversations, knn, leakage, names
from corpusloom.tables import table


def p1_found(spark, d):
    return knn.near_pairs(table(spark, d, "chunks"))


def p1_neighbours(spark, d):
    found = knn.neighbours(table(spark, d, "chunks"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("far"), "neighbour")))
    return found.groupBy("id").agg(F.transform(ranked, lambda x: x["neighbour"]).alias("neighbours"))


def p2_found(spark, d):
    return components.redirect_groups(table(spark, d, "entity_registry"))


def p2_records(spark, d):
    return components.resolved_records(table(spark, d, "entity_registry"))


def p3_found(spark, d):
    return conversations.kept_messages(table(spark, d, "turns"), table(spark, d, "inbox_meta")).select("session_id", "pos", "turn_id")


def p3_conversations(spark, d):
    return conversations.conversations(table(spark, d, "turns"), table(spark, d, "inbox_meta"))


def p3_gaps(spark, d):
    return conversations.calibrated_gap(table(spark, d, "turns"))


def p4_found(spark, d):
    return names.variant_pairs(table(spark, d, "entity_registry"))


def p4_clusters(spark, d):
    c = names.clustered_names(table(spark, d, "entity_registry"))
    least = c.groupBy("brain_id", "entity").agg(F.min("slug").alias("entity_slug"), F.count(F.lit(1)).alias("n_records"))
    return c.join(least, ["brain_id", "entity"]).select("brain_id", "slug", "entity_slug", "n_records")


def p6_ids(spark, d):
    return bpe.encode(table(spark, d, "documents").select("doc_id", "text"))


def p6_token_counts(spark, d):
    ids = bpe.encode(table(spark, d, "documents").select("doc_id", "text"))
    return ids.select(F.explode("ids").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def p7_found(spark, d):
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_items(spark, d):
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_reparameterised(spark, d):
    return leakage.reparameterised(table(spark, d, "documents"), table(spark, d, "eval_items"))


def _abuse(spark, d):
    return abuse.scores(table(spark, d, "documents"), table(spark, d, "doc_labels"))


def p8_found(spark, d):
    return _abuse(spark, d).where("flagged").select("doc_id")


def p8_scores(spark, d):
    return _abuse(spark, d).select("doc_id", "score", "flagged")


def p8_rates(spark, d):
    return abuse.rates(_abuse(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_neighbours, p2_found, p2_records, p3_found, p3_conversations, p3_gaps, p4_found, p4_clusters, p6_ids, p6_token_counts, p7_found, p7_items, p7_reparameterised, p8_found, p8_scores, p8_rates)}

_GROUPS = """
WITH RECURSIVE cur AS (
  SELECT brain_id, slug, arg_max(struct_pack(s := lower(trim(status)), c := lower(trim(canonical_slug))), updated_at) AS r
  FROM entity_registry WHERE brain_id IS NOT NULL AND slug IS NOT NULL GROUP BY 1, 2),
e AS (SELECT brain_id, slug AS a, r.c AS b FROM cur WHERE r.s = 'merged' AND r.c <> '' AND r.c <> slug),
u AS (SELECT brain_id, a, b FROM e UNION SELECT brain_id, b, a FROM e),
walk AS (
  SELECT brain_id, a, a AS b FROM u
  UNION
  SELECT w.brain_id, w.a, u.b FROM walk w JOIN u ON u.brain_id = w.brain_id AND u.a = w.b),
g AS (
  SELECT w.brain_id, w.a AS slug, min(w.b) AS group_slug, count(DISTINCT w.b) AS n FROM walk w
  WHERE EXISTS (SELECT 1 FROM cur c WHERE c.brain_id = w.brain_id AND c.slug = w.b)
    AND EXISTS (SELECT 1 FROM cur c WHERE c.brain_id = w.brain_id AND c.slug = w.a) GROUP BY 1, 2)
"""
_SPACE = r"[\s\p{Z}\p{Cc}\p{Cf}]"
_TALK = rf"""
WITH m AS (
  SELECT regexp_replace(session_id, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS session_id, turn, turn_id, "at" AS said_at, text,
    lower(regexp_replace(role, '^{_SPACE}+|{_SPACE}+$', '', 'g')) AS r FROM turns WHERE session_id IS NOT NULL),
o AS (SELECT *, CASE WHEN r = 'human' THEN 'user' WHEN r IN ('ai', 'bot') THEN 'assistant' WHEN r IN ('user', 'assistant', 'system', 'tool') THEN r END AS role,
    row_number() OVER (PARTITION BY session_id, turn ORDER BY turn_id) AS k FROM m),
v AS (SELECT session_id FROM o WHERE k = 1 GROUP BY 1 HAVING count(*) = count(turn) AND count(*) = count(role) AND min(turn) = 1 AND max(turn) = count(*)),
t AS (
  SELECT o.*, CASE WHEN regexp_matches(trim(said_at), '^[0-9]+$') THEN CAST(trim(said_at) AS BIGINT) * 1000
      ELSE epoch_us(TRY_CAST(CASE WHEN regexp_matches(a, '([+-][0-9][0-9]:[0-9][0-9]|Z)$') THEN a ELSE a || 'Z' END AS TIMESTAMPTZ)) END AS us
  FROM (SELECT *, regexp_replace(replace(trim(said_at), '/', '-'), '([0-9]:[0-9][0-9][^+-]*[+-][0-9][0-9])([0-9][0-9])$', '\1:\2') AS a FROM o WHERE k = 1) o
  JOIN v USING (session_id) WHERE session_id IN (SELECT regexp_replace(session_id, '^{_SPACE}+|{_SPACE}+$', '', 'g') FROM inbox_meta)),
f AS (SELECT *, last_value(us IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn) AS instant,
    regexp_replace(regexp_replace(coalesce(text, ''), '<[a-z]+-memory-context\b[^>]*>.*?</[a-z]+-memory-context>', '', 'gis'), '{_SPACE}', '', 'g') = '' AS blank FROM t),
kept AS (SELECT *, row_number() OVER w AS pos FROM f WHERE NOT blank WINDOW w AS (PARTITION BY session_id ORDER BY instant NULLS FIRST, turn)),
said AS (SELECT *, row_number() OVER w AS i, lag(role) OVER w AS pr, lag(instant) OVER w AS pi, row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) AS j
  FROM kept WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY session_id ORDER BY pos)),
good AS (SELECT session_id FROM said GROUP BY 1
  HAVING bool_or(i = 1 AND role = 'user') AND bool_or(j = 1 AND role = 'assistant') AND NOT bool_or(coalesce(role = 'user' AND pr = 'user' AND instant - pi > 600000000, false)))
"""
SQL = {
    "p2_found": _GROUPS + "SELECT brain_id, slug, group_slug FROM g WHERE n > 1",
    "p2_records": _GROUPS + "SELECT cur.brain_id, cur.slug, coalesce(g.group_slug, cur.slug) AS group_slug FROM cur LEFT JOIN g ON g.brain_id = cur.brain_id AND g.slug = cur.slug",
    "p3_found": _TALK + "SELECT session_id, pos, turn_id FROM kept WHERE session_id IN (SELECT session_id FROM good)",
}
