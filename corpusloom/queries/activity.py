"""Sessions, records, events, statistics, distillation and the incremental sync over the whole tables."""

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import distillation, indexing, records, sessions, statistics
from corpusloom.queries.common import NOW, PAGES, RECORDS, WORDS, active, pages
from corpusloom.queries.common import records as current
from corpusloom.queries.searches import _keyword
from corpusloom.streaming import streams
from corpusloom.tables import table


def _turns(spark, d):
    """Turns with their session id, each (session, turn) once."""
    t = table(spark, d, "turns").where("session_id is not null")
    return t.groupBy("session_id", "turn").agg(F.min(F.struct("turn_id", "role", "text")).alias("r")).select("session_id", "turn", "r.*")


def session_buffers(spark, d):
    return sessions.buffers(_turns(spark, d))


def session_windows(spark, d):
    return sessions.windows(_turns(spark, d), max_turns=6, max_chars=1500)


def truncated_turns(spark, d):
    return sessions.truncated(_turns(spark, d), 800).select("turn_id", "session_id", "turn")


def clean_turns(spark, d):
    return table(spark, d, "turns").select("turn_id", F.md5(F.coalesce(sessions.clean_text(F.col("role"), F.col("text")), F.lit(""))).alias("text_md5"))


def latest_status(spark, d):
    return sessions.latest_status(table(spark, d, "inbox_meta"))


def recall_gate(spark, d):
    return sessions.recall_gate(_turns(spark, d)).groupBy("score", "asks").agg(F.count(F.lit(1)).alias("n"))


def gate_scores(spark, d):
    return table(spark, d, "turns").select("turn_id", sessions.gate_score(F.col("text")).alias("score"))


def repeats_dropped(spark, d):
    e = table(spark, d, "events")
    return sessions.without_repeats(e, ["user_id", "event_type"], seconds=7200).select("event_id")


def hourly_events(spark, d):
    h = streams.hourly(table(spark, d, "events"))
    return h.select("hour", "event_type", "n", F.round("value", 4).alias("value"))


def event_list(spark, d):
    return statistics.event_list(table(spark, d, "events"), type_="click", since="2024-01-10 00:00:00").select("event_id", "user_id", "event_type")


def event_by_id(spark, d):
    """The event that a diff names: the id is a filter at the scan, over all months."""
    e = table(spark, d, "events")
    return e.where("event_id = 4711 or event_id = 47").select("event_id", "user_id", "event_type", F.round("value", 4).alias("value"))


def event_sources(spark, d):
    """Events and their payload keys per type and month."""
    e = table(spark, d, "events").withColumn("month", F.date_format("ts", "yyyy-MM"))
    return e.groupBy("month", "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.avg("value"), 4).alias("mean"))


def query_statistics(spark, d):
    """The events stand for a query log: value is the score, its whole part the hits."""
    e = table(spark, d, "events").select(F.floor(F.col("value") / 10).alias("hit_count"), F.col("value").alias("avg_score"), F.when(F.col("event_id") % 3 == 0, F.col("value") * 2).alias("latency_ms"))
    s = statistics.query_statistics(e)
    return s.select("n_queries", F.round("zero_rate", 6).alias("zero_rate"), F.round("avg_score", 4).alias("avg_score"), F.round("avg_latency_ms", 4).alias("avg_latency_ms"))


def tokens_by_day(spark, d):
    """Estimated tokens of the messages of each day of arrival."""
    t = table(spark, d, "turns").where("at is not null and text is not null")
    return t.groupBy(F.substring(F.trim("at"), 1, 10).alias("day")).agg(F.sum(T.estimated_tokens(F.col("text"))).cast("long").alias("tokens"), F.count(F.lit(1)).alias("n"))


def trend(spark, d):
    """Daily means of every type of event as facts of a metric."""
    e = table(spark, d, "events")
    f = e.groupBy(F.upper("event_type").alias("metric"), F.date_format("ts", "yyyy-MM-dd").alias("at")).agg(F.avg("value").alias("value")).withColumn("period", F.lit(None).cast("string"))
    t = statistics.trends(f)
    return t.select("metric", "n", "old_key", "new_key", F.round("old_value", 4).alias("old_value"), F.round("new_value", 4).alias("new_value"), "verdict")


def trend_by_user(spark, d):
    e = table(spark, d, "events")
    f = e.select(F.col("user_id").cast("string").alias("metric"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("at"), F.lit(None).cast("string").alias("period"), "value")
    return statistics.trends(f, lower_is_better=True).select("metric", "n", "verdict")


def evidence_counts(spark, d):
    from corpusloom.operators.keyword import keyword_scores

    s = statistics.evidence_shares(keyword_scores(active(spark, d), "notes"))
    return s.select("tag", "n", F.round("share", 6).alias("share"))


def outcome_fold(spark, d):
    """Events of a user as outcomes of one experience: a value of 50 and more is a success."""
    o = distillation.outcome_fold(table(spark, d, "events").where("user_id is not null and value is not null"), "user_id", "ts", F.col("value") >= 50)
    return o.select("user_id", F.round("eta", 6).alias("eta"), "support", "failures", "archived")


def undistilled(spark, d):
    """Pages that are no source of an experience page of their folder's source."""
    p = active(spark, d)
    e = p.where("schema_type = 'experience'").select(F.array("path").alias("source_paths"), "status")
    return distillation.undistilled(p.select("path"), e)


def crystallized(spark, d):
    p = active(spark, d).where("schema_type = 'experience'")
    e = p.select(F.col("path").alias("id"), F.regexp_extract("path", r"/issues/([^/]+)/", 1).alias("trigger"), (F.length("body_text") % 10 / 10.0).alias("eta"), F.size("aliases").cast("long").alias("support"))
    return distillation.crystallized(e).select("trigger", "n", F.round("eta", 6).alias("eta"), "support", "skill")


def boot_experiences(spark, d):
    p = active(spark, d).where("schema_type = 'experience'")
    return p.select("path", (F.length("body_text") % 10 / 10.0).alias("eta"), F.size("aliases").alias("support")).orderBy(F.desc("eta"), F.desc("support"), "path").limit(20)


def find_pages(spark, d):
    q = "queue"
    p = active(spark, d)
    return p.where(F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(q)) | F.contains(F.lower("path"), F.lit(q))).select("path", "title")


def sync_plan(spark, d):
    """The pages as they were before July 2026 against the pages of today."""
    every = table(spark, d, "pages")
    from corpusloom.operators.pages import current_pages

    return indexing.sync_plan(current_pages(every.where("updated_at < timestamp '2026-07-01'")), pages(spark, d))


def synced_pages(spark, d):
    every = table(spark, d, "pages")
    from corpusloom.operators.pages import current_pages

    old = current_pages(every.where("updated_at < timestamp '2026-07-01'"))
    return indexing.synced(old, pages(spark, d)).select("path", "content_hash")


def unique_links(spark, d):
    return indexing.unique_links(table(spark, d, "links")).select("id", "synced_at", "type")


def new_items(spark, d):
    """Documents whose normalised title and text come first among those alike."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.coalesce("title", F.lit("")).alias("title"), F.col("text").alias("body"))
    return distillation.first_of_each(t, "doc_id").select("doc_id")


def recent_duplicates(spark, d):
    """Documents, by their titles, against the 200 latest of source ``inbox-main``."""
    every = table(spark, d, "documents").where("title is not null")
    latest = every.where("source = 'inbox-main'")
    return distillation.recent_duplicates(every.where("source is null or source <> 'inbox-main'"), latest, "doc_id", "title", "created_at").select("doc_id", "nearest", F.round("score", 5).alias("score"), "repeats")


def contract_titles(spark, d):
    """Documents that hold a JSON object, as an extractor's answer does, with its title."""
    j = distillation.contract_json(F.col("text"))
    return table(spark, d, "documents").select("doc_id", j.alias("j")).where("j is not null").select("doc_id", F.get_json_object("j", "$.title").alias("title"))


def resolved_records(spark, d):
    return records.resolved(current(spark, d))


def alias_conflicts(spark, d):
    return records.alias_conflicts(current(spark, d))


def record_mentions(spark, d):
    return records.mentions(table(spark, d, "links"), current(spark, d))


def merged_records(spark, d):
    m = records.merged_records(current(spark, d))
    return m.select("brain_id", "target", "n", F.array_join("slugs", ",").alias("slugs"), "n_aliases")


def name_counts(spark, d):
    return records.name_table(current(spark, d)).groupBy("brain_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("names"))


def flush_batches(spark, d):
    return sessions.flush_batches(table(spark, d, "events"), "user_id", most=3, seconds=86_400).select("user_id", "batch", "n")


def session_prompts(spark, d):
    return sessions.prompts(_turns(spark, d), 800).select("session_id", "n", F.md5("prompt").alias("prompt_md5"))


def pruned_sessions(spark, d):
    return sessions.pruned(table(spark, d, "inbox_meta").dropDuplicates(["session_id"]), NOW).select("session_id", "status")


def purged_pages(spark, d):
    """Pages after archived ones are purged, by type."""
    from corpusloom.operators.pages import purged

    p = pages(spark, d)
    return purged(p, p.where("status = 'archived'")).groupBy("schema_type").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        session_buffers, session_windows, truncated_turns, clean_turns, latest_status, recall_gate, gate_scores, repeats_dropped, hourly_events, event_list, event_by_id, event_sources, query_statistics, tokens_by_day, trend, trend_by_user,
        evidence_counts, outcome_fold, undistilled, crystallized, boot_experiences, find_pages, sync_plan, synced_pages, unique_links, new_items, recent_duplicates, contract_titles, resolved_records, alias_conflicts, record_mentions, merged_records, name_counts, flush_batches,
        session_prompts, pruned_sessions, purged_pages,
    )
}

_T = """t AS (SELECT session_id, turn, turn_id, role, text FROM turns WHERE session_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id, turn ORDER BY turn_id) = 1),
c AS (SELECT *, lower(trim(role)) IN ('user', 'assistant') AS k FROM t)"""
def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(g, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


_LIKE = f"regexp_matches(g, '{sessions.PATH_LIKE.replace(chr(39), chr(39) * 2)}')"
_GATE = (
    "(" + " + ".join(f"CASE WHEN {_any(ws)} THEN {p} ELSE 0 END" for p, ws in sessions.GATE) + f" + CASE WHEN {_any(sessions.ENGINEERING)} OR {_LIKE} THEN 2 ELSE 0 END"
    + f" - CASE WHEN {_any(sessions.KNOWLEDGE)} AND NOT ({_any(sessions.OPERATIONAL)} OR {_any(sessions.EXECUTE)} OR {_any(sessions.ENGINEERING)} OR {_any(sessions.CONVENTION)} OR {_LIKE}) THEN 2 ELSE 0 END)"
)
_MEMO = r"<[a-z]+-memory-context\b[^>]*>.*?</[a-z]+-memory-context>"
_NAMES = """nm AS (SELECT DISTINCT brain_id, slug, status, lower(trim(x)) AS name FROM (
  SELECT brain_id, slug, status, unnest(list_concat([slug, title], coalesce(CASE WHEN json_valid(aliases_json) THEN from_json(aliases_json, '["VARCHAR"]') END, []))) AS x FROM rec) WHERE trim(x) <> '')"""
_RES = """one AS (SELECT brain_id, slug, canonical_slug AS target, CAST(slug <> canonical_slug AS INTEGER) AS s FROM rec),
two AS (SELECT one.brain_id, one.slug, coalesce(n.canonical_slug, one.target) AS target, one.s + coalesce(CAST(n.canonical_slug <> one.target AS INTEGER), 0) AS steps FROM one LEFT JOIN rec n ON n.brain_id = one.brain_id AND n.slug = one.target)"""
_SYNC = PAGES + ", " + PAGES.replace("cp AS", "co AS").replace("FROM pages WHERE path IS NOT NULL", "FROM pages WHERE path IS NOT NULL AND updated_at < TIMESTAMP '2026-07-01'").split(",\nap AS")[0]
SQL = {
    "session_buffers": f"WITH {_T} SELECT session_id, CAST(sum(CASE WHEN k THEN 1 ELSE 0 END) AS BIGINT) AS turns, CAST(coalesce(sum(CASE WHEN k THEN length(text) END), 0) AS BIGINT) AS chars FROM c GROUP BY 1",
    "session_windows": f"""WITH RECURSIVE {_T}, o AS (SELECT session_id, turn, CAST(coalesce(k, false) AS INTEGER) AS k, CASE WHEN k THEN coalesce(length(text), 0) ELSE 0 END AS c,
    row_number() OVER (PARTITION BY session_id ORDER BY turn NULLS FIRST) AS i, count(*) OVER (PARTITION BY session_id) AS m FROM c),
r AS (SELECT session_id, i, m, turn, 0 AS w, turn AS f, k AS n, c AS s, (k >= 6 OR c >= 1500) AS shut FROM o WHERE i = 1
  UNION ALL SELECT o.session_id, o.i, o.m, o.turn, CASE WHEN r.shut THEN r.w + 1 ELSE r.w END, CASE WHEN r.shut THEN o.turn ELSE r.f END, CASE WHEN r.shut THEN o.k ELSE r.n + o.k END, CASE WHEN r.shut THEN o.c ELSE r.s + o.c END,
    CASE WHEN r.shut THEN o.k >= 6 OR o.c >= 1500 ELSE r.n + o.k >= 6 OR r.s + o.c >= 1500 END FROM r JOIN o ON o.session_id = r.session_id AND o.i = r.i + 1)
SELECT session_id, CAST(w AS INTEGER) AS "window", CAST(f AS INTEGER) AS first_turn, CAST(turn AS INTEGER) AS last_turn, CAST(n AS INTEGER) AS turns, CAST(s AS BIGINT) AS chars, shut AS closed FROM r WHERE shut OR i = m""",
    "truncated_turns": f"""WITH {_T}, w AS (SELECT *, sum(CASE WHEN k THEN length(text) ELSE 0 END) OVER (PARTITION BY session_id ORDER BY turn DESC) AS s, sum(CAST(k AS INTEGER)) OVER (PARTITION BY session_id ORDER BY turn DESC) AS n FROM c)
SELECT turn_id, session_id, turn FROM w WHERE NOT coalesce(k, false) OR s <= 800 OR n = 1""",
    "clean_turns": f"""WITH t AS (SELECT turn_id, role, regexp_replace(text, '{_MEMO}', '', 'gis') AS t FROM turns) SELECT turn_id, md5(coalesce(CASE WHEN lower(trim(role)) = 'tool' THEN substr(t, 1, 2000) ELSE t END, '')) AS text_md5 FROM t""",
    "latest_status": "SELECT session_id, arg_max(status, created_at) AS status, max(created_at) AS created_at FROM inbox_meta GROUP BY 1",
    "gate_scores": f"WITH t AS (SELECT turn_id, lower(trim(coalesce(text, ''), ' ')) AS g FROM turns) SELECT turn_id, CAST({_GATE} AS INTEGER) AS score FROM t",
    "recall_gate": rf"""WITH {_T}, u AS (SELECT turn_id, text, list_distinct({WORDS.format('text')}) AS w, lag(list_distinct({WORDS.format('text')})) OVER (PARTITION BY session_id ORDER BY turn, turn_id) AS p FROM c WHERE lower(trim(role)) = 'user'),
v AS (SELECT *, lower(trim(coalesce(text, ''), ' ')) AS g FROM u), s AS (SELECT text, g, {_GATE} - CASE WHEN len(list_distinct(list_concat(w, p))) > 0 AND len(list_intersect(w, p)) / CAST(len(list_distinct(list_concat(w, p))) AS DOUBLE) >= 0.5 AND p IS NOT NULL AND w IS NOT NULL THEN 3 ELSE 0 END AS score FROM v)
SELECT CAST(score AS INTEGER) AS score, (score >= 3 OR regexp_matches(g, '^/memory(\s|$)') OR contains(g, '{sessions.FORCED}')) AND length(g) >= 4 AND NOT contains(g, '<df-memory-context') AS asks, count(*) AS n FROM s GROUP BY 1, 2""",
    "evidence_counts": f"""WITH {PAGES}, {_keyword('ap', 'notes')}, e AS (SELECT unnest(list_filter([CASE WHEN t + b + tn + bn > 0 THEN 'keyword' END, CASE WHEN it THEN 'title' END, CASE WHEN ip THEN 'path' END, CASE WHEN ia THEN 'alias' END], lambda x: x IS NOT NULL)) AS tag FROM kw)
SELECT tag, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM kw) AS DOUBLE), 6) AS share FROM e GROUP BY 1""",
    "repeats_dropped": """WITH b AS (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM events) SELECT event_id FROM b WHERE p IS NULL OR epoch_us(ts) - epoch_us(p) > 7200000000""",
    "hourly_events": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "event_list": "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id DESC LIMIT 50",
    "event_by_id": "SELECT event_id, user_id, event_type, round(value, 4) AS value FROM events WHERE event_id IN (4711, 47)",
    "event_sources": "SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 4) AS mean FROM events GROUP BY 1, 2",
    "query_statistics": """SELECT count(*) AS n_queries, round(CAST(sum(CASE WHEN floor(value / 10) = 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS zero_rate, round(avg(value), 4) AS avg_score,
  round(avg(CASE WHEN event_id % 3 = 0 THEN value * 2 END), 4) AS avg_latency_ms FROM events""",
    "tokens_by_day": "SELECT substr(trim(\"at\"), 1, 10) AS day, CAST(sum(greatest(1, ceil(length(text) / 4))) AS BIGINT) AS tokens, count(*) AS n FROM turns WHERE \"at\" IS NOT NULL AND text IS NOT NULL GROUP BY 1",
    "trend": """WITH f AS (SELECT lower(event_type) AS metric, strftime(ts, '%Y-%m-%d') AS k, avg(value) AS v FROM events GROUP BY 1, 2),
w AS (SELECT metric, k, v, lag(k) OVER o AS ok, lag(v) OVER o AS ov, row_number() OVER o AS i FROM f WINDOW o AS (PARTITION BY metric ORDER BY k, v)),
p AS (SELECT metric, count(*) AS n, max(i) FILTER (ov IS NOT NULL AND ov <> 0) AS i FROM w GROUP BY 1)
SELECT p.metric, p.n, w.ok AS old_key, w.k AS new_key, round(w.ov, 4) AS old_value, round(w.v, 4) AS new_value,
  CASE WHEN w.ov IS NULL THEN 'insufficient' WHEN (w.ov - w.v) / abs(w.ov) >= 0.1 THEN 'regressing' ELSE 'stable' END AS verdict FROM p LEFT JOIN w ON w.metric = p.metric AND w.i = p.i""",
    "trend_by_user": """WITH f AS (SELECT CAST(user_id AS VARCHAR) AS metric, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS k, value AS v FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL),
w AS (SELECT metric, k, v, lag(v) OVER o AS ov, row_number() OVER o AS i FROM f WINDOW o AS (PARTITION BY metric ORDER BY k, v)),
p AS (SELECT metric, count(*) AS n, max(i) FILTER (ov IS NOT NULL AND ov <> 0) AS i FROM w GROUP BY 1)
SELECT p.metric, p.n, CASE WHEN w.ov IS NULL THEN 'insufficient' WHEN -(w.ov - w.v) / abs(w.ov) >= 0.1 THEN 'regressing' ELSE 'stable' END AS verdict FROM p LEFT JOIN w ON w.metric = p.metric AND w.i = p.i""",
    "outcome_fold": """WITH RECURSIVE o AS (SELECT user_id, value >= 50 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, value >= 50) AS i, count(*) OVER (PARTITION BY user_id) AS m FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL),
r AS (SELECT user_id, i, m, greatest(0, least(1, CAST(0.5 AS DOUBLE) + CASE WHEN ok THEN CAST(0.1 AS DOUBLE) ELSE CAST(-0.2 AS DOUBLE) END)) AS eta, CAST(ok AS BIGINT) AS s FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.i, o.m, greatest(0, least(1, r.eta + CASE WHEN o.ok THEN CAST(0.1 AS DOUBLE) ELSE CAST(-0.2 AS DOUBLE) END)), r.s + CAST(o.ok AS BIGINT) FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
SELECT user_id, round(eta, 6) AS eta, s AS support, m - s AS failures, round(eta, 9) < 0.4 AS archived FROM r WHERE i = m""",
    "undistilled": f"WITH {PAGES} SELECT path FROM ap WHERE schema_type IS DISTINCT FROM 'experience'",
    "crystallized": rf"""WITH {PAGES}, e AS (SELECT path, lower(trim(regexp_extract(path, '/issues/([^/]+)/', 1))) AS t, length(body_text) % 10 / 10.0::DOUBLE AS eta, len(aliases) AS support FROM ap WHERE schema_type = 'experience'),
g AS (SELECT CASE WHEN t = '' THEN path ELSE t END AS trigger, eta, support FROM e)
SELECT trigger, count(*) AS n, round(avg(eta), 6) AS eta, max(coalesce(support, -1)) AS support, CASE WHEN length(regexp_replace(trigger, '[^a-z0-9]+', '-', 'g')) >= 3 THEN regexp_replace(substr(trim(regexp_replace(trigger, '[^a-z0-9]+', '-', 'g'), '-'), 1, 48), '-+$', '') ELSE 'skill-' || substr(sha256(trigger), 1, 16) END AS skill FROM g GROUP BY 1""",
    "boot_experiences": f"WITH {PAGES} SELECT path, length(body_text) % 10 / 10.0::DOUBLE AS eta, CAST(coalesce(len(aliases), -1) AS INTEGER) AS support FROM ap WHERE schema_type = 'experience' ORDER BY eta DESC, support DESC, path LIMIT 20",
    "find_pages": f"WITH {PAGES} SELECT path, title FROM ap WHERE contains(lower(coalesce(title, '')), 'queue') OR contains(lower(path), 'queue')",
    "sync_plan": f"""WITH {_SYNC} SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.content_hash IS NULL THEN 'insert' WHEN n.content_hash IS NULL THEN 'delete' WHEN o.content_hash = n.content_hash THEN 'unchanged' ELSE 'update' END AS action
FROM co o FULL JOIN cp n ON o.path = n.path""",
    "synced_pages": f"WITH {PAGES} SELECT path, content_hash FROM cp",
    "unique_links": "SELECT id, min(synced_at) AS synced_at, arg_min(type, synced_at) AS type FROM links GROUP BY 1",
    "new_items": r"""WITH t AS (SELECT doc_id, lower(trim(regexp_replace(coalesce(title, '') || ' ' || coalesce(nullif(regexp_extract(text, '(?s)##\s*正文\s*\n(.*)', 1), ''), text), '[\s\p{Z}]+', ' ', 'g'))) AS k FROM documents WHERE text IS NOT NULL)
SELECT min(doc_id) AS doc_id FROM t GROUP BY k""",
    "contract_titles": r"""WITH b AS (SELECT doc_id, coalesce(nullif(regexp_extract(text, '```(?:json)?\s*(\{.*?\})\s*```', 1, 's'), ''), regexp_extract(text, '\{.*\}', 0, 's')) AS j FROM documents WHERE text IS NOT NULL)
SELECT doc_id, json_extract_string(j, '$.title') AS title FROM b WHERE j <> '' AND json_valid(j)""",
    "resolved_records": f"WITH {RECORDS}, {_RES} SELECT brain_id, slug, target, steps FROM two",
    "alias_conflicts": f"WITH {RECORDS}, {_NAMES} SELECT brain_id, name, count(DISTINCT slug) AS n, min(slug) AS least_slug FROM nm WHERE status = 'active' GROUP BY 1, 2 HAVING count(DISTINCT slug) > 1",
    "record_mentions": f"""WITH {RECORDS}, {_NAMES}, n AS (SELECT brain_id, name, min(slug) AS slug FROM nm GROUP BY 1, 2),
b AS (SELECT DISTINCT id, brain_id, lower(trim(to_ref)) AS name FROM links WHERE to_ref IS NOT NULL AND NOT contains(to_ref, '/') AND NOT contains(to_ref, chr(92))) SELECT id, slug FROM b JOIN n USING (brain_id, name)""",
    "merged_records": f"""WITH {RECORDS}, {_RES}, g AS (SELECT two.brain_id, two.target, two.slug, coalesce(CASE WHEN json_valid(aliases_json) THEN from_json(aliases_json, '["VARCHAR"]') END, []) AS a FROM two JOIN rec ON rec.brain_id = two.brain_id AND rec.slug = two.slug)
SELECT brain_id, target, count(DISTINCT slug) AS n, array_to_string(list_sort(list_distinct(list(slug))), ',') AS slugs, CAST(len(list_distinct(flatten(list(a)))) AS INTEGER) AS n_aliases FROM g GROUP BY 1, 2 HAVING count(DISTINCT slug) > 1""",
    "flush_batches": """WITH RECURSIVE o AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i, count(*) OVER (PARTITION BY user_id) AS m FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
r AS (SELECT user_id, i, m, 0 AS b, 1 AS n, t AS closed, false AS shut, t FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.i, o.m, CASE WHEN r.shut THEN r.b + 1 ELSE r.b END, CASE WHEN r.shut THEN 1 ELSE r.n + 1 END, CASE WHEN r.shut THEN r.t ELSE r.closed END,
    (CASE WHEN r.shut THEN 1 ELSE r.n + 1 END) >= 3 OR o.t - (CASE WHEN r.shut THEN r.t ELSE r.closed END) >= 86400000000, o.t FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
SELECT user_id, CAST(b AS INTEGER) AS batch, CAST(n AS INTEGER) AS n FROM r WHERE shut OR i = m""",
    "session_prompts": f"""WITH {_T}, w AS (SELECT *, sum(length(text)) OVER (PARTITION BY session_id ORDER BY turn DESC) AS s, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS q FROM c WHERE k),
x AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS i FROM w WHERE s <= 800 OR q = 1)
SELECT session_id, count(*) AS n, md5(string_agg('[' || i || '] ' || lower(trim(role)) || ': ' || coalesce(text, ''), chr(10) ORDER BY i)) AS prompt_md5 FROM x GROUP BY 1""",
    "pruned_sessions": f"""WITH d AS (SELECT DISTINCT ON (session_id) * FROM inbox_meta), f AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, session_id DESC) AS r FROM d WHERE status IN ('done', 'failed'))
SELECT session_id, status FROM f WHERE r <= 50 OR created_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY""",
    "purged_pages": f"WITH {PAGES} SELECT schema_type, count(*) AS n FROM cp WHERE status <> 'archived' GROUP BY 1",
    "name_counts": f"WITH {RECORDS}, {_NAMES} SELECT brain_id, count(*) AS n, count(DISTINCT name) AS names FROM nm GROUP BY 1",
}
