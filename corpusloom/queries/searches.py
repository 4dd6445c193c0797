"""Keyword, vector, graph and fused searches over the whole tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vector as V
from corpusloom.operators import fusion as X
from corpusloom.operators import graph, indexing, keyword, semantic
from corpusloom.plans import search
from corpusloom.session import is_stored, shared_path, stored
from corpusloom.queries.common import BASE, FLAT, NOW, PAGES, PREFIX, RECORDS, WORDS, active, pages, records
from corpusloom.tables import table

QUERY = "retry queue"
#: A part of many names, and a word that many pages hold.
ENTITY = "data systems"
SIGNALS = "queue"
_INDEX: dict[tuple[str, str], str] = {}


def kw_search_topk(spark, d):
    return keyword.keyword_search(active(spark, d), QUERY).select("path", F.round("score", 6).alias("score"), F.array_join("evidence", ",").alias("evidence"), "snippet")


def kw_search_all(spark, d):
    """Every page that the query hits, not only the best."""
    return keyword.keyword_scores(active(spark, d), QUERY).select("path", F.round("score", 6).alias("score"))


def kw_search_zh(spark, d):
    return keyword.keyword_scores(active(spark, d), "重试队列").select("path", F.round("score", 6).alias("score"))


def kw_filters(spark, d):
    p = active(spark, d, brain_id="default", exclude_types=("lesson",), exclude_side_files=True, allowed_sources=("main", "wiki"))
    return keyword.keyword_search(p, "decision", 20).select("path", F.round("score", 6).alias("score"))


def _postings(spark, d) -> str:
    """Where the inverted index of the readable pages lies: written by the first query of a session that asks for it."""
    key = (spark.sparkContext.applicationId, d)
    if not is_stored(_INDEX.get(key, "")):
        _INDEX[key] = shared_path(spark)
        indexing.write_postings(active(spark, d), _INDEX[key])
    return _INDEX[key]


def indexed_search(spark, d):
    p = indexing.read_postings(spark, _postings(spark, d), keyword.query_words(QUERY))
    return keyword.indexed_search(p, QUERY, 20).select("path", F.round("score", 6).alias("score"))


def indexed_search_rare(spark, d):
    """Another query of the same session: it reads the index that is there."""
    p = indexing.read_postings(spark, _postings(spark, d), keyword.query_words(SIGNALS))
    return keyword.indexed_search(p, SIGNALS, 20).select("path", F.round("score", 6).alias("score"))


def expanded_search(spark, d):
    p, parts = stored(active(spark, d)), []
    for i, q in enumerate(keyword.expanded("why is the retry queue slow")):
        parts.append(keyword.keyword_scores(p, q).select(F.lit(i).alias("group"), "path", "score").orderBy(keyword.best_first("score"), "path").limit(30))
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    return keyword.merged_groups(every).select("path", F.round("rrf", 6).alias("rrf"))


def _vector(spark, d) -> list[float]:
    """The vector of the first usable chunk in order of ids: the question of the vector searches."""
    c = table(spark, d, "chunks").where((F.size("embedding") == 64) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)) & (V.norm(F.col("embedding")) > 0))
    return list(c.orderBy("id").select("embedding").first()[0])


def vector_topk(spark, d):
    return semantic.vector_search(table(spark, d, "chunks"), _vector(spark, d), 20, active(spark, d)).select("path", F.round("score", 5).alias("score"))


def vector_maxpool(spark, d):
    """The best similarity of every page to the question."""
    c = table(spark, d, "chunks").where("embedding is not null and path is not null")
    q = F.array(*[F.lit(float(x)) for x in _vector(spark, d)])
    return c.groupBy("path").agg(F.round(F.max(V.cosine(F.col("embedding"), q)), 5).alias("score"))


def label_search(spark, d):
    """For every vector with an id divisible by 50 its 10 most similar others."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return semantic.batch_vector_search(e.withColumnRenamed("vec_id", "path"), q).select("query_id", F.col("path").alias("vec_id"), F.round("score", 5).alias("score"), "rank")


def _start(spark, d) -> DataFrame:
    return graph.seeds(records(spark, d), table(spark, d, "links"), _QUESTION)


def graph_bfs(spark, d):
    """Everything within two steps of the most linked page."""
    links = table(spark, d, "links")
    top = graph.degree_table(links).where("in_links > 0").orderBy(F.desc("in_links"), "node").limit(1)
    return graph.within(links, top.select(F.col("node").alias("ref")))


def link_degrees(spark, d):
    return graph.degree_table(table(spark, d, "links"))


def orphans(spark, d):
    return graph.orphan_notes(active(spark, d), table(spark, d, "links"))


def _arms(spark, d, n: int = 30) -> DataFrame:
    p = active(spark, d)
    kw = keyword.keyword_scores(p, QUERY).orderBy(keyword.best_first("score"), "path").limit(n).select(F.lit("keyword").alias("arm"), "path", "score")
    near = graph.graph_search(p, table(spark, d, "links"), _start(spark, d), n)
    return kw.unionByName(near.select(F.lit("graph").alias("arm"), "path", "score"))


def rrf_fuse(spark, d):
    return X.fused(_arms(spark, d), opts=X.Options(fused_min=0.0)).select("path", F.round("keyword", 6).alias("keyword"), F.round("graph", 6).alias("graph"), F.round("score", 6).alias("score"))


def _hits(spark, d) -> DataFrame:
    """Every page that a search hits, with its score, so that the signals run over far more than a top-k."""
    p = active(spark, d)
    return keyword.keyword_scores(p, SIGNALS).select("path", "score").join(p.select("path", "title", "updated_at"), "path")


def hub_signal(spark, d):
    return X.hub_signal(_hits(spark, d), table(spark, d, "links").where("from_path is not null and to_ref is not null")).select("path", F.round("score", 6).alias("score"))


def cross_source_signal(spark, d):
    return X.cross_source_signal(_hits(spark, d), table(spark, d, "links").where("from_path is not null and to_ref is not null")).select("path", F.round("score", 6).alias("score"))


def diversify(spark, d):
    return X.diversified(_hits(spark, d)).select("path", F.round("score", 6).alias("score"))


def hotness(spark, d):
    return X.heated(_hits(spark, d), NOW).select("path", F.round("score", 6).alias("score"))


def directory_order(spark, d):
    h = _hits(spark, d).withColumn("dir", T.parent_dir(F.col("path")))
    return h.groupBy("dir").agg(F.round(F.sum("score"), 4).alias("dir_score"), F.count(F.lit(1)).alias("n"))


def local_rerank(spark, d):
    p = active(spark, d)
    return p.select("path", X.local_rerank(T.snippet(F.coalesce("body_text", F.lit("")), QUERY), F.col("title"), QUERY).alias("score"))


def entity_boost(spark, d):
    """Links that name a record of their brain boost the page they come from."""
    from corpusloom.operators.records import mentions

    links = table(spark, d, "links")
    m = mentions(links, records(spark, d)).select("id").join(links.select("id", F.col("from_path").alias("path")).dropDuplicates(["id"]), "id").where("path is not null")
    return X.entity_boost(m.select("path", F.lit("link").alias("kind"))).select("path", F.round("entity", 6).alias("entity"))


def hybrid_search(spark, d):
    p = stored(active(spark, d))  # five readers: written once, as an index would be
    h = search.hybrid_search(p, QUERY, NOW, chunks=table(spark, d, "chunks"), vector=_vector(spark, d), links=table(spark, d, "links"), start=_start(spark, d), entities=records(spark, d))
    return h.select("path", F.round("score", 6).alias("score"), F.round("keyword", 6).alias("keyword"), F.round("semantic", 6).alias("semantic"), F.round("graph", 6).alias("graph"), F.array_join("evidence", ",").alias("evidence"))


def think(spark, d):
    h = keyword.keyword_scores(active(spark, d), QUERY)
    return search.think(h)


def tie_order(spark, d):
    """The best 300 pages of a search; layers decide where scores tie."""
    top = _hits(spark, d).withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "path").limit(300)
    return X.layer_tie_order(top).select("path", "place")


def asked_entity_boost(spark, d):
    """Pages that link to, are, or name the entities of a question."""
    asked = X.asked_entities(records(spark, d), ENTITY)
    return X.entity_boost(X.entity_mentions(active(spark, d), table(spark, d, "links"), asked)).select("path", F.round("entity", 6).alias("entity"))


QUERIES = {
    f.__name__: f
    for f in (
        kw_search_topk, kw_search_all, kw_search_zh, kw_filters, indexed_search, indexed_search_rare, expanded_search, vector_topk, vector_maxpool, label_search, graph_bfs, link_degrees, orphans, rrf_fuse, hub_signal, cross_source_signal, diversify,
        hotness, directory_order, local_rerank, entity_boost, asked_entity_boost, hybrid_search, think, tie_order,
    )
}


def _rank(field: str, terms: list[str], to: str) -> str:
    """CTEs that end in ``to`` (path, r): word_rank of a field."""
    w = f"{to}_w AS (SELECT path, t.w, t.i FROM (SELECT path, {WORDS.format(f'coalesce({field}, chr(32))')} AS ws FROM src), LATERAL (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS i) t)"
    if len(terms) == 1:
        return f"""{w}, {to} AS (SELECT path, sum(0.1 / (j * j)) / 1.64493406685 AS r FROM (SELECT path, row_number() OVER (PARTITION BY path ORDER BY i) AS j FROM {to}_w WHERE w = '{terms[0]}') GROUP BY 1)"""
    near = " OR ".join(f"(a.w = '{x}' AND b.w = '{y}')" for i, x in enumerate(terms) for y in terms[i + 1 :])
    return f"""{w}, {to} AS (SELECT a.path, 1 - product(1 - sqrt(CAST(0.01 AS DOUBLE) * CASE WHEN abs(a.i - b.i) > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(abs(a.i - b.i) / CAST(1.5 AS DOUBLE) - 2)) END)) AS r
  FROM {to}_w a JOIN {to}_w b ON a.path = b.path AND ({near}) GROUP BY 1)"""


def _keyword(src: str, query: str, name: str = "kw", tag: str = "") -> str:
    """CTEs that end in ``name`` (path, score, …): keyword_scores of the pages of ``src``."""
    terms, grams, q = keyword.query_words(query), keyword.query_bigrams(query), query.lower()
    flat = lambda c: f"regexp_replace(lower(coalesce({c}, '')), '\\s+', '', 'g')"
    g = lambda c: " AND ".join(f"contains({flat(c)}, '{x}')" for x in grams)
    body = _rank("body_text", terms, f"rb{tag}").replace("FROM src", f"FROM {src}")
    title = _rank("title", terms, f"rt{tag}").replace("FROM src", f"FROM {src}")
    return f"""{title}, {body}, {name}0 AS (
  SELECT p.path, p.title, p.body_text, coalesce(rt{tag}.r, 0) AS t, coalesce(rb{tag}.r, 0) AS b, CASE WHEN {g('p.title')} THEN 0.1 / 1.64493406685 ELSE 0 END AS tn, CASE WHEN {g('p.body_text')} THEN 0.1 / 1.64493406685 ELSE 0 END AS bn,
    contains(lower(coalesce(p.title, '')), '{q}') AS it, contains(lower(p.path), '{q}') AS ip, coalesce(list_bool_or(list_transform(p.aliases, lambda a: contains(lower(a), '{q}'))), false) AS ia
  FROM {src} p LEFT JOIN rt{tag} ON rt{tag}.path = p.path LEFT JOIN rb{tag} ON rb{tag}.path = p.path),
{name} AS (SELECT *, 3.0 * t + b + 2.0 * tn + CAST(0.8 AS DOUBLE) * bn + CASE WHEN it THEN 2.5 ELSE 0 END + CASE WHEN ip THEN 1.5 ELSE 0 END + CASE WHEN ia THEN 3.0 ELSE 0 END AS score FROM {name}0
  WHERE t + b + tn + bn > 0 OR it OR ip OR ia)"""


_HITS = f"{PAGES}, {_keyword('ap', SIGNALS)}, h AS (SELECT ap.path, ap.title, updated_at, score FROM kw JOIN ap ON ap.path = kw.path), l AS (SELECT * FROM links WHERE from_path IS NOT NULL AND to_ref IS NOT NULL)"
_Q = """q AS (SELECT embedding::DOUBLE[] AS v FROM (SELECT id, embedding FROM chunks WHERE len(embedding) = 64) WHERE NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x))) AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0 ORDER BY id LIMIT 1),
good AS (SELECT path, embedding::DOUBLE[] AS e FROM (SELECT path, embedding FROM chunks WHERE len(embedding) = 64) WHERE NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x))) AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
s AS (SELECT path, list_inner_product(e, v) / sqrt(list_inner_product(e, e) * list_inner_product(v, v)) AS c FROM good, q)"""
_SNIP = f"""CASE WHEN a > 1 THEN '…' ELSE '' END || substr(f, a, 160) || CASE WHEN a - 1 + 160 < length(f) THEN '…' ELSE '' END"""
_RERANK = "(CASE WHEN contains(x, '{q}') THEN 3.0 ELSE 0 END + CASE WHEN contains(lower(coalesce(title, '')), '{q}') THEN 2.0 ELSE 0 END + {g})"


def _rerank(q: str) -> str:
    """Of columns title and x, which is title and snippet in lower case."""
    flat = q.replace(" ", "")
    return _RERANK.format(q=q, g=" + ".join(f"CASE WHEN contains(x, '{flat[i : i + 2]}') THEN 0.5 ELSE 0 END" for i in range(len(flat) - 1)))


def _expanded() -> str:
    forms = keyword.expanded("why is the retry queue slow")
    parts = ", ".join(_keyword("ap", q, f"k{i}_", f"x{i}") for i, q in enumerate(forms))
    ranks = " UNION ALL ".join(f"SELECT path, row_number() OVER (ORDER BY round(score, 9) DESC, path) AS r FROM (SELECT path, score FROM k{i}_ ORDER BY round(score, 9) DESC, path LIMIT 30)" for i in range(len(forms)))
    return f"WITH {PAGES}, {parts}, u AS ({ranks}) SELECT path, round(sum(1 / CAST(60 + r AS DOUBLE)), 6) AS rrf FROM u GROUP BY 1"


_QUESTION = "what about Oona Peldosen, Kallavas, Norvidan, Corvagard and the link extractor"
_NEEDLE = "n NOT IN (" + ", ".join(f"'{w}'" for w in graph.STOP_WORDS) + r") AND CASE WHEN regexp_matches(n, '\p{Han}') THEN length(n) >= 2 AND contains(q, n) ELSE regexp_matches(n, '^[a-z0-9]{3,}$') AND list_contains(regexp_split_to_array(q, '[^a-z0-9_]+'), n) END"
_SEEDS = f"""qq AS (SELECT lower('{_QUESTION}') AS q),
cand AS (SELECT DISTINCT slug AS ref, lower(trim(x)) AS n FROM (SELECT slug, unnest(list_concat([slug, title], coalesce(CASE WHEN json_valid(aliases_json) THEN from_json(aliases_json, '["VARCHAR"]') END, []))) AS x FROM rec WHERE status = 'active')
  UNION SELECT DISTINCT to_ref, lower(trim(to_ref)) FROM links WHERE to_ref IS NOT NULL),
seed AS (SELECT DISTINCT ref FROM cand, qq WHERE {_NEEDLE} ORDER BY ref LIMIT 8)"""
#: CTEs that end in near (path, depth): pages within two steps of those that name a seed.
_NEAR = f"""{_SEEDS}, lk AS (SELECT from_path, to_ref FROM links WHERE from_path IS NOT NULL AND to_ref IS NOT NULL),
hit AS (SELECT from_path, to_ref FROM lk, seed WHERE contains(lower(to_ref), lower(ref)) OR contains(lower(from_path), lower(ref))),
fr AS (SELECT from_path AS node FROM hit UNION SELECT to_ref FROM hit WHERE contains(to_ref, '/')
  UNION SELECT path FROM (SELECT path, row_number() OVER (PARTITION BY lower(ref) ORDER BY path) AS r FROM ap, seed WHERE contains(lower(coalesce(title, '')), lower(ref)) OR contains(lower(path), lower(ref))) WHERE r <= 20),
e AS (SELECT * FROM (SELECT from_path AS a, to_ref AS b FROM lk UNION SELECT to_ref, from_path FROM lk) WHERE contains(b, '/') OR ends_with(b, '.md')),
n1 AS (SELECT DISTINCT b AS node FROM e WHERE a IN (SELECT node FROM fr) AND b NOT IN (SELECT node FROM fr)), n2 AS (SELECT DISTINCT b AS node FROM e WHERE a IN (SELECT node FROM n1) AND b NOT IN (SELECT node FROM fr) AND b NOT IN (SELECT node FROM n1)),
near AS (SELECT node AS path, 0 AS depth FROM fr UNION ALL SELECT node, 1 FROM n1 UNION ALL SELECT node, 2 FROM n2)"""
#: CTEs that end in eb (path, entity): what the entities of a question are worth to pages.
_ENTITY = """ae AS (SELECT brain_id, coalesce(nullif(canonical_slug, ''), slug) AS slug, title FROM rec WHERE coalesce(status, '') <> 'merged' AND (contains(lower(slug), '{q}') OR contains(lower(coalesce(title, '')), '{q}') OR contains(lower(coalesce(aliases_json, '')), '{q}')) ORDER BY 1, 2, 3 LIMIT 20),
em AS (SELECT DISTINCT from_path AS path, lower(slug) AS s, lower(coalesce(title, slug)) AS t, 0.5::DOUBLE AS w FROM links JOIN ae ON ae.brain_id = links.brain_id AND lower(to_ref) = lower(slug) WHERE from_path IS NOT NULL),
en AS (SELECT path, row_number() OVER (PARTITION BY ap.brain_id, lower(slug), lower(coalesce(ae.title, slug)) ORDER BY path) AS r FROM ap JOIN ae ON ae.brain_id = ap.brain_id
  AND (contains(lower(concat_ws(chr(10), ap.title, body_text)), lower(slug)) OR contains(lower(concat_ws(chr(10), ap.title, body_text)), lower(coalesce(ae.title, slug))))),
eb AS (SELECT path, least(1, sum(w)) AS entity FROM (SELECT path, w FROM em UNION ALL SELECT 'brains/' || brain_id || '/entities/' || slug || '.md', 0.8::DOUBLE FROM ae UNION ALL SELECT path, 0.45::DOUBLE FROM en WHERE r <= 50) GROUP BY 1)"""
_HYBRID = f"""WITH {PAGES}, {RECORDS}, {_keyword('ap', QUERY)}, {_Q}, {_NEAR}, {_ENTITY.format(q=QUERY)},
arm AS (SELECT 'keyword' AS arm, path, row_number() OVER (ORDER BY round(score, 9) DESC, path) AS r, NULL AS c FROM kw QUALIFY r <= 30
  UNION ALL SELECT 'semantic', path, row_number() OVER (ORDER BY max(c) DESC, path) AS r, max(c) FROM s WHERE path IN (SELECT path FROM ap) GROUP BY path QUALIFY r <= 30
  UNION ALL SELECT 'graph', path, row_number() OVER (ORDER BY depth, path) AS r, NULL FROM near WHERE path IN (SELECT path FROM ap) QUALIFY r <= 30),
w AS (SELECT path, coalesce(max(61 / CAST(60 + r AS DOUBLE)) FILTER (arm = 'keyword' AND r <= 27), 0) AS k, coalesce(max(61 / CAST(60 + r AS DOUBLE)) FILTER (arm = 'semantic' AND r <= 27), 0) AS m,
  coalesce(max(61 / CAST(60 + r AS DOUBLE)) FILTER (arm = 'graph' AND r <= 27), 0) AS g, max(c) AS cos FROM arm GROUP BY 1),
w2 AS (SELECT w.*, CASE WHEN contains(lower(coalesce(title, '')), '{QUERY}') THEN 0.7::DOUBLE ELSE 0 END + CASE WHEN contains(lower(path), '{QUERY}') THEN 0.3::DOUBLE ELSE 0 END AS tp, coalesce(entity, 0) AS en, updated_at FROM w JOIN ap USING (path) LEFT JOIN eb USING (path)),
f AS (SELECT *, 0.35::DOUBLE * k + 0.2::DOUBLE * m + 0.2::DOUBLE * g + 0.1::DOUBLE * tp + 0.15::DOUBLE * en AS s,
  array_to_string(list_sort(list_filter([CASE WHEN k > 0 THEN 'keyword' END, CASE WHEN m > 0 THEN 'semantic' END, CASE WHEN g > 0 THEN 'graph' END, CASE WHEN en > 0 THEN 'entity' END, CASE WHEN tp >= 0.7 THEN 'title' WHEN tp > 0 THEN 'path' END], lambda x: x IS NOT NULL)), ',') AS evidence FROM w2),
h AS (SELECT *, 0.7::DOUBLE * s + 0.3::DOUBLE * greatest(0, coalesce(cos, 0)) AS s1 FROM f WHERE s >= 0.05),
hi AS (SELECT from_path, to_ref FROM links WHERE from_path IN (SELECT path FROM h) AND to_ref IN (SELECT path FROM h)), hd AS (SELECT path, count(*) AS d FROM (SELECT from_path AS path FROM hi UNION ALL SELECT to_ref FROM hi) GROUP BY 1),
hn AS (SELECT path, path AS ref FROM h UNION ALL SELECT path, {BASE.format('path')} FROM h), hx AS (SELECT hn.path, count(DISTINCT l.source) AS k, count(DISTINCT {PREFIX.format('l.from_path')}) AS p FROM links l JOIN hn ON l.to_ref = hn.ref GROUP BY 1),
h2 AS (SELECT h.*, s1 * CASE WHEN d >= 2 THEN 1.05::DOUBLE ELSE 1 END * CASE WHEN hx.k >= 2 OR hx.p >= 2 THEN 1.1::DOUBLE ELSE 1 END AS s2 FROM h LEFT JOIN hd USING (path) LEFT JOIN hx USING (path)),
h3 AS (SELECT *, s2 * CASE WHEN row_number() OVER (PARTITION BY {PREFIX.format('path')} ORDER BY s2 DESC, path) > 1 THEN 0.95::DOUBLE ELSE 1 END AS s3 FROM h2),
h4 AS (SELECT *, s3 * (1 + 0.15::DOUBLE * CASE WHEN updated_at IS NULL THEN 0.5::DOUBLE ELSE exp(-ln(2) * greatest(0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(updated_at)) / 86400000000.0::DOUBLE) / 30) END) AS score FROM h3)
SELECT path, round(score, 6) AS score, round(k, 6) AS keyword, round(m, 6) AS semantic, round(g, 6) AS graph, evidence FROM h4 ORDER BY score DESC, path LIMIT 10"""

SQL = {
    "expanded_search": _expanded(),
    "hybrid_search": _HYBRID,
    "kw_search_all": f"WITH {PAGES}, {_keyword('ap', QUERY)} SELECT path, round(score, 6) AS score FROM kw",
    "kw_search_zh": f"WITH {PAGES}, {_keyword('ap', '重试队列')} SELECT path, round(score, 6) AS score FROM kw",
    "kw_search_topk": rf"""WITH {PAGES}, {_keyword('ap', QUERY)}, top AS (SELECT * FROM kw ORDER BY round(score, 9) DESC, path LIMIT 10),
f AS (SELECT top.*, trim(regexp_replace(coalesce(json_extract_string(ap.frontmatter_json, '$.abstract'), ap.body_text), '[\s\p{{Z}}]+', ' ', 'g')) AS f FROM top JOIN ap USING (path)),
n AS (SELECT *, CASE WHEN instr(lower(f), '{QUERY}') > 40 THEN instr(lower(f), '{QUERY}') - 40 ELSE 1 END AS a FROM f)
SELECT path, round(score, 6) AS score, array_to_string(list_filter([CASE WHEN t + b + tn + bn > 0 THEN 'keyword' END, CASE WHEN it THEN 'title' END, CASE WHEN ip THEN 'path' END, CASE WHEN ia THEN 'alias' END], lambda x: x IS NOT NULL), ',') AS evidence, {_SNIP} AS snippet FROM n""",
    "kw_filters": f"""WITH {PAGES}, fp AS (SELECT * FROM ap WHERE brain_id = 'default' AND schema_type NOT IN ('lesson') AND NOT ends_with(path, '.overview.md') AND NOT ends_with(path, '.abstract.md')
  AND (source_id IN ('main', 'wiki') OR regexp_matches(path, '/(experiences|skills)/'))), {_keyword('fp', 'decision')} SELECT path, round(score, 6) AS score FROM kw ORDER BY round(score, 9) DESC, path LIMIT 20""",
    "indexed_search_rare": f"""WITH {PAGES}, {_rank('title', keyword.query_words(SIGNALS), 'rt').replace('FROM src', 'FROM ap')}, {_rank('body_text', keyword.query_words(SIGNALS), 'rb').replace('FROM src', 'FROM ap')},
u AS (SELECT path, 3.0 * r AS r FROM rt UNION ALL SELECT path, r FROM rb)
SELECT path, round(score, 6) AS score FROM (SELECT path, sum(r) AS score FROM u GROUP BY 1) WHERE score > 0 ORDER BY round(score, 9) DESC, path LIMIT 20""",
    "indexed_search": f"""WITH {PAGES}, {_rank('title', keyword.query_words(QUERY), 'rt').replace('FROM src', 'FROM ap')}, {_rank('body_text', keyword.query_words(QUERY), 'rb').replace('FROM src', 'FROM ap')},
u AS (SELECT path, 3.0 * r AS r FROM rt UNION ALL SELECT path, r FROM rb)
SELECT path, round(score, 6) AS score FROM (SELECT path, sum(r) AS score FROM u GROUP BY 1) WHERE score > 0 ORDER BY round(score, 9) DESC, path LIMIT 20""",
    "vector_topk": f"WITH {PAGES}, {_Q} SELECT path, round(max(c), 5) AS score FROM s WHERE path IN (SELECT path FROM ap) GROUP BY 1 ORDER BY max(c) DESC, path LIMIT 20",
    "vector_maxpool": f"""WITH {_Q}, every AS (SELECT path, NULL AS c FROM chunks WHERE embedding IS NOT NULL), m AS (SELECT path, c FROM s UNION ALL SELECT path, 0 FROM (SELECT path FROM chunks WHERE embedding IS NOT NULL AND
  (len(embedding) <> 64 OR coalesce(list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x))), true) OR list_sum(list_transform(embedding, lambda x: abs(x))) = 0)))
SELECT path, round(max(c), 5) AS score FROM m WHERE path IS NOT NULL GROUP BY 1""",
    "label_search": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v) / sqrt(list_inner_product(q.v, q.v) * list_inner_product(e.v, e.v)) AS c
  FROM e, e q WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(c, 5) AS score, rank FROM r WHERE rank <= 10""",
    "graph_bfs": """WITH l AS (SELECT from_path AS f, to_ref AS t FROM links), top AS (SELECT t AS node FROM l WHERE t IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, t LIMIT 1),
e AS (SELECT f AS a, t AS b FROM l WHERE f IS NOT NULL AND t IS NOT NULL UNION SELECT t, f FROM l WHERE f IS NOT NULL AND t IS NOT NULL),
one AS (SELECT DISTINCT b AS node FROM e WHERE a IN (SELECT node FROM top)), two AS (SELECT DISTINCT b AS node FROM e WHERE a IN (SELECT node FROM one)),
u AS (SELECT node, 0 AS depth FROM top UNION ALL SELECT node, 1 FROM one UNION ALL SELECT node, 2 FROM two) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM u GROUP BY 1""",
    "link_degrees": """WITH u AS (SELECT to_ref AS node, 1 AS i, 0 AS o, source FROM links WHERE to_ref IS NOT NULL UNION ALL SELECT from_path, 0, 1, NULL FROM links WHERE from_path IS NOT NULL)
SELECT node, CAST(sum(i) AS BIGINT) AS in_links, CAST(sum(o) AS BIGINT) AS out_links, CAST(count(DISTINCT source) AS INTEGER) AS source_kinds FROM u GROUP BY 1""",
    "orphans": f"""WITH {PAGES}, t AS (SELECT DISTINCT brain_id, to_ref FROM links WHERE to_ref IS NOT NULL AND brain_id IS NOT NULL)
SELECT path, coalesce(json_extract_string(frontmatter_json, '$.temporary') = 'true', false) OR coalesce(json_extract_string(frontmatter_json, '$.ephemeral') = 'true', false)
    OR coalesce(list_has_any(list_transform(from_json(json_extract(frontmatter_json, '$.tags'), '["VARCHAR"]'), lambda x: lower(x)), ['temporary', 'tmp', 'ephemeral']), false) AS temporary
FROM ap WHERE path NOT IN (SELECT from_path FROM links WHERE from_path IS NOT NULL) AND (brain_id, path) NOT IN (SELECT brain_id, to_ref FROM t)
  AND (brain_id, regexp_replace(path, '^.*/', '')) NOT IN (SELECT brain_id, regexp_replace(to_ref, '^.*/', '') FROM t WHERE contains(to_ref, '/'))""",
    "asked_entity_boost": f"WITH {PAGES}, {RECORDS}, {_ENTITY.format(q=ENTITY)} SELECT path, round(entity, 6) AS entity FROM eb",
    "rrf_fuse": f"""WITH {PAGES}, {RECORDS}, {_keyword('ap', QUERY)}, {_NEAR}, a AS (
  SELECT * FROM (SELECT 'keyword' AS arm, path, score FROM kw ORDER BY round(score, 9) DESC, path LIMIT 30) UNION ALL
  SELECT * FROM (SELECT 'graph' AS arm, path, -row_number() OVER (ORDER BY depth, path) AS score FROM near WHERE path IN (SELECT path FROM ap) ORDER BY depth, path LIMIT 30)),
r AS (SELECT arm, path, 61 / CAST(60 + row_number() OVER (PARTITION BY arm ORDER BY round(score, 9) DESC, path) AS DOUBLE) AS s FROM a),
w AS (SELECT path, coalesce(max(s) FILTER (arm = 'keyword' AND s >= 0.7), 0) AS k, coalesce(max(s) FILTER (arm = 'graph' AND s >= 0.7), 0) AS g FROM r GROUP BY 1)
SELECT path, round(k, 6) AS keyword, round(g, 6) AS graph, round(CAST(0.35 AS DOUBLE) * k + CAST(0.2 AS DOUBLE) * g, 6) AS score FROM w""",
    "hub_signal": f"""WITH {_HITS}, i AS (SELECT from_path, to_ref FROM l WHERE from_path IN (SELECT path FROM h) AND to_ref IN (SELECT path FROM h)),
d AS (SELECT path, count(*) AS d FROM (SELECT from_path AS path FROM i UNION ALL SELECT to_ref FROM i) GROUP BY 1)
SELECT path, round(score * CASE WHEN d >= 2 THEN CAST(1.05 AS DOUBLE) ELSE 1 END, 6) AS score FROM h LEFT JOIN d USING (path)""",
    "cross_source_signal": f"""WITH {_HITS}, n AS (SELECT path, path AS r FROM h UNION ALL SELECT path, {BASE.format('path')} FROM h),
x AS (SELECT n.path, count(DISTINCT l.source) AS k, count(DISTINCT {PREFIX.format('l.from_path')}) AS p FROM l JOIN n ON l.to_ref = n.r GROUP BY 1)
SELECT path, round(score * CASE WHEN k >= 2 OR p >= 2 THEN CAST(1.1 AS DOUBLE) ELSE 1 END, 6) AS score FROM h LEFT JOIN x USING (path)""",
    "diversify": f"""WITH {_HITS} SELECT path, round(score * CASE WHEN row_number() OVER (PARTITION BY {PREFIX.format('path')} ORDER BY score DESC, path) > 1 THEN CAST(0.95 AS DOUBLE) ELSE 1 END, 6) AS score FROM h""",
    "hotness": f"""WITH {_HITS} SELECT path, round(score * (1 + CAST(0.15 AS DOUBLE) * CASE WHEN updated_at IS NULL THEN CAST(0.5 AS DOUBLE) ELSE exp(-ln(2) * greatest(0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(updated_at)) / 86400000000.0::DOUBLE) / 30) END), 6) AS score FROM h""",
    "directory_order": f"WITH {_HITS} SELECT regexp_replace(path, '/[^/]*$', '') AS dir, round(sum(score), 4) AS dir_score, count(*) AS n FROM h GROUP BY 1",
    "local_rerank": f"""WITH {PAGES}, t AS (SELECT path, title, {FLAT.format("coalesce(body_text, '')")} AS f FROM ap), n AS (SELECT *, CASE WHEN instr(lower(f), '{QUERY}') > 40 THEN instr(lower(f), '{QUERY}') - 40 ELSE 1 END AS a FROM t),
s AS (SELECT path, title, lower(coalesce(title, '')) || ' ' || lower({_SNIP}) AS x FROM n) SELECT path, CAST({_rerank(QUERY)} AS DOUBLE) AS score FROM s""",
    "entity_boost": rf"""WITH {RECORDS}, nm AS (SELECT brain_id, lower(trim(x)) AS name, min(slug) AS slug FROM (
  SELECT brain_id, slug, unnest(list_concat([slug, title], coalesce(CASE WHEN json_valid(aliases_json) THEN from_json(aliases_json, '["VARCHAR"]') END, []))) AS x FROM rec) WHERE trim(x) <> '' GROUP BY 1, 2),
b AS (SELECT DISTINCT id, brain_id, lower(trim(to_ref)) AS name FROM links WHERE to_ref IS NOT NULL AND NOT contains(to_ref, '/') AND NOT contains(to_ref, chr(92))),
m AS (SELECT DISTINCT id, l.from_path AS path FROM b JOIN nm USING (brain_id, name) JOIN links l USING (id) WHERE l.from_path IS NOT NULL)
SELECT path, round(least(1.0, count(*) * 0.5), 6)::DOUBLE AS entity FROM m GROUP BY 1""",
    "think": f"""WITH {PAGES}, {_keyword('ap', QUERY)}, b AS (SELECT *, CASE WHEN contains(path, '/skills/') THEN 'skills' WHEN contains(path, '/experiences/') THEN 'experiences' ELSE 'notes' END AS bucket FROM kw)
SELECT bucket, count(*) AS n, first(path ORDER BY round(score, 9) DESC, path) AS best FROM b GROUP BY 1""",
}
