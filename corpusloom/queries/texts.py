"""Scalar text operators, chunks, postings and validation over the whole tables."""

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vector as V
from corpusloom.operators import indexing, linking, maintenance
from corpusloom.operators import pages as P
from corpusloom.queries.common import BASE, FLAT, PAGES, PARENT, WORDS, pages
from corpusloom.tables import table

TYPES = ("note", "decision", "lesson", "experience", "skill", "meeting")


def bigram_tokens(spark, d):
    g = table(spark, d, "documents").select(F.explode(T.bigrams(F.lower(F.coalesce("title", F.lit(""))))).alias("gram"))
    return g.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def text_bigram_tokens(spark, d):
    """The same over whole texts: counted before the shuffle."""
    g = table(spark, d, "documents").select(F.explode(T.bigrams(F.lower(F.coalesce("text", F.lit(""))))).alias("gram"))
    return g.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def snippets(spark, d):
    return pages(spark, d).select("path", T.snippet(F.col("body_text"), "queue").alias("snippet"))


def slug_paths(spark, d):
    return pages(spark, d).select("path", T.slug(F.coalesce("title", F.lit(""))).alias("slug"), T.parent_dir(F.col("path")).alias("dir"), T.basename(F.col("path")).alias("name"), T.bucket(F.col("path")).alias("bucket"))


def new_paths(spark, d):
    p = pages(spark, d)
    asked = p.select(T.parent_dir(F.col("path")).alias("folder"), F.coalesce("title", F.lit("")).alias("title"), F.col("path").alias("seq"))
    return P.new_paths(asked, p).select(F.col("seq").alias("old_path"), "path")


def content_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_hash(F.coalesce("text", F.lit("")), title=F.coalesce("title", F.lit("")), type=F.coalesce("schema_type", F.lit(""))).alias("hash"))


def chunk_text(spark, d):
    c = indexing.chunk_table(table(spark, d, "documents").where("text is not null"), "text", "doc_id")
    return c.select("id", "doc_id", "chunk_index", F.md5("text").alias("text_md5"), F.length("text").alias("n"))


def term_statistics(spark, d):
    return indexing.term_statistics(pages(spark, d).where("body_text is not null"))


def postings_sizes(spark, d):
    p = indexing.postings(pages(spark, d))
    return p.groupBy("brain_id", "field").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("positions")).cast("long").alias("n_positions"), F.count_distinct("term").alias("n_terms"))


def hash_embedding(spark, d):
    p = pages(spark, d)
    v = V.hash_embedding(T.letter_pairs(F.coalesce("title", F.lit(""))), 32)
    return p.select("path", F.transform(v, lambda x: F.round(x.cast("double"), 4)).alias("vector"))


def text_hash_embedding(spark, d):
    """The vector of every chunk's whole text, of the size of the given vectors."""
    v = V.hash_embedding(T.letter_pairs(F.coalesce("text", F.lit(""))), 64)
    return table(spark, d, "chunks").select("id", F.transform(v, lambda x: F.round(x.cast("double"), 4)).alias("vector"))


def wikilinks(spark, d):
    return linking.wikilinks(pages(spark, d).where("body_text is not null"))


def extracted_links(spark, d):
    return linking.extract_links(pages(spark, d))


def page_issues(spark, d):
    return P.issues(table(spark, d, "pages"), TYPES).select(F.explode("issues").alias("i")).groupBy("i.field", "i.message").agg(F.count(F.lit(1)).alias("n"))


def layers(spark, d):
    return P.layered(pages(spark, d)).select("path", "l0", F.length("l1").alias("l1_chars"), F.length("l2").alias("l2_chars"))


def directory_tree(spark, d):
    return P.directory_tree(pages(spark, d))


def directory_overviews(spark, d):
    return P.directory_overviews(pages(spark, d))


def lint(spark, d):
    return maintenance.lint_summary(pages(spark, d)).select("issue", "n", F.array_join("sample", "\n").alias("sample"))


def exact_copies(spark, d):
    return maintenance.exact_copies(table(spark, d, "documents"))


def page_facts(spark, d):
    f = maintenance.facts(table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("path"), F.col("text").alias("body_text")))
    return f.groupBy("path").agg(F.count(F.lit(1)).alias("n_facts"), F.min("text").alias("least"))


def sourced_facts(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("path"), F.col("text").alias("body_text"))
    return maintenance.sourced_facts(docs).select("path", F.md5("text").alias("text_md5"))


def repeated_facts(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("path"), F.col("text").alias("body_text"))
    return maintenance.repeated_facts(docs)


def contradicting_numbers(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("path"), F.col("text").alias("body_text"))
    return maintenance.contradicting_numbers(docs)


def fact_pairs(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("path"), F.col("text").alias("body_text"))
    return maintenance.pairs_of_facts(maintenance.facts(docs)).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def token_estimates(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    return t.groupBy("source").agg(F.sum(T.estimated_tokens(F.col("text"))).cast("long").alias("tokens"), F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        bigram_tokens, text_bigram_tokens, snippets, slug_paths, new_paths, content_hashes, chunk_text, term_statistics, postings_sizes, hash_embedding, text_hash_embedding, wikilinks, extracted_links, page_issues, layers, directory_tree, directory_overviews, lint,
        exact_copies, page_facts, sourced_facts, repeated_facts, contradicting_numbers, fact_pairs, token_estimates,
    )
}

_SLUG = r"""CASE WHEN s2 = '' THEN 'untitled' ELSE s2 END"""
_SLUGGED = rf"""SELECT *, regexp_replace(substr(trim(regexp_replace(lower(trim(coalesce(title, ''))), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '-'), 1, 64), '-+$', '') AS s2 FROM cp"""
_FACTS = r"""f AS (SELECT doc_id AS path, list_distinct(list_filter(list_transform(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)),
    lambda x: trim(regexp_extract(x, '^\s*(?:[-*]|##|[0-9]+\.)\s+(.*)$', 1))), lambda x: x NOT IN ('', '摘要', '正文'))) AS fs FROM documents WHERE text IS NOT NULL)"""
SQL = {
    "bigram_tokens": r"""WITH t AS (SELECT regexp_replace(lower(coalesce(title, '')), '\s+', '', 'g') AS t FROM documents),
g AS (SELECT unnest(CASE WHEN length(t) = 0 THEN CAST([] AS VARCHAR[]) WHEN length(t) = 1 THEN [t] ELSE list_transform(range(1, length(t)), lambda i: substr(t, i, 2)) END) AS gram FROM t)
SELECT gram, count(*) AS n FROM g GROUP BY 1""",
    "snippets": f"""WITH {PAGES}, t AS (SELECT path, {FLAT.format('body_text')} AS t FROM cp),
s AS (SELECT *, CASE WHEN instr(lower(t), 'queue') > 40 THEN instr(lower(t), 'queue') - 40 ELSE 1 END AS a FROM t)
SELECT path, CASE WHEN a > 1 THEN '…' ELSE '' END || substr(t, a, 160) || CASE WHEN a - 1 + 160 < length(t) THEN '…' ELSE '' END AS snippet FROM s""",
    "slug_paths": f"""WITH {PAGES}, s AS ({_SLUGGED})
SELECT path, {_SLUG} AS slug, {PARENT.format('path')} AS dir, {BASE.format('path')} AS name,
  CASE WHEN contains(path, '/skills/') THEN 'skills' WHEN contains(path, '/experiences/') THEN 'experiences' ELSE 'notes' END AS bucket FROM s""",
    "new_paths": rf"""WITH {PAGES}, s AS ({_SLUGGED}), b AS (SELECT path, {PARENT.format('path')} || '/' || {_SLUG} AS base FROM s),
t AS (SELECT regexp_replace(path, '(-[0-9]+)?\.md$', '') AS base, count(*) AS taken FROM cp GROUP BY 1),
n AS (SELECT b.path AS old_path, b.base, row_number() OVER (PARTITION BY b.base ORDER BY b.path) + coalesce(taken, 0) AS n FROM b LEFT JOIN t USING (base))
SELECT old_path, base || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.md' AS path FROM n""",
    "term_statistics": f"""WITH {PAGES}, w AS (SELECT path, unnest({WORDS.format('body_text')}) AS term FROM cp)
SELECT term, count(DISTINCT path) AS n_pages, count(*) AS n_occurrences FROM w GROUP BY 1""",
    "postings_sizes": f"""WITH {PAGES}, w AS (
  SELECT brain_id, path, 'title' AS field, unnest({WORDS.format("coalesce(title, '')")}) AS term FROM cp
  UNION ALL SELECT brain_id, path, 'body_text', unnest({WORDS.format("coalesce(body_text, '')")}) FROM cp)
SELECT brain_id, field, count(DISTINCT (term, path)) AS n, count(*) AS n_positions, count(DISTINCT term) AS n_terms FROM w GROUP BY 1, 2""",
    "hash_embedding": rf"""WITH {PAGES}, t AS (SELECT path, coalesce(title, '') AS t FROM cp),
g AS (SELECT path, unnest(CASE WHEN length(t) = 1 THEN [t] ELSE list_transform(range(1, length(t)), lambda i: substr(t, i, 2)) END) AS g FROM t WHERE t <> ''),
x AS (SELECT path, g, (xor(2166136261, CAST(ord(g) AS BIGINT)) * 16777619) & 4294967295 AS a FROM g), h AS (SELECT path, g, CASE WHEN length(g) = 2 THEN (xor(a, CAST(ord(substr(g, 2, 1)) AS BIGINT)) * 16777619) & 4294967295 ELSE a END AS h FROM x),
s AS (SELECT path, h % 32 AS i, CAST(sum(CASE WHEN h % 2 = 0 OR length(g) = 1 THEN 1 ELSE -1 END) AS DOUBLE) AS s FROM h GROUP BY 1, 2), n AS (SELECT path, sqrt(sum(s * s)) AS n FROM s GROUP BY 1),
e AS (SELECT cp.path, r.range AS i FROM cp, range(32) r)
SELECT e.path, list(round(CASE WHEN n > 0 THEN CAST(coalesce(s, 0) / n AS FLOAT)::DOUBLE ELSE 0 END, 4) ORDER BY e.i) AS vector FROM e LEFT JOIN s ON s.path = e.path AND s.i = e.i LEFT JOIN n ON n.path = e.path GROUP BY 1""",
    "wikilinks": rf"""WITH {PAGES} SELECT DISTINCT path, unnest(regexp_extract_all(body_text, '\[\[([^\]|\n]+)\]\]', 1)) AS to_ref FROM cp WHERE body_text IS NOT NULL""",
    "chunk_text": r"""WITH t AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n{2,}'), lambda p: trim(p, ' ' || chr(9) || chr(13) || chr(10))), lambda p: p <> '') AS ps FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, list_reduce(list_transform(ps, lambda p: {'done': CAST([] AS VARCHAR[]), 'open': p}), lambda a, x: CASE
    WHEN a.open <> '' AND length(a.open) + length(x.open) + 2 <= 800 THEN {'done': a.done, 'open': a.open || chr(10) || chr(10) || x.open}
    WHEN length(x.open) <= 800 THEN {'done': CASE WHEN a.open = '' THEN a.done ELSE list_append(a.done, a.open) END, 'open': x.open}
    ELSE {'done': list_concat(CASE WHEN a.open = '' THEN a.done ELSE list_append(a.done, a.open) END, list_transform(range(0, (length(x.open) - 1) // 800), lambda i: substr(x.open, i * 800 + 1, 800))),
      'open': substr(x.open, (length(x.open) - 1) // 800 * 800 + 1, 800)} END, {'done': CAST([] AS VARCHAR[]), 'open': ''}) AS a FROM t WHERE len(ps) > 0),
c AS (SELECT doc_id, unnest(list_append(a.done, a.open)) AS x, generate_subscripts(list_append(a.done, a.open), 1) - 1 AS i FROM r)
SELECT doc_id || '#' || i AS id, doc_id, CAST(i AS INTEGER) AS chunk_index, md5(x) AS text_md5, CAST(length(x) AS INTEGER) AS n FROM c""",
    "layers": rf"""WITH {PAGES}, s AS (SELECT regexp_replace(path, '\.overview\.md$', '.md') AS path, body_text AS side FROM cp WHERE ends_with(path, '.overview.md')),
o AS (SELECT * FROM cp WHERE NOT regexp_matches(path, '(^|/)_overview\.md$|\.overview\.md$|\.abstract\.md$'))
SELECT o.path, coalesce(nullif(trim(json_extract_string(frontmatter_json, '$.abstract')), ''), substr({FLAT.format('body_text')}, 1, 100)) AS l0,
  CAST(CASE WHEN side IS NOT NULL THEN length(side) WHEN length(trim(body_text)) > 4000 THEN 4001 ELSE length(trim(body_text)) END AS INTEGER) AS l1_chars, CAST(length(body_text) AS INTEGER) AS l2_chars FROM o LEFT JOIN s ON s.path = o.path""",
    "page_issues": r"""WITH i AS (
  SELECT 'title' AS field, 'missing' AS message FROM pages WHERE length(trim(coalesce(title, ''))) = 0 UNION ALL SELECT 'title', 'too long' FROM pages WHERE length(title) > 200
  UNION ALL SELECT 'type', 'unknown' FROM pages WHERE schema_type IS NULL OR schema_type NOT IN ('note', 'decision', 'lesson', 'experience', 'skill', 'meeting')
  UNION ALL SELECT 'source', 'no slug' FROM pages WHERE source_id IS NULL OR NOT regexp_matches(source_id, '^[a-z0-9][a-z0-9_-]{0,63}$')
  UNION ALL SELECT 'status', 'unknown' FROM pages WHERE lower(trim(status)) NOT IN ('active', 'archived', 'stale') UNION ALL SELECT 'body', 'too long' FROM pages WHERE length(body_text) > 200000
  UNION ALL SELECT 'path', 'unsafe' FROM pages WHERE regexp_matches(path, '^/|\\|^[A-Za-z]:|(^|/)\.\.(/|$)') OR NOT starts_with(path, 'brains/' || brain_id || '/'))
SELECT field, message, count(*) AS n FROM i GROUP BY 1, 2""",
    "directory_tree": """WITH """ + PAGES + """, p AS (SELECT schema_type, string_split(path, '/') AS s FROM cp),
e AS (SELECT schema_type, s, unnest(range(1, least(4, len(s) - 1) + 1)) AS i FROM p)
SELECT array_to_string(s[1:i], '/') AS dir, count(*) AS n_pages, count(DISTINCT schema_type) AS n_types FROM e GROUP BY 1""",
    "directory_overviews": f"""WITH {PAGES} SELECT {PARENT.format('path')} AS dir, count(*) AS n, array_to_string(list_sort(list(coalesce(title, ''))), chr(10)) AS titles FROM cp GROUP BY 1 HAVING count(*) >= 2""",
    "lint": f"""WITH {PAGES}, f AS (
  SELECT 'no title' AS issue, path FROM cp WHERE trim(coalesce(title, '')) = '' UNION ALL SELECT 'no body', path FROM cp WHERE trim(coalesce(body_text, '')) = ''
  UNION ALL SELECT 'no type', path FROM cp WHERE schema_type IS NULL UNION ALL SELECT 'no source', path FROM cp WHERE source_id IS NULL
  UNION ALL SELECT 'wrong brain', path FROM cp WHERE NOT starts_with(path, 'brains/' || brain_id || '/'))
SELECT issue, count(*) AS n, array_to_string(list_slice(list_sort(list(path)), 1, 10), chr(10)) AS sample FROM f GROUP BY 1""",
    "exact_copies": f"""WITH h AS (SELECT doc_id, CASE WHEN coalesce({FLAT.format('text')}, '') = '' THEN '#' || doc_id ELSE md5(lower({FLAT.format('text')})) END AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS class_id, count(*) OVER (PARTITION BY h) AS n FROM h""",
    "page_facts": f"WITH {_FACTS} SELECT path, count(*) AS n_facts, min(t) AS least FROM (SELECT path, unnest(fs) AS t FROM f) GROUP BY 1",
    "sourced_facts": f"WITH {_FACTS} SELECT path, md5(CASE WHEN contains(t, '[Source:') THEN t ELSE t || ' [Source: ' || path || ']' END) AS text_md5 FROM (SELECT path, unnest(fs) AS t FROM f)",
    "repeated_facts": f"WITH {_FACTS} SELECT lower({FLAT.format('t')}) AS key, count(DISTINCT path) AS n_pages, min(path) AS least_path FROM (SELECT path, unnest(fs) AS t FROM f) GROUP BY 1 HAVING count(DISTINCT path) > 1",
    "contradicting_numbers": rf"""WITH {_FACTS}, k AS (SELECT path, lower({FLAT.format('t')}) AS t FROM (SELECT path, unnest(fs) AS t FROM f)),
g AS (SELECT path, t, regexp_replace(t, '[0-9]+([.,][0-9]+)*', '#', 'g') AS key FROM k)
SELECT key, count(DISTINCT t) AS n_values, count(DISTINCT path) AS n_pages FROM g WHERE contains(key, '#') GROUP BY 1 HAVING count(DISTINCT t) > 1 AND count(DISTINCT path) > 1""",
    "fact_pairs": f"""WITH {_FACTS}, k AS (SELECT path, unnest(fs) AS t, generate_subscripts(fs, 1) - 1 AS i FROM f), l AS (SELECT path, lower(trim(t)) AS t, i FROM k WHERE trim(t) <> ''),
p AS (SELECT a.path, a.i, b.i AS j FROM l a JOIN l b ON a.path = b.path AND a.i < b.i WHERE contains(a.t, b.t) OR contains(b.t, a.t) OR substr(a.t, 1, 40) = substr(b.t, 1, 40))
SELECT path, count(*) AS n FROM p GROUP BY 1""",
    "token_estimates": "SELECT source, CAST(sum(greatest(1, ceil(length(text) / 4))) AS BIGINT) AS tokens, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "content_hashes": """SELECT doc_id, sha256('{"title":' || to_json(coalesce(title, '')) || ',"type":' || to_json(coalesce(schema_type, '')) || '}' || chr(10) || coalesce(text, '')) AS hash FROM documents""",
}
