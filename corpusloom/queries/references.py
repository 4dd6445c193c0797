"""p5: references to records that do not exist."""

from corpusloom.operators.orphans import orphan_references, orphan_report
from corpusloom.tables import table


def p5_found(spark, d):
    return orphan_references(table(spark, d, "links"), table(spark, d, "pages")).select("id", "side", "kind")


def p5_report(spark, d):
    return orphan_report(table(spark, d, "links"), table(spark, d, "pages"))


_REFS = r"""
WITH l AS (
  SELECT id, min(synced_at) AS synced_at, arg_min(struct_pack(f := from_path, t := to_ref, b := brain_id), synced_at) AS r FROM links GROUP BY id),
s AS (
  SELECT id, synced_at, 'from' AS side, r.f AS path FROM l WHERE r.f IS NOT NULL
  UNION ALL
  SELECT id, synced_at, 'to', p FROM (
    SELECT id, synced_at, CASE WHEN clean LIKE '%.md' THEN clean ELSE clean || '.md' END AS p FROM (
      SELECT id, synced_at, substr(list_reduce(string_split(rooted, '/'), lambda acc, x:
          CASE WHEN x IN ('', '.') THEN acc WHEN x = '..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE acc || '/' || x END, ''), 2) AS clean
      FROM (
        SELECT id, synced_at, CASE WHEN regexp_matches(u, '^/*brains/') THEN u
            WHEN regexp_matches(u, '^/*sources/') THEN 'brains/' || r.b || '/' || u
            ELSE regexp_replace(r.f, '[^/]*$', '') || u END AS rooted
        FROM (SELECT *, trim(url_decode(trim(split_part(trim(replace(r.t, chr(92), '/')), '#', 1)))) AS u FROM l
              WHERE (contains(r.t, '/') OR contains(r.t, chr(92))) AND NOT regexp_matches(trim(r.t), '^[A-Za-z][A-Za-z0-9+.-]*:'))))
    WHERE clean IS NOT NULL)),
g AS (SELECT path, min(updated_at) AS first_at, arg_max(lower(trim(status)), updated_at) AS status FROM pages WHERE path IS NOT NULL GROUP BY path),
found AS (
  SELECT s.id, s.side, s.synced_at, CASE WHEN g.path IS NULL THEN 'missing' WHEN g.status = 'archived' THEN 'deleted' WHEN g.first_at > s.synced_at THEN 'late' END AS kind
  FROM s LEFT JOIN g USING (path))
"""

QUERIES = {"p5_found": p5_found, "p5_report": p5_report}
SQL = {
    "p5_found": _REFS + "SELECT id, side, kind FROM found WHERE kind IS NOT NULL",
    "p5_report": _REFS + "SELECT 'links' AS from_table, side, kind, strftime(synced_at, '%Y-%m') AS month, count(*) AS n FROM found WHERE kind IS NOT NULL GROUP BY ALL",
}
