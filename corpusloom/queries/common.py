"""What several queries share: the current tables, and the SQL that says the same."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.pages import current_pages, readable
from corpusloom.operators.records import current_records
from corpusloom.tables import table

#: The moment that ages are counted from, so that results can be repeated.
NOW = "2026-07-31 00:00:00"


def pages(spark, d) -> DataFrame:
    return current_pages(table(spark, d, "pages"))


def active(spark, d, **filters) -> DataFrame:
    """Readable pages. A path lies in one brain in all its versions, so the brain is filtered at the scan."""
    p = table(spark, d, "pages")
    if brain := filters.get("brain_id"):
        p = p.where(F.col("brain_id") == brain)
    return readable(current_pages(p), **filters)


def records(spark, d) -> DataFrame:
    return current_records(table(spark, d, "entity_registry"))


_DESC = ", ".join(f"{c} DESC NULLS LAST" for c in "updated_at brain_id source_id schema_type title status aliases frontmatter_json body_text content_hash".split())
PAGES = f"""cp AS (SELECT * REPLACE (coalesce(lower(trim(status)), 'active') AS status) FROM pages WHERE path IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY {_DESC}) = 1),
ap AS (SELECT * FROM cp WHERE status = 'active')"""
_DESC = ", ".join(f"{c} DESC NULLS LAST" for c in "updated_at canonical_slug status title aliases_json content_hash".split())
RECORDS = f"""r0 AS (SELECT * REPLACE (lower(trim(status)) AS status, lower(trim(canonical_slug)) AS canonical_slug) FROM entity_registry WHERE brain_id IS NOT NULL AND slug IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY brain_id, slug ORDER BY {_DESC}) = 1),
rec AS (SELECT * REPLACE (CASE WHEN status = 'merged' AND coalesce(canonical_slug, '') <> '' THEN canonical_slug ELSE slug END AS canonical_slug) FROM r0)"""
#: White space runs of text column {0} as one blank, trimmed.
FLAT = r"trim(regexp_replace({0}, '[\s\p{{Z}}]+', ' ', 'g'))"
WORDS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
PARENT = "regexp_replace({0}, '/[^/]*$', '')"
BASE = r"regexp_replace(regexp_replace({0}, '^.*/', ''), '\.md$', '')"
PREFIX = "coalesce(nullif(regexp_extract({0}, '^(brains/[^/]+/sources/[^/]+|brains/[^/]+/(?:experiences|skills))(?:/|$)', 1), ''), " + PARENT + ")"
