"""Pages: the current version of each, filters of every read, validation of new ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.tables import current_rows

SIDE_FILES = (".overview.md", ".abstract.md")
#: Limits and vocabularies of a page.
TITLE_CHARS, BODY_CHARS = 200, 200_000
STATUSES = ("active", "archived", "stale")
LINK_TYPES = ("mentions", "references", "decided", "produced_by", "works_on", "belongs_to", "works_at", "founded", "invested_in", "advises")


def current_pages(pages: DataFrame) -> DataFrame:
    """One row per path, its latest version, with the status trimmed in lower case (null: active)."""
    now = current_rows(pages.where(F.col("path").isNotNull()), ["path"])
    return now.withColumn("status", F.coalesce(F.lower(F.trim("status")), F.lit("active")))


def readable(
    pages: DataFrame, brain_id: str | None = None, source_id: str | None = None, schema_type: str | None = None, exclude_types: Sequence[str] = (), exclude_side_files: bool = False, allowed_sources: Sequence[str] | None = None
) -> DataFrame:
    """The filter of every search: active pages of a brain. All are plain columns, so they reach the scan.

    A null type doesn't pass ``exclude_types`` (three-valued logic). ``allowed_sources`` is applied before any top-k.
    """
    if schema_type and exclude_types:
        raise ValueError("give schema_type or exclude_types, not both")
    p = pages.where(F.col("status") == "active")
    if brain_id:
        p = p.where(F.col("brain_id") == brain_id)
    if source_id:
        p = p.where(F.col("source_id") == source_id)
    if schema_type:
        p = p.where(F.col("schema_type") == schema_type)
    if exclude_types:
        p = p.where(~F.col("schema_type").isin(*exclude_types))
    if exclude_side_files:
        for end in SIDE_FILES:
            p = p.where(~F.col("path").endswith(end))
    if allowed_sources is not None:
        p = p.where(F.col("source_id").isin(*allowed_sources) | F.col("path").rlike("/(experiences|skills)/"))
    return p


def type_of_path(path: Column) -> Column:
    """The type that a path implies, null if it implies none."""
    return F.when(path.contains("/skills/"), "skill").when(path.contains("/experiences/"), "experience").when(path.contains("/entities/"), "entity").otherwise(F.regexp_extract(path, r"/(note|decision|lesson|meeting)s/[^/]+$", 1))


def unsafe_path(path: Column, brain_id: Column) -> Column:
    """Absolute, with a drive or backslash, climbing, or outside its brain."""
    return path.rlike(r"^/|\\|^[A-Za-z]:|(^|/)\.\.(/|$)|\x00") | ~F.startswith(path, F.concat(F.lit("brains/"), brain_id, F.lit("/")))


def issues(pages: DataFrame, types: Sequence[str]) -> DataFrame:
    """``pages`` with ``issues``: an array of (field, message); an empty one means that the page is valid."""
    rules = [
        ("title", F.coalesce(F.length(F.trim("title")), F.lit(0)) == 0, "missing"),
        ("title", F.length("title") > TITLE_CHARS, "too long"),
        ("type", F.col("schema_type").isNull() | ~F.col("schema_type").isin(*types), "unknown"),
        ("source", F.col("source_id").isNull() | ~T.is_slug(F.col("source_id")), "no slug"),
        ("status", F.col("status").isNotNull() & ~F.lower(F.trim("status")).isin(*STATUSES), "unknown"),
        ("body", F.length("body_text") > BODY_CHARS, "too long"),
        ("path", unsafe_path(F.col("path"), F.col("brain_id")), "unsafe"),
    ]
    found = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(f).alias("field"), F.lit(m).alias("message"))) for f, bad, m in rules]))
    return pages.withColumn("issues", found)


def new_paths(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """Paths for new pages: folder/slug.md, and -2, -3, ... where the path is taken by an older page or request.

    requests: (folder, title, seq). One hash aggregation of taken names and one window per slug; a slug that is shared by
    very many requests is numbered in one sort.
    """
    from pyspark.sql import Window

    base = F.concat("folder", F.lit("/"), T.slug(F.col("title")))
    w = Window.partitionBy("_base").orderBy("seq")
    taken = existing.select(F.regexp_replace("path", r"(-\d+)?\.md$", "").alias("_base")).groupBy("_base").agg(F.count(F.lit(1)).alias("_taken"))
    r = requests.withColumn("_base", base).join(taken, "_base", "left").withColumn("_n", F.row_number().over(w) + F.coalesce("_taken", F.lit(0)))
    return r.withColumn("path", F.concat("_base", F.when(F.col("_n") > 1, F.concat(F.lit("-"), F.col("_n"))).otherwise(""), F.lit(".md"))).drop("_base", "_taken", "_n")


def directory_tree(pages: DataFrame, depth: int = 4) -> DataFrame:
    """(dir, n_pages, n_types): every folder down to ``depth`` levels with what lies beneath it."""
    parts = F.split("path", "/")
    dirs = F.transform(F.sequence(F.lit(1), F.least(F.lit(depth), F.size(parts) - 1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return pages.select(F.explode(dirs).alias("dir"), "schema_type").groupBy("dir").agg(F.count(F.lit(1)).alias("n_pages"), F.count_distinct("schema_type").alias("n_types"))


def layered(pages: DataFrame) -> DataFrame:
    """(path, l0, l1, l2): abstract, overview and whole text; a side file's text goes before what is made of the body."""
    side = pages.where(F.col("path").endswith(".overview.md")).select(F.regexp_replace("path", r"\.overview\.md$", ".md").alias("path"), F.col("body_text").alias("_side"))
    own = pages.where(~T.is_derived_layer(F.col("path")))
    given = F.trim(F.get_json_object("frontmatter_json", "$.abstract"))
    l0 = F.when(F.coalesce(given, F.lit("")) != "", given).otherwise(T.abstract_of(F.col("body_text")))
    return own.join(side, "path", "left").select("path", l0.alias("l0"), F.coalesce("_side", T.overview_of(F.col("body_text"))).alias("l1"), F.col("body_text").alias("l2"))


def directory_titles(pages: DataFrame, least: int = 2) -> DataFrame:
    """(dir, place, title): the titles of ``directory_overviews`` as rows, for folders of any size."""
    from pyspark.sql import Window

    t = pages.select(T.parent_dir(F.col("path")).alias("dir"), F.coalesce("title", F.lit("")).alias("title"))
    full = t.groupBy("dir").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("dir")
    return t.join(full, "dir", "left_semi").select("dir", F.row_number().over(Window.partitionBy("dir").orderBy("title")).alias("place"), "title")


def directory_overviews(pages: DataFrame, least: int = 2) -> DataFrame:
    """(dir, n, titles): folders of at least ``least`` pages with their titles in order, one line each.

    A folder's titles are one value, so it must fit in memory; ``directory_titles`` has them as rows.
    """
    g = pages.groupBy(T.parent_dir(F.col("path")).alias("dir")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.coalesce("title", F.lit("")))).alias("titles"))
    return g.where(F.col("n") >= least).select("dir", "n", F.array_join("titles", "\n").alias("titles"))


def archived(pages: DataFrame, paths: DataFrame) -> DataFrame:
    """Pages with those of ``paths`` archived: a soft delete, after which no search returns them."""
    marked = paths.select("path", F.lit(True).alias("_gone")).distinct()
    return pages.join(marked, "path", "left").withColumn("status", F.when(F.col("_gone"), "archived").otherwise(F.col("status"))).drop("_gone")


def purged(pages: DataFrame, paths: DataFrame) -> DataFrame:
    """Pages without those of ``paths``."""
    return pages.join(paths.select("path").distinct(), "path", "left_anti")
