"""Readers of Markdown trees and JSON lines, and writers of the tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FRONT = r"(?s)^\x{FEFF}?---\r?\n(.*?)\r?\n---\r?\n?(.*)$"


def markdown_files(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """(path, raw): every Markdown file beneath ``root``, its path from there; dot files and dot folders are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/").removeprefix("file://")
    path = F.regexp_replace(F.try_url_decode(F.regexp_replace(F.col("path"), r"\+", "%2B")), rf"^\w+:(//)?/*{base.lstrip('/')}/", "")
    return files.select(path.alias("path"), F.decode("content", "utf-8").alias("raw")).where(~F.col("path").rlike(r"(^|/)\."))


def split_front(raw: DataFrame) -> DataFrame:
    """(…, front, body_text): the YAML head as text and what follows; without a head all is body."""
    has = F.col("raw").rlike(FRONT)
    return raw.withColumn("front", F.when(has, F.regexp_extract("raw", FRONT, 1))).withColumn("body_text", F.when(has, F.regexp_extract("raw", FRONT, 2)).otherwise(F.col("raw")))


def front_to_json(pages: DataFrame) -> DataFrame:
    """``front`` (YAML text) as ``frontmatter_json``; broken YAML, and YAML that is no mapping, gives {}. Dates stay text."""
    rest = [c for c in pages.columns if c != "front"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        class Plain(yaml.SafeLoader):
            """Dates, on and off stay strings."""

        Plain.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t != "tag:yaml.org,2002:timestamp" and (t != "tag:yaml.org,2002:bool" or k in "tTfF")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}

        def one(text: str | None) -> str:
            try:
                got = yaml.load(text or "", Plain)
            except yaml.YAMLError:
                got = None
            return json.dumps(got if isinstance(got, dict) else {}, ensure_ascii=False, default=str)

        for b in batches:
            yield b.assign(frontmatter_json=b["front"].map(one))[[*rest, "frontmatter_json"]]

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in rest)
    return pages.mapInPandas(run, f"{schema}, frontmatter_json string")


def pages_of(files: DataFrame) -> DataFrame:
    """The page table of Markdown files (path, raw): the derived columns are read from the head, else from the path."""
    p = front_to_json(split_front(files)).drop("raw")
    of = lambda k: F.get_json_object("frontmatter_json", f"$.{k}")
    brain = F.regexp_extract("path", "^brains/([^/]+)/", 1)
    source = F.when(F.col("path").contains("/experiences/"), "_experience").when(F.col("path").contains("/skills/"), "_skill").otherwise(F.regexp_extract("path", "/sources/([^/]+)/", 1))
    named = lambda given, c: F.when(F.coalesce(given, F.lit("")) != "", given).otherwise(c)
    return p.select(
        "path", named(brain, F.lit("default")).alias("brain_id"), named(of("source"), named(source, F.lit("default"))).alias("source_id"), of("schema_type").alias("schema_type"),
        named(of("title"), F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", "")).alias("title"), named(of("status"), F.lit("active")).alias("status"),
        F.from_json(of("aliases"), "array<string>").alias("aliases"), "frontmatter_json", "body_text", F.sha2(F.concat("frontmatter_json", F.lit("\n"), "body_text"), 256).alias("content_hash"),
    )


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value, error): the objects of JSON lines files or of a JSON array. Blank lines and a byte order mark don't count.

    Lines are read in splits, so a file of any size is many tasks; numbers follow from the counts of the splits before. A JSON array
    is one value, and is read as one.
    """
    unmarked = F.regexp_replace("value", r"^\x{FEFF}", "")
    lines = spark.read.text(path).select(unmarked.alias("value"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    head = lines.where(F.trim("value") != "").select("value").first()
    if head and head[0].lstrip().startswith("["):
        text = spark.read.text(path, wholetext=True).select(unmarked.alias("all"))
        rows = text.select(F.posexplode(F.from_json("all", "array<string>")).alias("i", "value")).select((F.col("i") + 1).alias("line"), "value")
    else:
        splits = lines.groupBy("_f", "_b").agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy("_f").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        rows = lines.join(splits, ["_f", "_b"]).select((F.col("_before") + F.col("_i") - F.col("_first") + 1).alias("line"), F.regexp_replace("value", r"\r$", "").alias("value"))
    return with_errors(rows.where(F.trim("value") != ""))


def with_errors(rows: DataFrame, value: str = "value") -> DataFrame:
    """``rows`` with ``error``: null if ``value`` is a JSON object, else what is wrong."""
    v = F.try_parse_json(F.col(value))
    return rows.withColumn("error", F.when(v.isNull(), "not JSON").when(~F.schema_of_variant(v).startswith("OBJECT"), "no object"))


def turns_of(rows: DataFrame) -> DataFrame:
    """(line, role, text, error) of JSON rows (line, value): text is ``text`` or ``content``; an unknown role is an error."""
    of = lambda k: F.get_json_object("value", f"$.{k}")
    role = F.lower(F.trim(of("role")))
    bad = F.when(role.isNull() | ~role.isin("user", "assistant", "system", "tool"), "unknown role")
    return rows.select("line", role.alias("role"), F.coalesce(of("text"), of("content")).alias("text"), F.coalesce("error", bad).alias("error"))


def notes_of(rows: DataFrame) -> DataFrame:
    """(line, title, body, type, source, error) of JSON rows in the plain or the app's form of a note."""
    of = lambda k: F.get_json_object("value", f"$.{k}")
    body = F.coalesce(of("body"), of("content"), of("text"), of("message.text"), of("message.content"), of("message.body"), of("message"))
    title = F.coalesce(F.trim(of("title")), F.trim(of("topic")), F.substring(F.split(body, "\n")[0], 1, 80))
    missing = F.when(F.coalesce(body, F.lit("")) == "", "no body").when(F.coalesce(title, F.lit("")) == "", "no title")
    return rows.select("line", title.alias("title"), body.alias("body"), F.coalesce(of("type"), of("schema_type"), F.lit("note")).alias("type"), F.coalesce(of("source"), of("source_id"), of("session"), of("session_id")).alias("source"), F.coalesce("error", missing).alias("error"))


def split_rejects(rows: DataFrame, fail_fast: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good, bad) by ``error``; with ``fail_fast`` reading a bad row fails the job."""
    if fail_fast:
        rows = rows.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.lit(None).cast("string")))
    return rows.where("error is null").drop("error"), rows.where("error is not null")


def write_by_brain(table: DataFrame, path: str) -> None:
    """Write a table by brain; only the brains it holds are replaced."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("brain_id").parquet(path)


def append_by_month(log: DataFrame, path: str, at: str = "at") -> None:
    """Append a log as JSON lines by month, so that a reader of the latest months reads those only."""
    log.withColumn("month", F.date_format(at, "yyyy-MM")).write.mode("append").partitionBy("month").json(path)
