"""Upkeep of the corpus: findings of lint, repeated and contradicting facts, exact copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.skew import hot_keys, salted_join

#: Fixed value: characters that the beginnings of two facts are compared by.
FACT_HEAD = 40


def lint(pages: DataFrame) -> DataFrame:
    """(path, issue): pages without a title, body, type or source, or outside their brain."""
    checks = {
        "no title": F.coalesce(F.trim("title"), F.lit("")) == "", "no body": F.coalesce(F.trim("body_text"), F.lit("")) == "", "no type": F.col("schema_type").isNull(), "no source": F.col("source_id").isNull(),
        "wrong brain": ~F.startswith("path", F.concat(F.lit("brains/"), "brain_id", F.lit("/"))),
    }
    return pages.select("path", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))).alias("issue"))


def lint_summary(pages: DataFrame, sample: int = 10) -> DataFrame:
    """(issue, n, sample): counts, and the first ``sample`` paths of each issue; ranks are cut in every task before the shuffle."""
    f = lint(pages)
    first = f.withColumn("_r", F.row_number().over(Window.partitionBy("issue").orderBy("path"))).where(F.col("_r") <= sample)
    first = first.groupBy("issue").agg(F.array_sort(F.collect_list("path")).alias("sample"))
    return f.groupBy("issue").agg(F.count(F.lit(1)).alias("n")).join(first, "issue")


def facts(pages: DataFrame) -> DataFrame:
    """(path, fact_index, text): the facts that list items and headings of a page state."""
    return pages.select("path", F.posexplode(T.facts_of(F.col("body_text"))).alias("fact_index", "text"))


def sourced_facts(pages: DataFrame) -> DataFrame:
    """(path, fact_index, text): every fact with where it comes from, unless it says so itself."""
    said = F.concat("text", F.lit(" [Source: "), F.col("path").cast("string"), F.lit("]"))
    return facts(pages).withColumn("text", F.when(F.col("text").contains("[Source:"), F.col("text")).otherwise(said))


def repeated_facts(pages: DataFrame) -> DataFrame:
    """(key, n_pages, least_path): facts that several pages state alike, by normalised text."""
    f = facts(pages).select(F.lower(T.collapsed(F.col("text"))).alias("key"), "path")
    return f.groupBy("key").agg(F.count_distinct("path").alias("n_pages"), F.min("path").alias("least_path")).where("n_pages > 1")


def contradicting_numbers(pages: DataFrame) -> DataFrame:
    """(key, n_values, n_pages): facts alike but for their numbers, of which pages give different ones.

    The facts meet by an equality of their text with numbers blanked out, so no pair is compared that can't differ.
    """
    f = facts(pages).select(F.regexp_replace(F.lower(T.collapsed(F.col("text"))), r"\d+([.,]\d+)*", "#").alias("key"), F.col("text"), "path").where(F.col("key").contains("#"))
    g = f.groupBy("key").agg(F.count_distinct(F.lower(T.collapsed(F.col("text")))).alias("n_values"), F.count_distinct("path").alias("n_pages"))
    return g.where("n_values > 1 and n_pages > 1")


def pairs_of_facts(facts_: DataFrame) -> DataFrame:
    """(path, i, j): facts of one page that may contradict: one holds the other, or both begin with the same FACT_HEAD characters.

    From (path, fact_index, text). A page states few facts, so its pairs are looked at within its own row of the join.
    """
    f = facts_.select("path", "fact_index", F.lower(F.trim("text")).alias("t")).where("t <> ''")
    a, b = f.toDF("path", "i", "a"), f.toDF("path", "j", "b")
    alike = F.contains("a", F.col("b")) | F.contains("b", F.col("a")) | (F.substring("a", 1, FACT_HEAD) == F.substring("b", 1, FACT_HEAD))
    return a.join(b, "path").where((F.col("i") < F.col("j")) & alike).select("path", "i", "j")


def exact_copies(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, n): every document with the least id of those that have the same normalised text; empty ones stay alone."""
    h = F.when(F.coalesce(T.collapsed(F.col(text)), F.lit("")) == "", F.concat(F.lit("#"), F.col(key).cast("string"))).otherwise(F.md5(F.lower(T.collapsed(F.col(text)))))
    d = documents.select(key, h.alias("_h"))
    g = d.groupBy("_h").agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("n"))
    # a text that a third of all documents share is spread over tasks
    return salted_join(d, g, "_h", F.col(key), hot_keys(g, "_h", "n")).select(key, "class_id", "n")
