"""Column expressions over text: no UDF, so filters and projections stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the page format.
CHUNK_CHARS = 800
ABSTRACT_CHARS, OVERVIEW_CHARS = 100, 4000
SNIPPET_CHARS, SNIPPET_LEAD = 160, 40
SECTIONS = ("摘要", "正文")
WORD_GAP = r"[^\p{L}\p{N}]+"


def collapsed(text: Column) -> Column:
    """White space runs as one blank, trimmed."""
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def words(text: Column) -> Column:
    """Lower-case words in order."""
    return F.filter(F.split(F.lower(text), WORD_GAP), lambda w: w != "")


def bigrams(text: Column) -> Column:
    """Overlapping pairs of characters of the text without white space; a shorter text is its own gram."""
    t = F.regexp_replace(text, r"\s+", "")
    # pairs of two arrays: a lambda over places would cleanse the whole text again for each of them
    c = F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0))
    n = F.greatest(F.size(c) - 1, F.lit(0))
    return F.when(F.length(t) <= 1, F.filter(F.array(t), lambda x: x != "")).otherwise(F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, F.lit(2), n), lambda a, b: F.concat(a, b)))


def letter_pairs(text: Column) -> Column:
    """Overlapping pairs of characters of the text as it is, blanks and capitals included; a single character is its own gram."""
    c = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    n = F.greatest(F.size(c) - 1, F.lit(0))
    return F.when(F.size(c) <= 1, c).otherwise(F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, F.lit(2), n), lambda a, b: F.concat(a, b)))


def has_all_bigrams(text: Column, query: Column) -> Column:
    return F.size(F.array_except(bigrams(query), bigrams(text))) == 0


def snippet(text: Column, query: Column | str) -> Column:
    """SNIPPET_CHARS characters from SNIPPET_LEAD before the first hit, with ellipses where text is cut off."""
    q = F.lit(query) if isinstance(query, str) else query
    t = collapsed(text)
    at = F.instr(F.lower(t), F.lower(q))
    start = F.when(at > SNIPPET_LEAD, at - SNIPPET_LEAD).otherwise(F.lit(1))
    return F.concat(F.when(start > 1, "…").otherwise(""), F.substring(t, start, F.lit(SNIPPET_CHARS)), F.when(start - 1 + SNIPPET_CHARS < F.length(t), "…").otherwise(""))


def slug(title: Column, most: int = 64) -> Column:
    """Lower case, everything but letters and digits as one hyphen, at most ``most`` characters; ``untitled`` if nothing is left."""
    s = F.regexp_replace(F.lower(F.trim(title)), WORD_GAP, "-")
    s = F.regexp_replace(F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, most), "-+$", "")
    return F.when(s == "", "untitled").otherwise(s)


def is_slug(text: Column) -> Column:
    return text.rlike(r"^[a-z0-9][a-z0-9_\-]{0,63}$")


def link_id(from_path: Column, to_ref: Column, type_: Column, source: Column) -> Column:
    return F.sha2(F.concat_ws("\0", from_path, to_ref, type_, source), 256)


def content_hash(body: Column, **fields: Column) -> Column:
    """sha256 over the whitelisted fields as JSON with sorted keys, a line feed and the body."""
    head = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))
    return F.sha2(F.concat(head, F.lit("\n"), body), 256)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays, 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def parent_dir(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def basename(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.md$", "")


def source_prefix(path: Column) -> Column:
    """brains/B/sources/S of a path; brains/B/KIND for derived pages; else the path's folder."""
    m = F.regexp_extract(path, r"^(brains/[^/]+/sources/[^/]+|brains/[^/]+/(?:experiences|skills))(?:/|$)", 1)
    return F.when(m != "", m).otherwise(parent_dir(path))


def layer_key(path: Column) -> Column:
    """Order of layers where scores tie: skills, experiences, notes, decisions and lessons of a source, the rest."""
    return F.when(path.contains("/skills/"), 0).when(path.contains("/experiences/"), 1).when(path.rlike("/sources/[^/]+/(notes|decisions|lessons)/"), 2).otherwise(3)


def bucket(path: Column) -> Column:
    return F.when(path.contains("/skills/"), "skills").when(path.contains("/experiences/"), "experiences").otherwise("notes")


def is_derived_layer(path: Column) -> Column:
    return path.rlike(r"(^|/)_overview\.md$|\.overview\.md$|\.abstract\.md$")


def month_of(at: Column) -> Column:
    return F.substring(at, 1, 7)


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4))


def abstract_of(body: Column) -> Column:
    return F.substring(collapsed(body), 1, ABSTRACT_CHARS)


def overview_of(body: Column) -> Column:
    t = F.trim(body)
    return F.when(F.length(t) > OVERVIEW_CHARS, F.concat(F.substring(t, 1, OVERVIEW_CHARS), F.lit("…"))).otherwise(t)


def page_body(abstract: Column, text: Column) -> Column:
    """The two sections of a page; the text alone if there is no abstract."""
    return F.when(F.coalesce(abstract, F.lit("")) == "", text).otherwise(F.concat(F.lit(f"## {SECTIONS[0]}\n\n"), abstract, F.lit(f"\n\n## {SECTIONS[1]}\n\n"), text))


def body_core(body: Column) -> Column:
    """What follows the heading of the text section, or the whole body."""
    core = F.regexp_extract(body, rf"(?s)##\s*{SECTIONS[1]}\s*\n(.*)", 1)
    return F.when(core != "", core).otherwise(body)


def dedupe_key(title: Column, body: Column) -> Column:
    return F.lower(collapsed(F.concat_ws(" ", title, body_core(body))))


def facts_of(body: Column) -> Column:
    """List items and second-level headings, section names left out, each once in order."""
    lines = F.transform(F.split(F.regexp_replace(body, "\r\n?", "\n"), "\n"), lambda x: F.trim(F.regexp_extract(x, r"^\s*(?:[-*]|##|\d+\.)\s+(.*)$", 1)))
    return F.array_distinct(F.filter(lines, lambda x: (x != "") & ~x.isin(*SECTIONS)))


def chunks(text: Column, most: int = CHUNK_CHARS) -> Column:
    """Pieces of at most ``most`` characters: paragraphs packed greedily, joined by a blank line; longer ones cut hard."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n{2,}"), lambda p: F.trim(p, F.lit(" \t\r\n"))), lambda p: p != "")

    def add(acc: Column, p: Column) -> Column:
        n = F.length(p)
        joined = F.concat(acc["open"], F.lit("\n\n"), p)
        closed = F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))
        cut = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / most).cast("int")), lambda i: F.substring(p, i * most + 1, F.lit(most)))
        packed = F.struct(acc["done"].alias("done"), joined.alias("open"))
        fresh = F.struct(closed.alias("done"), p.alias("open"))
        hard = F.struct(F.concat(closed, F.slice(cut, F.lit(1), F.size(cut) - 1)).alias("done"), F.element_at(cut, -1).alias("open"))
        return F.when((acc["open"] != "") & (F.length(acc["open"]) + n + 2 <= most), packed).when(n <= most, fresh).otherwise(hard)

    none = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    return F.aggregate(paragraphs, none, add, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))
