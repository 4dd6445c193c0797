"""Links in the text of pages: extraction with claimed ranges, and names turned into links.

Which pass may claim a stretch of text depends on the passes before it, so this is a small function per page, applied to
Arrow batches in place; typing, ids and deduplication are column work.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

#: Kinds of references in the order in which they claim text, with the type of each where no verb is near, and the
#: verbs, in order, that give a link its type.
PASSES = [
    ("markdown", "references", re.compile(r"(?<!!)\[[^\]]*\]\(([^)\s]+)\)")),
    ("wikilink", "references", re.compile(r"\[\[([^\]]+/[^\]]+)\]\]")),
    ("wikilink", "mentions", re.compile(r"\[\[([^\]]+)\]\]")),
    ("mention", "mentions", re.compile(r"@([a-zA-Z0-9][a-zA-Z0-9_-]{0,63})")),
]
VERBS = [
    ("decided", re.compile(r"(?i)决定|decided")),
    ("produced_by", re.compile(r"(?i)产出|produced")),
    ("works_on", re.compile(r"(?i)负责|works\s+on")),
    ("belongs_to", re.compile(r"(?i)属于")),
    ("works_at", re.compile(r"(?i)任职|就职|工作于|works\s+at|works_at")),
    ("founded", re.compile(r"(?i)创立|创办|founded")),
    ("invested_in", re.compile(r"(?i)投资|invested\s+in")),
    ("advises", re.compile(r"(?i)顾问|advises")),
]
EXTERNAL = re.compile(r"(?i)https?:|mailto:|#")
AROUND = 40
_CODE = (re.compile(r"```.*?```", re.S), re.compile(r"`[^`\n]+`"))


def without_code(text: str) -> str:
    """The text with code blanked out, every other character in its place."""
    for pattern in _CODE:
        text = pattern.sub(lambda m: " " * len(m[0]), text)
    return text


def links_in(text: str, front: str | None = None) -> list[tuple[str, str, str]]:
    """(to, type, source) of a text and of the ``links`` of its front matter (JSON), each (to, type) once, the first wins.

    Targets on the web, mail addresses and anchors are no links.
    """
    clean, taken, out = without_code(text), [], {}
    for source, kind, pattern in PASSES:
        for m in pattern.finditer(clean):
            start, end = m.span()
            if (source == "markdown" and EXTERNAL.match(m[1])) or not m[1].strip() or any(start < b and a < end for a, b in taken):
                continue
            taken.append((start, end))
            near = clean[max(0, start - AROUND) : end + AROUND]
            out.setdefault((m[1].strip(), next((v for v, p in VERBS if p.search(near)), kind)), source)
    for to, kind in _front_links(front):
        out.setdefault((to, kind), "frontmatter")
    return [(to, kind, source) for (to, kind), source in out.items()]


def _front_links(front: str | None) -> Iterator[tuple[str, str]]:
    try:
        links = json.loads(front).get("links") if front and '"links"' in front else None
    except (ValueError, AttributeError):
        return
    for link in links if isinstance(links, list) else ():
        to, kind = (link.get("to"), link.get("type")) if isinstance(link, dict) else (None, None)
        if isinstance(to, str) and to.strip():
            yield to.strip(), kind if isinstance(kind, str) and kind else "references"


def extract_links(pages: DataFrame) -> DataFrame:
    """(id, from_path, to_ref, type, source, brain_id) from pages (path, brain_id, body_text, frontmatter_json). Null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, br, *x) for p, br, t, f in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in links_in(t or "", f)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(5)], names=["from_path", "brain_id", "to_ref", "type", "source"])

    found = pages.select("path", "brain_id", "body_text", "frontmatter_json").mapInArrow(run, "from_path string, brain_id string, to_ref string, type string, source string")
    return found.select(T.link_id(F.col("from_path"), F.col("to_ref"), F.col("type"), F.col("source")).alias("id"), "from_path", "to_ref", "type", "source", "brain_id")


def wikilinks(pages: DataFrame) -> DataFrame:
    """(path, to_ref): the plain fast path for wikilinks, without Python."""
    return pages.select("path", F.explode(F.array_distinct(F.regexp_extract_all("body_text", F.lit(r"\[\[([^\]|\n]+)\]\]"), F.lit(1)))).alias("to_ref"))


def linkified(text: str, names: list[tuple[str, str]]) -> str:
    """The text with names written as @slug: longest names first, whole words, nothing replaced twice, @names left alone."""
    taken: list[tuple[int, int, str]] = []
    for name, slug in sorted({(n, s) for n, s in names if n}, key=lambda x: (-len(x[0]), x)):
        edge = r"\b" if name.isascii() else ""
        for m in re.finditer(rf"(?<!@){edge}{re.escape(name)}{edge}", text):
            if not any(m.start() < b and a < m.end() for a, b, _ in taken):
                taken.append((*m.span(), f"@{slug}"))
    for a, b, to in sorted(taken, reverse=True):
        text = text[:a] + to + text[b:]
    return text
