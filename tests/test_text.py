"""Text and vector expressions against plain Python."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vector as V

TEXTS = ["", " ", "a", "ab", "支付 超时", "Retry queue!", "x" * 2000, "A\n\nB\n\n\nC", "p1\n\n" + "y" * 900 + "\n\nz", "- one\n* two\n## 摘要\n## Head\n1. three\n- one", None]


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr.alias("x")).collect()]


def chunked(text, most=800):
    out, cur = [], ""
    for p in (p.strip(" \t\r\n") for p in re.split(r"\n{2,}", text)):
        if not p:
            continue
        if cur and len(cur) + 2 + len(p) <= most:
            cur += "\n\n" + p
            continue
        if cur:
            out.append(cur)
            cur = ""
        while len(p) > most:
            out.append(p[:most])
            p = p[most:]
        cur = p
    return out + [cur] if cur else out


def test_chunks(spark):
    got = column(spark, TEXTS, T.chunks(F.col("t")))
    assert got == [None if t is None else chunked(t) for t in TEXTS]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab \n支", max_size=120), min_size=20, max_size=40))
def test_chunks_any(spark, texts):
    assert column(spark, texts, T.chunks(F.col("t"), 10)) == [chunked(t, 10) for t in texts]


def test_bigrams(spark):
    want = []
    for t in TEXTS:
        s = re.sub(r"\s+", "", t) if t is not None else None
        want.append(None if s is None else [s] if len(s) == 1 else [s[i : i + 2] for i in range(len(s) - 1)])
    assert column(spark, TEXTS, T.bigrams(F.col("t"))) == want


def test_slug_and_paths(spark):
    got = column(spark, ["  Héllo, World! ", "支付-超时", "!!!", "a" * 80], T.slug(F.col("t")))
    assert got == ["héllo-world", "支付-超时", "untitled", "a" * 64]
    paths = ["brains/b/sources/s/notes/1-x.md", "brains/b/skills/k/SKILL.md", "x.md"]
    assert column(spark, paths, T.parent_dir(F.col("t"))) == ["brains/b/sources/s/notes", "brains/b/skills/k", ""]
    assert column(spark, paths, T.source_prefix(F.col("t"))) == ["brains/b/sources/s", "brains/b/skills", ""]
    assert column(spark, paths, T.bucket(F.col("t"))) == ["notes", "skills", "notes"]


def test_snippet(spark):
    long = "w " * 100 + "needle" + " v" * 200
    got = column(spark, [long, "no hit", None], T.snippet(F.col("t"), "Needle"))
    assert got[0].startswith("…") and got[0].endswith("…") and "needle" in got[0] and len(got[0]) == 162
    assert got[1:] == ["no hit", None]


def test_facts_and_bodies(spark):
    assert column(spark, [TEXTS[-2]], T.facts_of(F.col("t"))) == [["one", "two", "Head", "three"]]
    body = column(spark, ["core text"], T.page_body(F.lit("short"), F.col("t")))[0]
    assert column(spark, [body], T.body_core(F.col("t"))) == ["core text"]
    assert column(spark, ["x", None], T.page_body(F.lit(""), F.col("t"))) == ["x", None]


def test_ids(spark):
    got = column(spark, ["a"], T.link_id(F.col("t"), F.lit("b"), F.lit("c"), F.lit("d")))[0]
    assert got == hashlib.sha256(b"a\0b\0c\0d").hexdigest()
    assert column(spark, ["abcde", ""], T.estimated_tokens(F.col("t"))) == [2, 1]


def fnv_vector(grams, dims):
    v = [0.0] * dims
    for g in grams:
        h = 2166136261
        for c in g:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        v[h % dims] += 1 if h % 2 == 0 else -1
    n = sum(x * x for x in v) ** 0.5
    return [x / n if n else 0.0 for x in v]


def test_hash_embedding(spark):
    words = ["支付超时", "retry", "", "a"]
    got = column(spark, words, V.hash_embedding(T.bigrams(F.col("t")), 16))
    for w, v in zip(words, got, strict=True):
        grams = [w] if len(w) == 1 else [w[i : i + 2] for i in range(len(w) - 1)]
        assert v == pytest.approx(fnv_vector(grams, 16), abs=1e-6)


def test_embedding_of_one_letter(spark):
    got = column(spark, ["a", "b", "支", "ab", "a b"], V.hash_embedding(T.letter_pairs(F.col("t"))))
    assert len(got[0]) == 384 and [sum(v) for v in got[:3]] == [1.0, 1.0, 1.0] and got[4] != got[3]


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([1.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([], []), (None, [1.0]), ([float("nan"), 1.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == pytest.approx([1.0, 0, 0, 0, 0, 0])
