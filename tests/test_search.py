"""Ranks, fusion and signals on small fixtures with known values."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import fusion as X
from corpusloom.operators import graph, keyword
from corpusloom.operators import pages as P

PAGES = "path string, brain_id string, source_id string, schema_type string, title string, status string, aliases array<string>, frontmatter_json string, body_text string, updated_at timestamp"


def page(path, title="", body="", status="active", brain="b", aliases=None, kind="note"):
    from datetime import datetime

    return (path, brain, "s", kind, title, status, aliases, "{}", body, datetime(2026, 1, 1))


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        page("brains/b/a.md", "retry queue", "The retry queue is slow. retry retry"), page("brains/b/b.md", "other", "queue of something and, far away, a retry"), page("brains/b/c.md", "100% done", "progress 100% reached"),
        page("brains/b/d.md", "支付", "支付超时的处理办法"), page("brains/b/e.md", "x_y", "nothing", aliases=["Retry Queue"]), page("brains/c/f.md", "retry queue", "secret retry queue", brain="c"), page("brains/b/g.md", "retry queue", "retry", status="archived"),
    ]
    return spark.createDataFrame(rows, PAGES)


def paths(df):
    return [r["path"] for r in df.collect()]


def test_filters_and_isolation(pages):
    got = paths(keyword.keyword_search(P.readable(pages, brain_id="b"), "retry queue"))
    assert got[0] == "brains/b/a.md" and set(got) == {"brains/b/a.md", "brains/b/b.md", "brains/b/e.md"}
    with pytest.raises(ValueError):
        P.readable(pages, schema_type="note", exclude_types=("lesson",))


def test_no_wildcards(pages):
    b = P.readable(pages, brain_id="b")
    assert paths(keyword.keyword_search(b, "100%")) == ["brains/b/c.md"]
    assert "brains/b/a.md" not in paths(keyword.keyword_search(b, "_"))


def test_han(pages):
    assert paths(keyword.keyword_search(P.readable(pages), "支付超时")) == ["brains/b/d.md"]


def test_word_rank(spark):
    from corpusloom.functions import text as T

    df = spark.createDataFrame([("retry a retry",), ("x",), ("retry queue retry",)], "t string")
    one = [r[0] for r in df.select(keyword.word_rank(T.words(F.col("t")), ["retry"])).collect()]
    assert one == pytest.approx([keyword.expected_rank(2), 0, keyword.expected_rank(2)])
    two = [r[0] for r in df.select(keyword.word_rank(T.words(F.col("t")), ["retry", "queue"])).collect()]
    assert two == pytest.approx([0, 0, 1 - (1 - keyword.expected_closeness(1)) ** 2])


def test_rrf_scale(spark):
    arms = spark.createDataFrame([("keyword", f"p{i:02}", float(100 - i)) for i in range(30)], "arm string, path string, score double")
    got = {r["path"]: r["keyword"] for r in X.fused(arms, opts=X.Options(fused_min=0.0)).collect()}
    assert got["p00"] == pytest.approx(1.0)
    assert got["p26"] > 0 and got["p27"] == 0.0  # 61 / (60 + rank) >= .7 up to rank 27


def test_weights():
    """Weights by mode, intent and what was asked; each row sums to one."""
    w = X.weights_of
    assert w() == w("task") == (0.35, 0.2, 0.2, 0.1, 0.15) and w("relation") == (0.2, 0.15, 0.45, 0.1, 0.1) and w("person") == (0.25, 0.15, 0.15, 0.1, 0.35) and w("experience") == (0.3, 0.25, 0.15, 0.15, 0.15)
    assert w(semantic=False) == w("person", False) == (0.55, 0, 0.3, 0.1, 0.05) and w("relation", False) == (0.3, 0, 0.55, 0.1, 0.05)
    assert w(mode="conservative") == (0.75, 0, 0.15, 0.05, 0.05) and w(graph=False) == (0.45, 0.45, 0, 0.1, 0) and w(graph=False, semantic=False) == w(graph=False, mode="conservative") == (0.9, 0, 0, 0.1, 0)
    assert all(sum(w(i, s, m, g)) == pytest.approx(1) for i in X.WEIGHTS for s in (True, False) for m in ("balanced", "conservative") for g in (True, False))


def test_fusion_modes(spark):
    arms = spark.createDataFrame([("keyword", "a", 2.0), ("keyword", "b", 1.0), ("semantic", "b", 0.9), ("graph", "x/experiences/c", 1.0)], "arm string, path string, score double")
    boosts = spark.createDataFrame([("a", 1.0, 0.0), ("b", 0.3, 0.5)], "path string, title_path double, entity double")
    of = lambda **k: {r["path"]: (round(r["score"], 6), r["evidence"]) for r in X.fused(arms, boosts, **k).collect()}
    second = 61 / 62
    assert of() == {"a": (0.45, ["keyword", "title"]), "b": (round(0.35 * second + 0.2 + 0.03 + 0.075, 6), ["entity", "keyword", "path", "semantic"]), "x/experiences/c": (0.2, ["graph"])}
    assert of(mode="conservative")["b"] == (round(0.75 * second + 0.015 + 0.025, 6), ["entity", "keyword", "path"]) and of(graph=False)["a"][0] == 0.55
    assert of(intent="experience")["x/experiences/c"] == (round(0.15 + 0.15 * 0.3, 6), ["entity", "graph"])


def test_intents():
    from corpusloom.plans.search import intent_of

    want = {"谁负责支付": "relation", "网关的负责人": "relation", "A references B": "relation", "谁来": "person", "找 @lee": "person", "a@b": "person", "踩坑记录": "experience", "lesson of May": "experience", "修 bug": "task", "支付的超时": "relation", "支付的" + "很" * 40: "general", "hello": "general", " ": "general"}
    assert {q: intent_of(q) for q in want} == want


def test_expansion():
    e = keyword.expanded
    assert e("the retry queue") == ["the retry queue", "retry queue", "queue retry the"] and e("支付的超时") == ["支付的超时", "支付超时", "支 付 的 超 时"] and e("单") == ["单", "单 相关"] and e("queue") == ["queue", "queue 相关"] and e(" ") == []
    assert len(e("is the 支付 queue slow", 1)) == 2


def test_needles(spark):
    names = ["Alpha", "al", "the", "支付", "支", "alpha-beta", "beta", "什么", None, ""]
    df = spark.createDataFrame([(n,) for n in names], "n string").withColumn("hit", graph.needle_in(F.lit("what of the ALPHA and 支付网关 什么 alpha-beta?"), F.col("n")))
    assert [r["n"] for r in df.where("hit").collect()] == ["Alpha", "支付", "beta"]


def test_graph_arm(spark):
    """Seeds by alias; links that name the seed in part; pages by title; only pages are walked."""
    pages = spark.createDataFrame([(f"brains/b/{x}.md", t) for x, t in (("a", "A"), ("c", "C"), ("d", "D"), ("e", "About Alpha"), ("z", "Z"))], "path string, title string")
    links = spark.createDataFrame([("brains/b/a.md", "alpha team", "works_on"), ("brains/b/c.md", "brains/b/a.md", "mentions"), ("brains/b/d.md", "brains/b/c.md", "decided"), ("brains/b/z.md", "other", "mentions"), (None, "alpha", "x")], "from_path string, to_ref string, type string")
    people = spark.createDataFrame([("alpha", "active", "Al", '["alpha", "omega"]'), ("zed", "merged", "omega", None)], "slug string, status string, title string, aliases_json string")
    start = graph.start_of(people, links, "what about omega")
    assert [r["ref"] for r in start.collect()] == ["alpha"]
    got = [(r["path"][-4], r["depth"]) for r in graph.graph_search(pages, links, start).orderBy("depth", "path").collect()]
    assert got == [("a", 0), ("e", 0), ("c", 1), ("d", 2)]
    only = graph.graph_search(pages, links, graph.start_of(people, links, "who works at alpha"), verb="mentions")
    assert {r["path"][-4] for r in only.collect()} == {"a", "e", "c"}


def test_entity_boosts(spark):
    people = spark.createDataFrame([("b", "alpha", "alpha", "active", "Alpha Team", None), ("b", "old", "alpha", "merged", "Alpha Old", None), ("c", "alpha", "", "active", "Alpha Team", None)], "brain_id string, slug string, canonical_slug string, status string, title string, aliases_json string")
    pages = spark.createDataFrame([("b", "p1", "x", "met the Alpha team"), ("b", "p2", "y", "nothing"), ("d", "p3", "alpha", "")], "brain_id string, path string, title string, body_text string")
    links = spark.createDataFrame([("b", "p1", "Alpha"), ("b", "p1", "alpha"), ("b", "p2", "alpha"), ("d", "p3", "alpha")], "brain_id string, from_path string, to_ref string")
    asked = X.asked_entities(people, "Alpha T")
    assert [tuple(r) for r in asked.collect()] == [("b", "alpha", "Alpha Team"), ("c", "alpha", "Alpha Team")]
    got = {r["path"]: round(r["entity"], 2) for r in X.entity_boost(X.entity_mentions(pages, links, asked)).collect()}
    assert got == {"p1": 0.95, "p2": 0.5, "brains/b/entities/alpha.md": 0.8, "brains/c/entities/alpha.md": 0.8}


def test_local_rerank(spark):
    row = spark.range(1).select(X.local_rerank(F.lit("the retry queue"), F.lit("Retry"), "retry"), X.local_rerank(F.lit("q"), F.lit("retry"), "retry"), X.local_rerank(F.lit("x"), F.lit(None).cast("string"), " "), X.local_rerank(F.lit(None).cast("string"), F.lit("aa a"), "aaa")).first()
    assert row[:] == (3 + 2 + 4 * 0.5, 3 + 2 + 4 * 0.5, 0.0, 1.0)


def test_many_ties(spark):
    """400 hits with scores close together: the order of an insertion, worked out in plain Python."""
    import random

    rng = random.Random(2)
    kinds = ["brains/b/skills", "brains/b/experiences", "brains/b/sources/s/notes", "brains/b/x"]
    hits = [(f"{kinds[rng.randrange(4)]}/{i:03}.md", 0.5 + rng.randrange(60) * 0.0004) for i in range(400)]

    def ahead(a, b):
        la, lb = (next(i for i, k in enumerate(kinds) if x[0].startswith(k)) for x in (a, b))
        return la < lb if abs(a[1] - b[1]) < X.TIE and la != lb else (-a[1], a[0]) < (-b[1], b[0])

    want = []
    for h in sorted(hits, key=lambda h: (-h[1], h[0])):
        at = len(want)
        while at and ahead(h, want[at - 1]):
            at -= 1
        want.insert(at, h)
    got = X.layer_tie_order(spark.createDataFrame(hits, "path string, score double")).orderBy("place").collect()
    assert [r["path"] for r in got] == [h[0] for h in want]


def test_orphans(spark):
    pages = spark.createDataFrame([("b", "brains/b/notes/a.md", '{"tags": ["TMP"]}'), ("b", "brains/b/notes/b.md", "{}"), ("b", "brains/b/notes/c.md", None), ("c", "brains/c/notes/d.md", '{"temporary": true}'), ("c", "brains/c/notes/e.md", "{")], "brain_id string, path string, frontmatter_json string")
    links = spark.createDataFrame([("c", "brains/c/notes/e.md", "notes/a.md"), ("b", "x", "./notes/b.md"), ("b", "y", "c")], "brain_id string, from_path string, to_ref string")
    got = {r["path"][-4]: r["temporary"] for r in graph.orphan_notes(pages, links).collect()}
    assert got == {"a": True, "c": False, "d": True}  # a link of another brain saves nobody, nor does a bare name


def test_signals(spark):
    hits = spark.createDataFrame([("a", 0.99), ("b", 1.0), ("c", 0.5)], "path string, score double")
    links = spark.createDataFrame([("1", "a", "b", "m", "x"), ("2", "a", "c", "m", "y"), ("3", "z", "a", "m", "x")], "id string, from_path string, to_ref string, type string, source string")
    got = {r["path"]: r["score"] for r in X.hub_signal(hits, links).collect()}
    assert got["a"] == pytest.approx(0.99 * 1.05) and got["a"] > got["b"] == 1.0
    s = {r["path"]: r["score"] for r in X.diversified(spark.createDataFrame([("brains/b/sources/s/1.md", 1.0), ("brains/b/sources/s/2.md", 0.9)], "path string, score double")).collect()}
    assert s == pytest.approx({"brains/b/sources/s/1.md": 1.0, "brains/b/sources/s/2.md": 0.855})


def test_hotness(spark):
    assert spark.range(1).select(X.hotness(F.lit(30.0)), X.hotness(F.lit(0.0)), X.hotness(F.lit(None).cast("double"))).first()[:] == pytest.approx((0.5, 1.0, 0.5))


def test_tie_order(spark):
    hits = spark.createDataFrame([("n/notes/a.md", 0.5010), ("n/skills/b.md", 0.5000), ("n/notes/c.md", 0.4)], "path string, score double")
    assert {r["path"]: r["place"] for r in X.layer_tie_order(hits).collect()} == {"n/skills/b.md": 1, "n/notes/a.md": 2, "n/notes/c.md": 3}


def test_relations():
    assert graph.parse_relation("谁提到了支付") == ("支付", "mentions")
    want = {"谁负责支付网关": ("支付网关", "works_on"), "支付网关 的 负责人": ("支付网关", "works_on"), "支付的依赖": ("支付", "references"), "Alpha references": ("Alpha", "references"), "小王提到支付": ("支付", "mentions"), "提到了队列": ("队列", "mentions"), "Who works at Acme": ("Acme", "works_at"), "who founded Beta": ("Beta", "founded")}
    assert {q: graph.parse_relation(q) for q in want} == want
    assert [graph.parse_relation(q) for q in ("hello", "", "提到了 的", "who works at ...", "who founded " + "x" * 65)] == [None] * 5


def test_steps(spark):
    links = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("c", "d", "x"), (None, "a", "x")], "from_path string, to_ref string, type string")
    got = {r["node"]: r["depth"] for r in graph.within(links, spark.createDataFrame([("a",)], "ref string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_issues(spark):
    rows = [page("brains/b/ok.md", "t", "x"), page("../up.md", "", "x" * 200_001, "odd")]
    got = [r["issues"] for r in P.issues(spark.createDataFrame(rows, PAGES), ("note",)).orderBy("path").collect()]
    assert {(i["field"], i["message"]) for i in got[0]} == {("title", "missing"), ("status", "unknown"), ("body", "too long"), ("path", "unsafe")}
    assert got[1] == []


def test_hundred_bad_paths(spark):
    forms = ["/abs/{}", "../{}", "brains/c/{}", "brains/b/../c/{}", "C:/{}", "brains\\b\\{}", "brains/b/x/../../c/{}", "other/{}", "./../{}", "brains/bb/{}"]
    df = spark.createDataFrame([(forms[i % 10].format(i), "b") for i in range(100)], "path string, brain_id string")
    assert df.where(~P.unsafe_path(F.col("path"), F.col("brain_id"))).count() == 0


def test_batch_vectors(spark):
    import numpy as np

    from corpusloom.operators.semantic import batch_vector_search

    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    rows = [(f"p{i // 2:02}", v.tolist()) for i, v in enumerate(x)] + [("zero", [0.0] * 8), ("short", [1.0]), ("none", None), (None, [1.0] * 8)]
    got = batch_vector_search(spark.createDataFrame(rows, "path string, embedding array<float>"), spark.createDataFrame([(i, x[i].tolist()) for i in (0, 7)], "query_id long, vector array<float>"), 3)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for q in (0, 7):
        pooled = np.maximum.reduceat(u @ u[q], np.arange(0, 60, 2))
        assert [r["path"] for r in got.where(f"query_id = {q}").orderBy("rank").collect()] == [f"p{i:02}" for i in np.argsort(-pooled)[:3]]
    assert batch_vector_search(spark.createDataFrame(rows, "path string, embedding array<float>").limit(0), spark.createDataFrame([(1, [1.0] * 8)], "query_id long, vector array<float>")).count() == 0


def test_more_queries_than_a_block(spark):
    import numpy as np

    from corpusloom.operators.semantic import batch_vector_search

    x = np.random.default_rng(3).normal(size=(300, 8)).astype("float32")
    pages_ = [f"p{i // 3}" if i % 4 else "hot" for i in range(300)]
    chunks = spark.createDataFrame([(p, v.tolist()) for p, v in zip(pages_, x, strict=True)] + [("bad", [float("nan")] * 8), (None, [1.0] * 8)], "path string, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 300, 7)], "query_id long, vector array<float>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = batch_vector_search(chunks, queries, 4, block=10).collect()
    assert len(got) == 4 * 43
    for i in range(0, 300, 7):
        best = {"bad": 0.0}
        for p, s in zip(pages_, u @ u[i], strict=True):
            best[p] = max(best.get(p, -2), float(s))
        assert [r["path"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == i] == sorted(best, key=lambda p: -best[p])[:4]


def test_signals_broadcast_nothing_that_grows(spark, capfd):
    from corpusloom.operators import fusion as X

    hits = spark.createDataFrame([(f"brains/a/sources/s/{x}.md", 1.0) for x in "abcd"], "path string, score double")
    to = lambda x: f"brains/a/sources/s/{x}.md"
    links = spark.createDataFrame([(to("a"), to("b"), "wiki"), (to("a"), to("b"), "wiki"), (to("c"), "d", "wiki"), ("brains/a/sources/t/x.md", to("d"), "wiki"), (to("a"), "gone", "x")], "from_path string, to_ref string, source string")
    for few in (False, True):
        assert {r["path"][-4] for r in X.hub_signal(hits, links, few).collect() if r["score"] > 1} == {"a", "b"}
        assert {r["path"][-4] for r in X.cross_source_signal(hits, links, few).collect() if r["score"] > 1} == {"d"}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for f in (X.hub_signal, X.cross_source_signal):
            capfd.readouterr()
            f(hits, links).explain()
            assert "Broadcast" not in capfd.readouterr().out
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
