import random
from datetime import datetime

from pyspark.sql import functions as F

from corpusloom.llm import components, queries
from tests.oracle import DATA, difference

COLUMNS = "brain_id string, slug string, canonical_slug string, status string, title string, aliases_json string, content_hash string, updated_at timestamp"
T0, T1 = datetime(2026, 1, 1), datetime(2026, 2, 1)


def brute(edges):
    up = {}

    def root(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    for a, b in edges:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    return {v: root(v) for v in list(up)}


def test_against_union_find(spark):
    rng = random.Random(1)
    edges = [(f"v{rng.randrange(400):03}", f"v{rng.randrange(400):03}") for _ in range(330)] + [("solo", "solo")] + [("v000", "v001")] * 5
    got = {r["v"]: r["label"] for r in components.hash_to_min(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == brute(edges)


def test_long_chain_and_hub(spark, monkeypatch):
    """The hub is hot at any size here, so its cluster is spread over salts in every round."""
    from corpusloom.operators.skew import hot_keys

    monkeypatch.setattr(components, "hot_keys", lambda c, k, n, total=None: hot_keys(c, k, n, total, least=100))
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(150)]
    hub = [("hub", f"h{i:04}") for i in range(2000)]
    got = {r["v"]: r["label"] for r in components.hash_to_min(spark.createDataFrame(chain + hub, "a string, b string")).collect()}
    assert got == brute(chain + hub)


def test_empty_and_null(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None)], "a string, b string")
    assert components.hash_to_min(df).count() == 0


def groups(spark, rows):
    df = spark.createDataFrame([(b, s, c, st, "t", None, "h", at) for b, s, c, st, at in rows], COLUMNS).withColumns({"v": F.lit(1), "label": F.lit(2), "u": F.lit(3)})
    return {(r["brain_id"], r["slug"]): r["group_slug"] for r in components.redirect_groups(df).collect()}


def test_redirects(spark):
    rows = [
        ("b", "x", " Absent ", "MERGED ", T0), ("b", "w", "absent", "merged", T0), ("b", "m", "w", "merged", T0), ("b", "alone", "alone", "merged", T0), ("b", "void", "w", "active", T0), ("b", "one", "gone", "merged", T0),
        ("c", "x", "w", "merged", T0), ("b", "old", "m", "merged", T0), ("b", "old", "old", "active", T1), ("b", "r1", "r2", "merged", T0), ("b", "r2", "r1", "merged", T0), ("b", "nul", None, "merged", T0), (None, "q", "w", "merged", T0),
        ("b", "x", " Absent ", "MERGED ", T0),
    ]
    assert groups(spark, rows) == {("b", "x"): "m", ("b", "w"): "m", ("b", "m"): "m", ("b", "r1"): "r1", ("b", "r2"): "r1"}
    assert groups(spark, []) == {}


def test_sql(spark):
    for n in ("p2_found", "p2_records"):
        assert difference(spark, n, queries.QUERIES[n], queries.SQL[n], f"{DATA}/sf0.001") == ""
