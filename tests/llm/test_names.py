from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import names

COLUMNS = "brain_id string, slug string, canonical_slug string, status string, title string, aliases_json string, content_hash string, updated_at timestamp"


def score(a, b):
    return names.similarity(names.name_of(a), names.name_of(b))


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("Bill Ulmpaquist", "William Ulmpaquist"), ("W. Ulmpaquist", "Bill Ulmpaquist"), ("Ulmpaquist, William", "WILLIAM ULMPAQUIST"), ("Leila A. Nadvadell", "Nadvadell LA"), ("LeilaNadvadell", "Leila A. Nadvadell"),
        ("Marta Grimkinör", "Marta Grimkinoer"), ("Jonsthan Branhadan", "Jonathan Branhadan"), ("Sue Grimduqiust", "Dr. Susan Grimduquist"), ("Märnydan Univ.", "Märnydan University"), ("The Brangedan Foods and Grain", "BRANGEDAN FOODS & GRAIN"),
        ("Tastudell Insurance Partners G.m.b.H.", "Tastudell Insurance Partners GmbH"), ("Prydovas Energy Assoc.", "Energy Association, Prydovas"), ("Xia Qi-ge", "Qige Xia"), ("Ebvimer Hldgs", "Ebvimer Holdings Ltd"),
    ],
)
def test_same(a, b):
    assert score(a, b) >= names.MIN_SCORE and score(b, a) >= names.MIN_SCORE


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("Leila Nadvadell", "Benjamin Nadvadell"), ("J. Silreton", "Daniel Silreton"), ("Benjamin L. Ost", "Benjamin W. Ost"), ("Féndumer Technologies 23", "Féndumer Technologies 24"), ("Jordonik Research Institute", "Jordonik Insurance Partners"),
        ("Christopher P. Sildobach", "Christopher S. Pelsoler"), ("Deng Sen-nuo", "Nuosen Deng"), ("Nadvadell", "Leila Nadvadell"), ("Foods & Grain", "Brangedan Foods & Grain"), ("", "x"),
    ],
)
def test_different(a, b):
    assert score(a, b) < names.MIN_SCORE and score(b, a) < names.MIN_SCORE


def test_collision_curve():
    b = names.bands_needed()
    assert 1 - (1 - names.LEAST_JACCARD**names.ROWS) ** b >= names.RECALL > 1 - (1 - names.LEAST_JACCARD**names.ROWS) ** (b - 1)


def test_record_names():
    assert names.record_name("KIP", ["n/a", "Keltasky Insurance Partners Inc."]) == "keltasky insurance partners"
    assert names.record_name("林格恩", ["Lin Geen"]) == "lin geen" and names.record_name("Mioturup, M.", ["Marta Mioturup", "me"]) == "marta mioturup"
    assert names.record_name("Ann Smithson", ["the team"]) == "ann smithson"
    assert names.aliases_of('["a", "Bob B', "a") == [] and names.aliases_of('["s", "Bob Bobson", "x', "s") == ["Bob Bobson"] and names.aliases_of(None, "x") == [] and names.aliases_of('{"a": 1}', "x") == []


def pairs(spark, rows):
    df = spark.createDataFrame([(b, s, None, st, t, a, "h", datetime(2026, 1, 1)) for b, s, st, t, a in rows], COLUMNS)
    df = df.withColumns({c: F.lit("x") for c in ("node", "band", "name", "kind", "entity")})
    return {tuple(r) for r in names.variant_pairs(df).collect()}


def test_pairs(spark):
    rows = [
        ("b", "1", "active", "William N. Ulmpaquist", None), ("b", "2", " ACTIVE", "Bill Ulmpaquist", '["2", "me"]'), ("b", "3", "active", "Ulmpaquist, W.", ""), ("b", "4", "active", "Wliliam Ulmpaquist", "["), ("b", "5", "merged", "William Ulmpaquist", None),
        ("c", "1", "active", "William Ulmpaquist", None), ("b", "6", "active", "UIP", '["6", "Ulmzodell Insurance Partners"]'), ("b", "7", "active", "UIP", '["7", "Umbatin Insurance Partners"]'), ("b", "8", "active", "Ulmzodell Insurance Partners AB", None),
        ("b", "9", "active", None, None), ("b", "a", "active", "me", None), ("b", "b", "active", "me", None), (None, "z", "active", "Bill Ulmpaquist", None), ("b", "2", " ACTIVE", "Bill Ulmpaquist", '["2", "me"]'), ("b", "c", "active", "x" * 50_000, None), ("b", "d", "active", "", None),
    ]
    assert pairs(spark, rows) == {("b", x, y) for x in "1234" for y in "1234" if x < y} | {("b", "6", "8")}
    assert pairs(spark, []) == set()


def test_initial_that_fits_two_people_is_left_alone(spark):
    rows = [("b", "1", "active", "Jonathan Silreton", None), ("b", "2", "active", "James Silreton", None), ("b", "3", "active", "J. Silreton", None), ("b", "4", "active", "Jon Silreton", None)]
    assert pairs(spark, rows) == {("b", "1", "4")}


def test_stars_are_greedy(spark):
    edges = [(1, 2), (1, 3), (1, 4), (4, 5), (5, 6), (7, 8)]
    w = spark.createDataFrame([(i, 0) for i in range(1, 9)], "node long, w long")
    got = {r["node"]: r["centre"] for r in names.star_clusters(spark.createDataFrame(edges, "a long, b long"), w).collect()}
    assert {got[n] for n in (1, 2, 3, 4)} == {1} and got[5] == got[6] and got[7] == got[8]


def test_a_third_of_all_rows_under_one_name(spark):
    rows = [("b", f"h{i:03}", "active", "Katherine Pryviquist", None) for i in range(60)] + [("b", f"p{i:03}", "active", f"Person{chr(97 + i % 26)}{chr(97 + i // 26)} Surname{chr(97 + i // 5 % 26)}{i}", None) for i in range(120)]
    got = pairs(spark, rows)
    assert {p for p in got if p[1].startswith("h") and p[2].startswith("h")} == {("b", f"h{i:03}", f"h{j:03}") for i in range(60) for j in range(i + 1, 60)}


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("Catherine Wong", "Cathy Wong"), ("Sophia Turner", "Sofia Turner"), ("Aleksandr Petrov", "Alexander Petrov"), ("Mohammed Ali Khan", "Muhammad Ali Khan"), ("Guillermo Diaz", "Memo Diaz"), ("Bertlesman Media Holdng", "Bertelsmann Media Holding"),
        ("Philipp Schmidt", "Filip Schmitt"), ("Cortuton MR", "Maria Rosa Cortuton"), ("Jeffrey Lewis", "Jeffery Lewis"), ("Krystyna Nowak", "Kristina Nowak"),
    ],
)
def test_names_people_type(a, b):
    assert score(a, b) >= names.MIN_SCORE and score(b, a) >= names.MIN_SCORE


@pytest.mark.parametrize(("a", "b"), [("Michael Wong", "Michelle Wong"), ("Anna Keller", "Peter Keller"), ("Martin Keller", "Martina Kellner"), ("Christopher Halnobach", "Christopher Halcobeck"), ("Bosch GmbH", "Bosch Ltd"), ("Sara Lee", "Sara Li Ming")])
def test_other_people(a, b):
    assert score(a, b) < names.MIN_SCORE and score(b, a) < names.MIN_SCORE


def test_soft_distance():
    d = names.soft_distance
    assert d("moamed", "muamad") == 1.0 and d("abc", "acb") == 1.0 and d("abac", "abec") == 0.5 and d("abc", "abcde") == float("inf") and d("", "") == 0 and d("abb", "aec") == float("inf")


def test_short_names_link_when_equal(spark):
    rows = [("b", "1", "active", "Bosch GmbH", None), ("b", "2", "active", "Bosch G.m.b.H.", "[]"), ("b", "3", "active", "Bosch Ltd", None), ("b", "4", "active", "张伟", None), ("b", "5", "active", "张伟", None), ("b", "6", "active", "Weber", None), ("b", "7", "active", "Anna Weber", None), ("b", "8", "active", "??", None), ("b", "9", "active", "??", None)]
    assert pairs(spark, rows) == {("b", "1", "2"), ("b", "4", "5")}


def test_long_chain_of_stars(spark):
    """A chain of rising weight is clustered to its end, however many rounds that takes."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 160)], "a long, b long")
    w = spark.createDataFrame([(i, i) for i in range(1, 161)], "node long, w long")
    got = {r["node"]: r["centre"] for r in names.star_clusters(edges, w).collect()}
    assert len(got) == 159 and all(abs(n - c) <= 1 for n, c in got.items())  # node 1, whose only neighbour is taken, stands alone


def test_blocks_give_every_pair_once(spark):
    df = spark.createDataFrame([(k, f"m{i:02}", n) for k, n in (("x", 23), ("y", 1), ("z", 5)) for i in range(n)], "k string, m string, n long")
    got = [tuple(r) for r in names.pairs_in_blocks(df, ["k"], "m", block=4).collect()]
    assert sorted(got) == sorted((k, f"m{i:02}", f"m{j:02}") for k, n in (("x", 23), ("z", 5)) for j in range(n) for i in range(j))


def test_brains_with_many_names(spark, monkeypatch):
    rows = [("b", f"{i}", "active", t, None) for i, t in enumerate(["Bill Ulmpaquist", "William Ulmpaquist", "Ulmpaquist, Wiliam", "Marta Grimkin", "Marta Grimkim", "Leila Nadvadell", "Jon Silreton", "Jonathan Silreton"])]
    want = pairs(spark, rows)
    monkeypatch.setattr(names, "WIDE", 2)
    monkeypatch.setattr(names, "BLOCK", 2)
    assert pairs(spark, rows) == want and len(want) == 5
