import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import conversations, queries
from tests.oracle import DATA, difference

TURNS = "turn_id long, session_id string, turn int, role string, text string, at string"


@pytest.mark.parametrize(
    ("at", "want"),
    [
        ("2026-02-21 06:42:20", 1771656140), ("2026-02-21T06:42:20Z", 1771656140), ("2026-02-21T06:42:20.000Z", 1771656140), ("2026-02-21T14:42:20+08:00", 1771656140), ("2026-02-21T12:12:20+0530", 1771656140),
        ("2026-02-21T01:42:20-05:00", 1771656140), ("2026/02/21 06:42:20", 1771656140), ("1771656140000", 1771656140), (" 1771656140000 ", 1771656140), ("unknown", None), ("Invalid Date", None), ("", None), (None, None), ("2026-13-40T00:00:00Z", None),
        ("now", None), ("2026-02-21", 1771632000),
    ],
)
def test_instants(spark, at, want):
    got = spark.createDataFrame([(at,)], "at string").select(conversations.instant_of(F.col("at"))).first()[0]
    assert got == (want * 1_000_000 if want is not None else None)


def kept(spark, rows, sessions=("s",)):
    df = spark.createDataFrame(rows, TURNS).withColumns({"block": F.lit(1), "n": F.lit("x"), "pos": F.lit(0)})
    meta = spark.createDataFrame([(s,) for s in sessions], "session_id string").withColumn("turn", F.lit(1))
    return [(r["session_id"], r["pos"], r["turn_id"]) for r in conversations.kept_messages(df, meta).orderBy("session_id", "pos").collect()]


def talk(*messages, sid="s"):
    return [(i + 1, sid, i + 1, role, text, at) for i, (role, text, at) in enumerate(messages)]


def test_order_roles_and_blanks(spark):
    rows = talk(("Human", "q", "1000"), ("bot", "late", "9000"), ("tool", "t", "bad"), ("user", "​ ﻿", "2000"), ("AI", "a", "3000"), ("system", "<x-memory-context a='b'>\nz</x-memory-context> ", "1"))
    assert kept(spark, rows, [" s\t"]) == [("s", 1, 1), ("s", 2, 5), ("s", 3, 2), ("s", 4, 3)]


@pytest.mark.parametrize(
    "rows",
    [
        talk(("user", "q", "0"), ("user", "q2", "601000"), ("assistant", "a", "602000")), talk(("assistant", "a", "0"), ("user", "q", "1"), ("assistant", "a", "2")), talk(("user", "q", "0")), talk(("user", "q", "0"), ("narrator", "x", "1"), ("assistant", "a", "2")),
        talk(("user", "q", "0"), (None, "x", "1"), ("assistant", "a", "2")), talk(("user", " ", "0"), ("assistant", None, "2")), talk(("system", "x", "0")), [(1, "s", 1, "user", "q", "0"), (2, "s", 3, "assistant", "a", "1")],
        [(1, "s", None, "user", "q", "0"), (2, "s", 1, "assistant", "a", "1")], talk(("user", "q", "0"), ("assistant", "a", "1"), sid="other"), talk(("user", "q", "0"), ("assistant", "a", "1"), sid=None), [],
    ],
)
def test_dropped(spark, rows):
    assert kept(spark, rows) == []


def test_repeats_and_close_questions(spark):
    rows = talk(("user", "q", "0"), ("user", "q2", "600000"), ("assistant", "a", "601000")) + [(9, "s", 2, "narrator", "copy", "5")]
    assert [t for _, _, t in kept(spark, rows)] == [1, 2, 3]


def plain(rows, gap=600_000):
    """The rules in plain Python, for rows with readable instants."""
    out, by = [], {}
    for tid, sid, turn, role, _, at in rows:
        by.setdefault(sid, []).append((int(at), turn, role, tid))
    for sid, ms in by.items():
        ms.sort()
        said = [m for m in ms if m[2] in ("user", "assistant")]
        if said and said[0][2] == "user" and said[-1][2] == "assistant" and not any(a[2] == b[2] == "user" and b[0] - a[0] > gap for a, b in zip(said, said[1:], strict=False)):
            out += [(sid, i + 1, m[3]) for i, m in enumerate(ms)]
    return sorted(out)


def test_one_session_of_many_blocks(spark, monkeypatch):
    """A session that exceeds a block is split, and gives the same as the rules in plain Python; ties and one shared instant too."""
    monkeypatch.setattr(conversations, "BLOCK", 50)
    monkeypatch.setattr(conversations, "CUTS", 8)
    rng = random.Random(2)
    rows, tid = [], 0
    for sid, n, spread in (("big", 900, 40), ("flat", 300, 1), ("small", 6, 3), ("far", 400, 5000)):
        for turn in range(1, n + 1):
            tid += 1
            role = "user" if turn == 1 else "assistant" if turn == n else rng.choice(["user", "assistant", "tool"])
            at = 0 if turn == 1 else 10**9 if turn == n and sid != "far" else rng.randrange(spread) * 1000
            rows.append((tid, sid, turn, role, "x", str(at)))
    assert kept(spark, rows, ["big", "flat", "small", "far"]) == plain(rows)


def test_texts(spark):
    df = spark.createDataFrame(talk(("user", "<a-memory-context>x</a-memory-context> hello", "0"), ("assistant", "y" * 100_000, "1")), TURNS)
    got = conversations.conversations(df, spark.createDataFrame([("s",)], "session_id string")).orderBy("pos").collect()
    assert [len(r["text"]) for r in got] == [5, 100_000]


def test_sql(spark):
    assert difference(spark, "p3_found", queries.QUERIES["p3_found"], queries.SQL["p3_found"], f"{DATA}/sf0.001") == ""
    assert queries.QUERIES["p3_gaps"](spark, f"{DATA}/sf0.001").count() > 0


def test_gaps_over_all_borders(spark, monkeypatch):
    """Every message but the first has its gap, in sessions far beyond a block, in the order of instants."""
    rng, rows = random.Random(3), []
    for sid, n in (("long", 9000), ("short", 7), ("one", 1)):
        at = [rng.randrange(0, n * 400) if i % 3 else 5_000 for i in range(n)]
        rows += [(len(rows) + i, sid, i + 1, "user" if i % 2 else "bot", "x", str(1_700_000_000_000 + 1000 * t)) for i, t in enumerate(at)]
    rows += [(10**6, "short", 8, "user", " ", "1700000000000"), (10**6 + 1, "short", 9, "who", "x", "1700000000000"), (10**6 + 2, "short", 10, "user", "x", "?"), (10**6 + 3, None, 1, "user", "x", "1")]
    gaps = []
    for sid in ("long", "short"):
        at = sorted(int(r[5]) / 1000 for r in rows if r[1] == sid and r[3] != "who" and r[5] != "?" and r[4] == "x")
        gaps += [b - a for a, b in zip(at, at[1:], strict=False)]
    got = {r["role"]: r for r in conversations.calibrated_gap(spark.createDataFrame(rows, TURNS), 1.0).collect()}
    assert sum(r["n"] for r in got.values()) == len(gaps) and max(r["gap_s"] for r in got.values()) == max(gaps)
    assert conversations.calibrated_gap(spark.createDataFrame([], TURNS)).count() == 0
