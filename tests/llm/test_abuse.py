import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import abuse
from corpusloom.tables import table
from tests.oracle import DATA

NICE = ["Please review the queue of {}.", "The {} report is slow today.", "We moved the {} job to Friday.", "I hate this {}, it is garbage.", "Rule 3: messages like you idiot are rejected by the {}.", "我们决定归档{}的缓存。"]
NASTY = ["You are a stupid idiot, {}.", "Shut up, you worthless idiot of {}.", "All {} people are rats and should be driven out.", "你这个垃圾，滚出{}。", "Nobody would miss you, {}, go die."]
NAMES = ["Kallavas", "Norvidan", "Ostgevas", "Fenrogard", "Lunrebert", "Tasridor", "Velcomar", "Brajurith", "Istlorup", "Zeltumer"]


def corpus():
    docs, bad = [], []
    for i in range(200):
        a, b, n = NICE[i % 6].format(NAMES[i % 10]), NICE[(i * 5 + 1) % 6].format(NAMES[(i * 3) % 10]), NASTY[i % 5].format(NAMES[(i * 7) % 10])
        bad.append(i % 4 == 0)
        docs.append(f"{a} {n} {b}" if bad[-1] else f"{a}\n{b}")
    return docs, np.array(bad)


def test_held_out_accuracy():
    docs, bad = corpus()
    w, bias, threshold = abuse.learn(docs[:140], bad[:140])
    z = abuse.judge(docs[140:], w, bias)
    assert np.mean((z > threshold) == bad[140:]) >= 0.95


def test_disguises():
    docs, bad = corpus()
    w, bias, threshold = abuse.learn(docs, bad)
    plain = "You are a stupid idiot, Kallavas."
    for t in (plain, plain.upper(), "You are a stup1d 1d10t, Kallavas.", "You are a s t u p i d  i d i o t, Kallavas.", "You are a stuuupid idiiiot, Kallavas.", "You аre а stuріd іdіоt, Kallavas.", "You are a stu​pid id​iot, Kallavas.", "你 这 个 垃*圾，滚出Kallavas。"):
        assert abuse.judge([t], w, bias)[0] > threshold, t
    for t in ("The Kallavas report is slow today.", "", None, " ", "　\n", "0" * 5000):
        assert abuse.judge([t], w, bias)[0] <= threshold, t
    long = "The Kallavas report is slow today. " * 3000
    assert abuse.judge([long + plain], w, bias)[0] > threshold >= abuse.judge([long], w, bias)[0]


def test_normal():
    assert abuse.normal("\\u4f60\\n&amp;") == "你\n&" and abuse.normal("Call 112 or 4 people") == "call 0 or 0 people" and abuse.normal("ＡＢＣ ß") == "abc ss"
    assert abuse.normal("p.i.g, s-e-x and B r e a k; a b c") == "pig, sex and break; a b c"
    assert all(len(s) <= abuse.LONG for s in abuse.sentences("x" * 10_000)) and abuse.sentences("") == []


def test_short_sentences_are_scored():
    assert abuse.sentences(abuse.normal("傻逼")) == ["傻逼"] and abuse.sentences("贱人\n好。a") == ["贱人", "好。", "a"]
    docs, bad = corpus()
    docs, bad = [*docs, *[f"{n}的缓存。\n傻逼\n我们归档了{n}。" for n in NAMES]], np.concatenate([bad, np.ones(10, bool)])
    w, bias, threshold = abuse.learn(docs, bad)
    assert abuse.judge(["傻逼"], w, bias)[0] > threshold >= abuse.judge(["缓存"], w, bias)[0]


def test_fitted_once(spark, monkeypatch):
    docs, bad = corpus()
    d, v = tables(spark, [(i, "s", t) for i, t in enumerate(docs)], [(i, "abusive" if b else "ok") for i, b in enumerate(bad)])
    calls, real = [], abuse.labelled
    monkeypatch.setattr(abuse, "labelled", lambda *a: calls.append(1) or real(*a))
    first, again = abuse.fitted(d, v), abuse.fitted(d.select("*"), v)
    assert first is again and len(calls) == 1
    assert abuse.fitted(d.where("doc_id > 3"), v) is not first and len(calls) == 2


def tables(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumns({c: F.lit("x") for c in ("score", "flagged", "bad", "b", "o", "label")})
    return d, spark.createDataFrame(labels, "doc_id long, label string").withColumn("text", F.lit("clash"))


def test_scores_and_rates(spark):
    docs, bad = corpus()
    rows = [(i, None if i % 10 == 0 else f"s{i % 3}", t) for i, t in enumerate(docs)] + [(900, "s1", None), (901, None, ""), (5, "s2", docs[5])]
    labels = [(i, "abusive" if b else "ok") for i, b in enumerate(bad[:160])] + [(0, None), (0, "unsure"), (None, "ok"), (777, "ok"), (1, "hateful")]
    s = abuse.scores(*tables(spark, rows, labels)).cache()
    got = {r["doc_id"]: r for r in s.collect()}
    assert s.count() == len(rows) and not got[900]["flagged"] and not got[901]["flagged"]
    assert np.mean([got[i]["flagged"] == bad[i] for i in range(160, 200)]) >= 0.95
    r = {x["source"]: x for x in abuse.rates(s).collect()}
    assert set(r) == {None, "s0", "s1", "s2"} and sum(x["n_docs"] for x in r.values()) == len(rows) and all(x["rate"] == x["n_flagged"] / x["n_docs"] for x in r.values())


def test_without_labels(spark):
    d, none = tables(spark, [(1, "s", "you idiot")], [])
    assert [r["flagged"] for r in abuse.scores(d, none).collect()] == [False]
    d, one = tables(spark, [(1, "s", "you idiot")], [(1, "abusive")])
    assert abuse.scores(d, one).count() == 1 and abuse.scores(d.limit(0), one).count() == 0


def test_given_labels(spark):
    """Half of the labelled documents, scored by a model that never saw them."""
    d = f"{DATA}/sf0.1"
    docs, labels = table(spark, d, "documents").where("text is not null"), table(spark, d, "doc_labels")
    s = abuse.scores(docs, labels.where("doc_id % 2 = 0"))
    v = labels.where("doc_id % 2 = 1").groupBy("doc_id").agg(F.sum(F.col("label").isin(*abuse.BAD).cast("int")).alias("b"), F.sum((F.col("label") == "ok").cast("int")).alias("o")).where("b + o >= 2 and (b = 0 or o = 0)")
    r = v.join(s, "doc_id").agg(F.avg((F.col("flagged") == (F.col("b") > 0)).cast("double")).alias("right"), F.count(F.lit(1)).alias("n")).first()
    assert r["n"] > 100 and r["right"] >= 0.88
