"""References, sessions, records, outcomes, trends, links, readers and streams on small fixtures."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import distillation, indexing, linking, records, sessions, statistics
from corpusloom.operators.orphans import orphan_references
from corpusloom.sources import files
from corpusloom.streaming import streams

LINKS = "id string, from_path string, to_ref string, type string, source string, brain_id string, synced_at timestamp"
PAGES = "path string, status string, updated_at timestamp"
T0, T1, T2 = datetime(2026, 1, 5), datetime(2026, 1, 20), datetime(2026, 3, 1)
P = "brains/b/sources/s/notes"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(f"{P}/a.md", "active", T0), (f"{P}/gone.md", "active", T0), (f"{P}/gone.md", " Archived", T1), (f"{P}/late.md", None, T1), (f"{P}/later.md", "stale", T2), (f"{P}/会话 记录.md", "active", T0), (None, "active", T0)]
    return spark.createDataFrame(rows, PAGES)


def found(spark, rows, pages):
    links = spark.createDataFrame([(str(i), f, t, "m", "s", "b", at) for i, (f, t, at) in enumerate(rows)], LINKS)
    return {(r["id"], r["side"]): r["kind"] for r in orphan_references(links, pages).collect()}


def test_orphans(spark, pages):
    a = f"{P}/a.md"
    rows = [
        (a, f" {P}//a ", T1), (a, "sources/s/notes/%E4%BC%9A%E8%AF%9D%20%E8%AE%B0%E5%BD%95#top", T1), (a, "../notes\\a.md#x", T1), (a, "./nowhere", T1), (a, "https://x/y", T1), (a, "plain name", T1), (a, None, T1), (None, "./a", T1),
        (a, f"{P}/gone", T1), (a, f"{P}/late.md", T0), (a, f"{P}/late.md", T2), (a, f"{P}/later.md", T1), (f"{P}/none.md", a, T1), (a, f"{P}/late.md", datetime(2026, 1, 21)),
    ]
    assert found(spark, rows, pages) == {("3", "to"): "missing", ("8", "to"): "deleted", ("9", "to"): "late", ("11", "to"): "late", ("12", "from"): "missing"}


def test_orphans_of_empty_tables(spark, pages):
    assert found(spark, [], pages) == {}
    assert found(spark, [(f"{P}/a.md", None, T0)], spark.createDataFrame([], PAGES)) == {("0", "from"): "missing"}


def test_orphans_earliest_copy_counts(spark, pages):
    rows = [("x", f"{P}/a.md", f"{P}/late.md", "m", "s", "b", t) for t in (T2, T0, T2)]
    got = orphan_references(spark.createDataFrame(rows, LINKS), pages).collect()
    assert [(r["id"], r["kind"]) for r in got] == [("x", "late")]


def test_orphans_with_a_hot_page_and_clashing_columns(spark, pages, monkeypatch):
    from corpusloom.operators import orphans

    links = spark.range(3000).select(
        F.sha2(F.col("id").cast("string"), 256).alias("id"), F.lit(f"{P}/a.md").alias("from_path"), F.when(F.col("id") % 3 == 0, f"{P}/hot.md").otherwise(F.concat(F.lit(f"{P}/p"), F.col("id") % 50)).alias("to_ref"),
        F.lit("m").alias("type"), F.lit("s").alias("source"), F.lit("b").alias("brain_id"), F.lit(T1).alias("synced_at"), F.lit(1).alias("_salt"), F.lit(1).alias("kid"), F.lit(1).alias("month"),
    )
    monkeypatch.setattr(orphans, "hot_keys", lambda *a, **k: [f"{P}/hot.md", f"{P}/a.md"])
    got = orphan_references(links, pages.withColumn("kid", F.lit("x")))
    assert got.count() == 3000 and got.where("side = 'to' and kind = 'missing'").select("id").distinct().count() == 3000


def test_session_windows(spark):
    rows = [("s", i, "tool" if i == 2 else "user", "x" * 10) for i in range(1, 8)] + [("t", 1, "user", "y" * 50), ("t", 2, None, None)]
    df = spark.createDataFrame(rows, "session_id string, turn int, role string, text string")
    got = [tuple(r) for r in sessions.windows(df, max_turns=3, max_chars=40).orderBy("session_id", "window").collect()]
    assert got == [("s", 0, 1, 4, 3, 30, True), ("s", 1, 5, 7, 3, 30, True), ("t", 0, 1, 1, 1, 50, True), ("t", 1, 2, 2, 0, 0, False)]


def test_window_stream(spark, tmp_path):
    rows = [("s", i, "user", "x") for i in range(1, 8)]
    spark.createDataFrame(rows, "session_id string, turn int, role string, text string").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("session_id string, turn int, role string, text string").parquet(str(tmp_path / "in"))
    q = streams.window_stream(s, max_turns=3).writeStream.format("memory").queryName("win").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["window"], r["turns"]) for r in spark.sql("select * from win").collect()) == [(0, 3), (1, 3)]


def test_sync_and_repeat_streams(spark, tmp_path):
    df = spark.createDataFrame([("p", "old", T0), ("p", "new", T1), ("q", "x", T0)], "path string, content_hash string, updated_at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    got = []
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    streams.sync_stream(s, lambda b: got.extend((r["path"], r["content_hash"]) for r in b.collect()), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(got) == [("p", "new"), ("q", "x")]
    d = streams.repeats_dropped(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ["path"], "updated_at", "40 days")
    q = d.writeStream.format("memory").queryName("rep").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select * from rep").count() == 2


def test_truncation_and_gate(spark):
    df = spark.createDataFrame([(1, "s", 1, "user", "a" * 50), (2, "s", 2, "tool", "t"), (3, "s", 3, "user", "b" * 90), (4, "z", 1, "user", "c" * 500)], "turn_id long, session_id string, turn int, role string, text string")
    assert {r["turn_id"] for r in sessions.truncated(df, 100).collect()} == {2, 3, 4}
    ask = spark.createDataFrame([(1, "s", 1, "user", "What did we decide last time?"), (2, "s", 2, "user", "thanks"), (3, "s", 3, "user", None)], "turn_id long, session_id string, turn int, role string, text string")
    assert {r["turn_id"]: r["asks"] for r in sessions.recall_gate(ask).collect()} == {1: True, 2: False, 3: False}


def test_outcomes_clamp_in_order(spark):
    log = [(1, datetime(2026, 1, 1 + i // 3, i % 3), ok) for i, ok in enumerate([True] * 7 + [False] * 6 + [True])]
    got = distillation.outcome_fold(spark.createDataFrame(log, "k int, t timestamp, ok boolean"), "k", "t", F.col("ok")).first()
    eta = 0.5
    for _, _, ok in log:
        eta = min(1.0, max(0.0, eta + (0.1 if ok else -0.2)))
    assert got["eta"] == pytest.approx(eta) and (got["support"], got["failures"]) == (8, 6)


def test_trends(spark):
    rows = [(" Timeout_MS ", "2026-01", None, 5.0), ("timeout_ms", "2026-02", None, 4.0), ("up", "1", None, 5.0), ("up", "2", None, 6.0), ("one", "1", None, 1.0), ("zero", "1", None, 2.0), ("zero", "2", None, 0.0), ("zero", "3", None, 9.0), ("bad", "1", None, float("nan"))]
    got = {r["metric"]: (r["verdict"], r["drop"]) for r in statistics.trends(spark.createDataFrame(rows, "metric string, at string, period string, value double")).collect()}
    assert got["timeout_ms"] == ("regressing", pytest.approx(0.2)) and got["up"][0] == "stable" and got["one"][0] == "insufficient"
    assert got["zero"] == ("regressing", pytest.approx(1.0)) and "bad" not in got


def test_gate_cases(spark):
    rows = [("以前怎么做", 0, False), ("再试一次", 0, False), ("实现 ErrorCodes 新码", 0, False), ("hi", 0, False), ('<df-memory-context query="x">以前怎么做</df-memory-context> 继续', 0, False), ("随便写点", 0, True), ("/memory retry queue", 0, False), ("请查一下记忆", 0, False), ("timeout again here", 2, False), ("an error in api", 2, False), ("an error in api", 0, False), ("what is love", 0, False), (None, 0, True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, fails int, start boolean")
    got = df.withColumn("s", sessions.gate_score(F.col("t"), F.col("fails"))).select("i", sessions.gate_command(F.col("t"), F.col("s"), F.col("fails"), F.col("start")).alias("c")).orderBy("i").collect()
    assert [r["c"] for r in got] == ["find", None, "think", None, None, "think", "find", "find", None, "think", None, None, None]


def test_link_types():
    got = linking.links_in("张三负责[支付](p/a.md)。" + "x" * 50 + "[web](https://x.y) [me](mailto:a) [up](#top) ![img](i.png)" + "x" * 50 + "[[a/b]] " + "x" * 60 + " @lee founded it", '{"links": [{"to": "a/b"}, {"to": "z", "type": "advises"}, {"to": " "}, 3]}')
    assert got == [("p/a.md", "works_on", "markdown"), ("a/b", "references", "wikilink"), ("lee", "founded", "mention"), ("z", "advises", "frontmatter")]
    for text, kind in (("A decided [[B]]", "decided"), ("产出 [[B]]", "produced_by"), ("works  on [[B]]", "works_on"), ("属于 [[B]]", "belongs_to"), ("works_at [[B]]", "works_at"), ("创办 [[B]]", "founded"), ("invested in [[B]]", "invested_in"), ("顾问 [[B]]", "advises"), ("see [[B]]", "mentions"), ("decided and works on [[B]]", "decided")):
        assert linking.links_in(text) == [("B", kind, "wikilink")]
    assert linking.links_in("open ``` [[a]]", "{") == [("a", "mentions", "wikilink")] and linking.links_in("", "[]") == []


def test_links():
    text = "see [t](a/b.md) and [[a/b]] [[Name]] @who mail@x.y `[[code]]`\n```\n[[fence]]\n```"
    assert [(to, s) for to, _, s in linking.links_in(text)] == [("a/b.md", "markdown"), ("a/b", "wikilink"), ("Name", "wikilink"), ("who", "mention"), ("x", "mention")]
    assert linking.without_code("a `b` c") == "a     c" and linking.links_in("") == []
    assert linking.linkified("Ann Lee met Ann, @Ann and Annie", [("Ann", "ann"), ("Ann Lee", "ann-lee")]) == "@ann-lee met @ann, @Ann and Annie"


def test_records(spark):
    rows = [("b", "a", "B ", "Merged", "A", None, "h", T0), ("b", "b", "c", "merged", "B", '["b", "bee"]', "h", T0), ("b", "c", "x", "active", "C", '["bee"', "h", T0), ("b", "c", "c", "active", "old", None, "h", datetime(2020, 1, 1))]
    r = records.current_records(spark.createDataFrame(rows, "brain_id string, slug string, canonical_slug string, status string, title string, aliases_json string, content_hash string, updated_at timestamp"))
    assert {x["slug"]: (x["target"], x["steps"]) for x in records.resolved(r).collect()} == {"a": ("c", 2), "b": ("c", 1), "c": ("c", 0)}
    assert {(x["name"], x["slug"]) for x in records.name_table(r).collect()} >= {("bee", "b"), ("c", "c")}


def test_sync(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, content_hash string")
    assert {r["path"]: r["action"] for r in indexing.sync_plan(old, new).collect()} == {"a": "unchanged", "b": "update", "c": "delete", "d": "insert"}
    assert {tuple(r) for r in indexing.synced(old, new).collect()} == {("a", "1"), ("b", "2"), ("d", "1")}


def test_markdown(spark, tmp_path):
    root = tmp_path / "repo"
    for path, text in {
        "brains/b/sources/s/notes/1-a b.md": "---\ntitle: 标题\nstatus: archived\non: 2026-01-01\naliases: [x, y]\n---\nbody\n", "brains/b/skills/k/SKILL.md": "no head", "brains/b/.hidden/x.md": "no", "brains/b/sources/s/bad.md": "---\n: [\n---\nrest",
    }.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, encoding="utf-8")
    got = {r["path"]: r for r in files.pages_of(files.markdown_files(spark, str(root))).collect()}
    assert set(got) == {"brains/b/sources/s/notes/1-a b.md", "brains/b/skills/k/SKILL.md", "brains/b/sources/s/bad.md"}
    a = got["brains/b/sources/s/notes/1-a b.md"]
    assert (a["title"], a["status"], a["source_id"], a["brain_id"], a["aliases"], a["body_text"]) == ("标题", "archived", "s", "b", ["x", "y"], "body\n")
    assert json.loads(a["frontmatter_json"])["on"] == "2026-01-01"
    assert got["brains/b/skills/k/SKILL.md"]["source_id"] == "_skill" and got["brains/b/sources/s/bad.md"]["frontmatter_json"] == "{}"


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('\ufeff{"role": "User", "content": "hi"}\n\nnot json\n{"role": "x", "text": "t"}\n[1]\n', encoding="utf-8")
    rows = files.json_lines(spark, str(tmp_path / "a.jsonl"))
    got = [(r["line"], r["role"], r["text"], r["error"]) for r in files.turns_of(rows).orderBy("line").collect()]
    assert got == [(1, "user", "hi", None), (3, None, None, "not JSON"), (4, "x", "t", "unknown role"), (5, None, None, "no object")]
    (tmp_path / "b.json").write_text('[{"title": "t", "body": "b"}, {"message": {"text": "first\\nsecond"}, "session": "s"}]', encoding="utf-8")
    notes = files.notes_of(files.json_lines(spark, str(tmp_path / "b.json"))).orderBy("line").collect()
    assert [(n["title"], n["source"], n["error"]) for n in notes] == [("t", None, None), ("first", "s", None)]
    with pytest.raises(Exception, match="not JSON"):
        files.split_rejects(files.turns_of(rows), fail_fast=True)[0].collect()


def test_json_lines_in_splits(spark, tmp_path):
    """A file of many splits: every line once, with its number."""
    (tmp_path / "big.jsonl").write_text("\n".join("" if i % 10 == 9 else f'{{"role": "user", "text": "{i}"}}' for i in range(5000)), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = files.json_lines(spark, str(tmp_path / "big.jsonl"))
        assert spark.read.text(str(tmp_path / "big.jsonl")).rdd.getNumPartitions() > 4
        got = {r["line"]: r["text"] for r in files.turns_of(rows).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {i + 1: str(i) for i in range(5000) if i % 10 != 9}


def test_postings_are_read_by_term(spark, tmp_path):
    from corpusloom.operators import indexing

    pages = spark.createDataFrame([("b", f"p{i}", "retry" if i % 2 else "x", f"word{i} queue") for i in range(40)], "brain_id string, path string, title string, body_text string")
    indexing.write_postings(pages, str(tmp_path / "idx"))
    got = indexing.read_postings(spark, str(tmp_path / "idx"), ["retry", "word7", "none"])
    assert {(r["term"], r["path"]) for r in got.collect()} == {("retry", f"p{i}") for i in range(1, 40, 2)} | {("word7", "p7")}
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:80]


def test_pairs_of_facts(spark):
    from corpusloom.operators import maintenance

    f = spark.createDataFrame([(1, 0, "Limit is 5"), (1, 1, "the limit is 5 today"), (1, 2, " "), (1, 3, "y" * 45 + "a"), (1, 4, "Y" * 45 + "b"), (2, 0, "limit is 5"), (2, 1, None)], "path int, fact_index int, text string")
    assert {tuple(r) for r in maintenance.pairs_of_facts(f).collect()} == {(1, 0, 1), (1, 3, 4)}


def test_recent_duplicates(spark):
    old = spark.createDataFrame([(f"o{i}", t, datetime(2026, 1, 1 + i)) for i, t in enumerate(["the retry queue was slow on monday", "far too old to count", "支付超时重试策略", None])], "id string, title string, at timestamp")
    new = spark.createDataFrame([("n1", "the retry queue was slow on Monday", datetime(2026, 2, 1)), ("n2", "something else entirely", None), ("n3", "支付超时重试策略", None), ("n4", None, None)], "id string, title string, at timestamp")
    repeats = lambda most: distillation.recent_duplicates(new, old, "id", "title", "at", most, 0.9).where("repeats").collect()
    got = {(r["id"], r["nearest"]) for r in repeats(4)}
    assert got == {("n1", "o0"), ("n3", "o2")}
    assert {r["id"] for r in repeats(2)} == {"n3"} and distillation.recent_duplicates(new, old, "id", "title", "at").count() == 4 and distillation.recent_duplicates(new, old.limit(0), "id", "title", "at").count() == 0


def test_contract_json(spark):
    texts = ['say {"title": "a"} done', '```json\n{"title": "b"}\n``` and {', "no braces", "{broken", None, "} {", '{"a": {"b": 1}} x']
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", distillation.contract_json(F.col("t")).alias("j")).orderBy("i").collect()
    assert [r["j"] for r in got] == ['{"title": "a"}', '{"title": "b"}', None, None, None, None, '{"a": {"b": 1}}']


def test_a_cluster_names_its_checkpoint_folder():
    from corpusloom.session import named_folder

    assert named_folder("yarn", "hdfs://x/y") == named_folder("local[2]", "hdfs://x/y") == "hdfs://x/y" and named_folder("local[2]", None).startswith("/")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        named_folder("spark://host:7077", None)


def test_extractor_errors_are_rows(spark):
    def extractor(text):
        if text == "bad":
            raise ValueError("broken answer")
        return [{"title": text, "body": text}]

    w = spark.createDataFrame([("s", 0, "ok"), ("s", 1, "bad")], "session_id string, window int, text string")
    assert {(r["window"], r["type"]) for r in distillation.extracted(w, extractor).collect()} == {(0, "note"), (1, "error")}
    items = spark.createDataFrame([(1, "T", "x  y"), (2, "t", "X y"), (3, "u", "z")], "i int, title string, body string")
    assert {r["i"] for r in distillation.first_of_each(items, "i").collect()} == {1, 3}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "brain_id string, x int")
    files.write_by_brain(df, str(tmp_path / "t"))
    files.write_by_brain(spark.createDataFrame([("b", 3)], "brain_id string, x int"), str(tmp_path / "t"))
    assert {(r["brain_id"], r["x"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("a", 1), ("b", 3)}
    files.append_by_month(spark.createDataFrame([(T0, "x"), (T2, "y")], "at timestamp, v string"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).where("month = '2026-03'").count() == 1


def test_revert(spark):
    pages = spark.createDataFrame([("a", "new"), ("b", "made"), ("c", "kept")], "path string, body_text string")
    diffs = spark.createDataFrame([("merge", "a", "old"), ("create", "b", None)], "op string, path string, before string")
    assert {tuple(r) for r in distillation.reverted(pages, diffs).collect()} == {("a", "old"), ("c", "kept")}


def test_no_group_is_gathered_whole(spark):
    """think and outcome_fold over one hot group: no aggregate buffer grows with it."""
    import random
    from datetime import datetime, timedelta

    from corpusloom.operators import distillation
    from corpusloom.plans.search import think

    hits = spark.createDataFrame([(f"a/skills/{i}.md", float(i % 7)) for i in range(50)] + [("a/n.md", 1.0)], "path string, score double")
    assert {tuple(r) for r in think(hits).collect()} == {("skills", 50, "a/skills/13.md"), ("notes", 1, "a/n.md")}
    assert "collect_list" not in think(hits)._jdf.queryExecution().optimizedPlan().toString()

    rng, t0 = random.Random(2), datetime(2026, 1, 1)
    log = [(k, t0 + timedelta(microseconds=rng.choice([0, 7, 9_999, 10_000, 59_999_999, 60_000_000, rng.randrange(3 * 86_400_000_000)])), rng.random() < 0.6) for k in range(3) for _ in range(400)]
    got = {r["k"]: r for r in distillation.outcome_fold(spark.createDataFrame(log, "k int, t timestamp, ok boolean"), "k", "t", F.col("ok")).collect()}
    for k in range(3):
        eta = 0.5
        for _, _, ok in sorted(x for x in log if x[0] == k):
            eta = min(1.0, max(0.0, eta + (0.1 if ok else -0.2)))
        assert abs(got[k]["eta"] - eta) < 1e-9 and got[k]["support"] == sum(x[2] for x in log if x[0] == k) and got[k]["support"] + got[k]["failures"] == 400
    same = spark.createDataFrame([(1, t0, True)] * 500, "k int, t timestamp, ok boolean")
    plan = distillation.outcome_fold(same, "k", "t", F.col("ok"))
    assert plan.first()["eta"] == 1.0 and plan._jdf.queryExecution().optimizedPlan().toString().count("collect_list") == 4  # bounded pieces: one array a level


def test_lists_of_a_group_as_rows(spark):
    from corpusloom.operators import pages as P

    t = spark.createDataFrame([("a/1.md", "y"), ("a/2.md", None), ("a/3.md", "x"), ("b/1.md", "z")], "path string, title string")
    assert {tuple(r) for r in P.directory_titles(t).collect()} == {("a", 1, ""), ("a", 2, "x"), ("a", 3, "y")}
    r = spark.createDataFrame([("b", "old", "merged", "new", '["O", "N"]'), ("b", "new", "active", "new", '["N"]'), ("b", "z", "active", "z", None)], "brain_id string, slug string, status string, canonical_slug string, aliases_json string")
    assert {tuple(x) for x in records.merged_members(r).collect()} == {("b", "new", "old", "O"), ("b", "new", "old", "N"), ("b", "new", "new", "N"), ("b", "z", "z", None)}
    assert [tuple(x) for x in records.merged_records(r).collect()] == [("b", "new", 2, ["new", "old"], 2)]
