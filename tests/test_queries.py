"""Every core query against its SQL on the smallest tables; those without SQL run and give rows."""

import pytest

from corpusloom.queries import all_queries, all_sql
from tests.oracle import DATA, difference

SMALL = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, name):
    fn, sql = all_queries()[name], all_sql().get(name)
    if sql:
        assert difference(spark, name, fn, sql, SMALL) == ""
    else:
        assert fn(spark, SMALL).count() > 0


def test_every_sql_has_a_query():
    assert set(all_sql()) <= set(all_queries())


def test_llm_is_not_imported_by_the_rest():
    import ast
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "corpusloom"
    for p in root.rglob("*.py"):
        if "llm" in p.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("corpusloom.llm" in n for n in names), p


def test_bigrams_and_embeddings_of_whole_texts(spark, tmp_path):
    from collections import Counter

    from corpusloom.queries import all_queries

    texts = ["", None, "a", " 会话 队列 ", "Retry\nQueue 重试" * 3, "x\u3000y", "ab " * 20_000]
    d = str(tmp_path)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string").write.parquet(f"{d}/chunks.parquet")

    def grams(t):
        t = "".join(c for c in (t or "").lower() if c not in " \n\t")
        return [t] if len(t) == 1 else [t[i : i + 2] for i in range(len(t) - 1)]

    def vector(t):
        v = [0.0] * 64
        for g in [t] if len(t or "") == 1 else [t[i : i + 2] for i in range(len(t or "") - 1)]:  # the text as it is
            h = 2166136261
            for c in g:
                h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
            v[h % 64] += 1 if h % 2 == 0 or len(t) == 1 else -1
        n = sum(x * x for x in v) ** 0.5
        return [x / n if n else 0.0 for x in v]

    got = {r["gram"]: r["n"] for r in all_queries()["text_bigram_tokens"](spark, d).collect()}
    assert got == Counter(g for t in texts for g in grams(t))
    for r in all_queries()["text_hash_embedding"](spark, d).collect():
        assert max(abs(a - b) for a, b in zip(r["vector"], vector(texts[int(r["id"])]), strict=True)) < 1e-4
