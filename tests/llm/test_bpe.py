import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import bpe
from corpusloom.tables import table
from tests.oracle import DATA

VOCABULARY = f"{bpe.TOKENIZERS}/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(VOCABULARY)


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def encoded(texts, v):
    ids, at = bpe.encode_block(texts, v, regex.compile(bpe.PATTERN).findall)
    return [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]


def test_known_cases(vocabulary, reference):
    texts = [None, "", " ", "\r\n\r\n  x", "aaaaaaaaa aaaa aa a", "abababab", "支付超时𠮷👩🏽‍💻", "<|endoftext|>", "x" * 50_000, "it's I'll 'd", "\x00\x7f�", "é" * 31, "١٢٣ 123"]
    assert encoded(texts, vocabulary) == reference(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="ab c'\n的了", max_size=80)), max_size=8))
def test_any_text(vocabulary, reference, texts):
    assert encoded(texts, vocabulary) == reference(texts)


def test_round_trip(vocabulary, reference):
    import json

    letters = bpe.byte_letters()
    token = {i: bytes(letters[c] for c in t) for t, i in json.load(open(VOCABULARY, encoding="utf-8"))["model"]["vocab"].items() if all(c in letters for c in t)}
    texts = ["Wir prüfen 12 Seiten.\n", "教训：共享的融合步骤"]
    assert [b"".join(token[i] for i in ids).decode() for ids in encoded(texts, vocabulary)] == texts


def test_documents(spark, reference, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 5000)  # several blocks in a partition
    docs = table(spark, f"{DATA}/sf0.001", "documents").withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode(docs).collect()}
    want = docs.select("doc_id", "text").collect()
    assert got == dict(zip([r["doc_id"] for r in want], reference([r["text"] for r in want]), strict=True))
    assert bpe.encode(docs.limit(0)).count() == 0
