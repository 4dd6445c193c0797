"""Scores of documents for abusive, hateful or sexual language.

Method: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios, trained on
the labelled documents.

A document is judged by its worst sentence. Labels are given per document, so training is in rounds: the ratios start
from counts over whole documents; then the worst sentence of each offensive document stands for it against all
sentences of the documents that are fine, the ratios are counted anew, and a logistic model is fitted on the scaled
features. The worst sentences of documents that are fine weigh more than their others, and labelled documents that
the model contradicts strongly (raters err) are left out of the last rounds. The threshold is the one with the best F1 on
the quarter of the labelled documents that is held out.

* Fitting takes at most TRAIN_BAD offensive and TRAIN_GOOD other labelled documents (documented bound), chosen by a hash
  of their ids; it is one task, and its model is shared by the queries of a session.
* Scoring is one pass in place over all documents, whole texts: n-grams are rolling hashes over an array of code points,
  so it costs a few array operations per n. No shuffle but the small one of rates per source.

Cases: null, empty and blank texts score 0 of probability; a sentence may be a single character; labels null or ``unsure`` don't count, ties leave a document
out; spellings with look-alike letters, digits for letters, stretched, spaced or dotted letters and invisible characters
are read as the plain word; a null source is a source of its own; without labels of both kinds all scores are 0.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_BAD, TRAIN_GOOD = 1500, 2000
BUCKETS = 1 << 18
SIZES = (2, 3, 4, 5)
LONG = 240
#: Labels that the model contradicts by so much (in logits) are taken for errors.
TRUST = 2.0
BAD = ("abusive", "hateful", "sexual")
_FITTED: list[tuple] = []

#: Letters of other scripts that look like Latin ones, and signs written for letters.
LOOKALIKE = str.maketrans("аеорсухіјѕԁһӏԛԝвнкмтαβεικνορτυχγѵ", "aeopcyxijsdhlqwbhkmtabeiknoptuxyv")
LEET = str.maketrans("0134578@$!", "oieastbasi")


def _class(chars: Iterable[int]) -> re.Pattern:
    return re.compile("[" + "".join(f"\\U{c:08x}" for c in chars) + "]+")


_INVISIBLE = _class([*(c for c in range(0x3000) if unicodedata.category(chr(c)) == "Cf"), 0xFEFF])
# a class beyond 16 bits is slow, and rarely needed
_MARKS = _class(c for c in range(0x10000) if unicodedata.category(chr(c)) == "Mn")
_WIDE_MARKS = _class(c for c in range(0x10000, 0x110000) if unicodedata.category(chr(c)) == "Mn")
_WIDE = re.compile("[\U00010000-\U0010ffff]")
_JSON = re.compile(r'\\u([0-9a-fA-F]{4})|\\([nrt"/\\])')
#: Letters set apart: four or more by blanks, three or more by signs.
_SPACED = re.compile(r"(?<![^\W_])(?:(?:[^\W\d_][ .*_\-~|]+){3,}|(?:[^\W\d_][.*_\-~|]+){2,})[^\W\d_](?![^\W_])")
_HAN = "㐀-䶿一-鿿"
_HAN_GAP = re.compile(rf"(?<=[{_HAN}])[ *._\-~|·]+(?=[{_HAN}])")
_MIXED = re.compile(r"(?<![\w@$!])(?=[\w@$!]*[a-z])(?=[\w@$!]*[0134578@$!])[\w@$!]*[\w@$](?![\w@$])")
_STRETCH = re.compile(r"([^\W\d_])\1{2,}")
_DIGITS = re.compile(r"\d+")
_SIGNS = re.compile(r"[\s!-@\[-`{-~]*")
_SENTENCE = re.compile(r"[^.!?。！？；;\n\r]+[.!?。！？；;]*")


def _latin(c: str) -> bool:
    return c.isascii() and c.isalpha()


def normal(text: str) -> str:
    """The text as it is meant to be read, lower case."""
    if "\\" in text:
        text = _JSON.sub(lambda m: chr(int(m[1], 16)) if m[1] else {"n": "\n", "r": "\n", "t": " "}.get(m[2], m[2]), text)
        text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    if "&" in text:
        text = html.unescape(text)
    if text.isascii():
        text = text.lower()
    else:
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)).casefold().translate(LOOKALIKE)
        text = _MARKS.sub("", unicodedata.normalize("NFD", text))
        if _WIDE.search(text):
            text = _WIDE_MARKS.sub("", text)
        text = unicodedata.normalize("NFC", text)
    text = _MIXED.sub(lambda m: m[0].translate(LEET) if sum(map(_latin, m[0])) >= sum(c.isdigit() for c in m[0]) else m[0], text)
    text = _SPACED.sub(lambda m: re.sub(r"[ .*_\-~|]+", "", m[0]), text)
    text = _HAN_GAP.sub("", text)
    text = _STRETCH.sub(r"\1", text)
    return _DIGITS.sub("0", text)


def sentences(text: str) -> list[str]:
    """The sentences of a text but those of digits and ASCII signs alone; one beyond LONG characters as overlapping stretches."""
    out = []
    for m in _SENTENCE.finditer(text):
        s = m[0].strip()
        if _SIGNS.fullmatch(s):
            continue
        if len(s) <= LONG:
            out.append(s)
        else:
            out += [s[i : i + LONG] for i in range(0, len(s) - LONG // 4, LONG * 3 // 4)]
    return out


def grams(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, bucket) of every n-gram of every sentence, with repeats."""
    joined = "\x02" + "\x02\x02".join(parts) + "\x02"
    cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    lens = np.fromiter((len(p) + 2 for p in parts), np.int64, len(parts))
    owner = np.repeat(np.arange(len(parts)), lens)
    h = np.zeros(len(cp), np.uint64)
    rows, cols = [], []
    for n in range(1, SIZES[-1] + 1):
        m = len(cp) - n + 1
        if m <= 0:
            break
        h = (h[:m] * np.uint64(0x100000001B3)) ^ (cp[n - 1 :] + np.uint64(0x9E3779B97F4A7C15))
        if n in SIZES:
            inside = owner[:m] == owner[n - 1 :]
            x = h * np.uint64(0xD6E8FEB86659FD93) + np.uint64(n)
            rows.append(owner[:m][inside])
            cols.append(((x >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)[inside])
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(rows), np.concatenate(cols)


class Fit:
    """Training over sentences: which document each belongs to, and the buckets it has."""

    def __init__(self, texts: list[str], bad: np.ndarray):
        self.bad, self.n = bad, len(texts)
        number: dict[str, int] = {}
        owner, sent = [], []
        for d, t in enumerate(texts):
            for s in dict.fromkeys(sentences(normal(t))):
                owner.append(d)
                sent.append(number.setdefault(s, len(number)))
        self.owner, self.sent = np.array(owner, np.int64), np.array(sent, np.int64)  # one row per sentence of a document
        parts = list(number)
        r, c = [], []
        for at in range(0, len(parts), 4000):
            a, b = grams(parts[at : at + 4000])
            r.append((a + at).astype(np.int32))
            c.append(b.astype(np.int32))
        self.rows, self.cols = np.concatenate(r), np.concatenate(c)
        by = np.argsort(self.rows, kind="stable")
        self.rows, self.cols = self.rows[by], self.cols[by]
        self.by_col = np.argsort(self.cols, kind="stable").astype(np.int32)
        self.size = np.bincount(self.rows, minlength=len(parts))
        self.start = np.cumsum(self.size) - self.size
        self.parts = parts

    def ratios(self, pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
        """log ((p + 1) / (all p) / ((q + 1) / (all q))) from weights per sentence."""
        p = np.bincount(self.cols, weights=pos[self.rows], minlength=BUCKETS)
        q = np.bincount(self.cols, weights=neg[self.rows], minlength=BUCKETS)
        return np.log((p + 1) / (pos.sum() + 2)) - np.log((q + 1) / (neg.sum() + 2))

    def scores(self, w: np.ndarray, bias: float = 0.0) -> np.ndarray:
        return np.bincount(self.rows, weights=w[self.cols], minlength=len(self.size)) / np.sqrt(np.maximum(self.size, 1)) + bias

    def worst(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per document: the greatest score of its sentences, and that sentence."""
        s = score[self.sent]
        o = np.lexsort((s, self.owner))
        last = np.flatnonzero(np.concatenate([self.owner[o][1:] != self.owner[o][:-1], [True]])) if len(o) else o
        top, which = np.full(self.n, -30.0), np.full(self.n, -1, np.int64)
        top[self.owner[o[last]]], which[self.owner[o[last]]] = s[o[last]], self.sent[o[last]]
        return top, which

    def fit(self, use: np.ndarray, rounds: int = 5) -> tuple[np.ndarray, float]:
        """Weights of the buckets and bias, from the documents of ``use``."""
        k = len(self.size)
        of_good = (~self.bad & use)[self.owner]
        every = (np.bincount(self.sent[of_good], minlength=k) > 0).astype(float)
        pos = np.bincount(self.sent[(self.bad & use)[self.owner]], minlength=k) * (every == 0)
        w, bias, top, which = self.ratios(pos.astype(float), every), 0.0, None, None
        for i in range(rounds):
            top, which = self.worst(self.scores(w, bias))
            seen = use & (which >= 0)
            trust = seen if i < 2 else seen & np.where(self.bad, top > -TRUST / (1 if i == 2 else 4), top < TRUST)
            neg = every.copy()
            if i >= 2:  # what a document that is labelled fine in error says is no example
                doubt = np.unique(which[seen & ~self.bad & ~trust])
                neg[doubt] = 0
            fine = trust & ~self.bad  # the nearer to being taken for offensive, the more a fine document weighs
            worst = np.bincount(which[fine], weights=0.2 + 20 / (1 + np.exp(-np.clip(top[fine] + 0.5, -30, 30) * 2)) if i >= 1 else None, minlength=k)
            neg = 0.2 * neg + np.minimum(worst, 60) * (neg > 0)
            pos = np.minimum(np.bincount(which[trust & self.bad], minlength=k), 3).astype(float)
            pos[neg > 0] = 0
            w, bias = self._logistic(self.ratios(pos, neg), pos, neg)
        return w, bias

    def _logistic(self, r: np.ndarray, pos: np.ndarray, neg: np.ndarray, steps: int = 100, l2: float = 2e-4) -> tuple[np.ndarray, float]:
        """Full-batch logistic regression on features scaled by r, both sides of equal weight, by accelerated descent."""
        spread = np.bincount(self.cols, weights=((pos + neg) > 0)[self.rows], minlength=BUCKETS)
        keep = ((pos + neg)[self.rows] > 0) & (spread[self.cols] > 2)  # an n-gram of two sentences is most often a name
        rows, cols = self.rows[keep], self.cols[keep]
        # places in the arrays of kept n-grams and kept sentences
        has_col, has_row = np.zeros(BUCKETS, bool), np.zeros(len(self.size), bool)
        has_col[cols], has_row[rows] = True, True
        used, sents = np.flatnonzero(has_col), np.flatnonzero(has_row)
        col_at, row_at = (np.cumsum(h).astype(np.int32) - 1 for h in (has_col, has_row))
        at = col_at[cols]
        scale = (1 / np.sqrt(np.maximum(self.size, 1))).astype(np.float32)
        ratio = r.astype(np.float32)
        x = ratio[cols] * scale[rows]
        weight = (pos / max(pos.sum(), 1) + neg / max(neg.sum(), 1))[sents].astype(np.float32)
        y = (pos[sents] > 0).astype(np.float32)
        # the same numbers in the order of sentences and in the order of n-grams: both sums are over stretches
        by_sent = np.flatnonzero(np.diff(rows, prepend=-1))
        order = self.by_col[keep[self.by_col]]
        cols_t, rows_t = self.cols[order], self.rows[order]
        xt, owner_t, by_gram = ratio[cols_t] * scale[rows_t], row_at[rows_t], np.flatnonzero(np.diff(cols_t, prepend=-1))
        w, v, b, vb = np.zeros(len(used), np.float32), np.zeros(len(used), np.float32), 0.0, 0.0
        norm = np.add.reduceat(x.astype(float) ** 2, by_sent)
        rate = 4.0 / max(1e-6, np.max(norm * weight) * 2 + 1e-9)
        rate = np.float32(min(rate, 4.0 / (np.average(norm + 1, weights=weight) + 1e-9)))
        for step in range(1, steps + 1):
            z = np.add.reduceat(x * w[at], by_sent) + np.float32(b)
            g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
            gw = np.add.reduceat(xt * g[owner_t], by_gram) + np.float32(l2) * w
            nv, nb = w - rate * gw, b - float(rate) * float(g.sum())
            m = (step - 1) / (step + 2)
            w, v, b, vb = nv + np.float32(m) * (nv - v), nv, nb + m * (nb - vb), nb
        full = np.zeros(BUCKETS)
        full[used] = v * r[used]
        return full, float(vb)


def learn(texts: list[str], bad: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(weights of the buckets, bias, threshold) from labelled texts; a quarter is held out for the threshold."""
    if bad.all() or not bad.any():
        return np.zeros(BUCKETS, np.float32), -30.0, 0.0
    f = Fit(texts, bad)
    held = np.where(bad, np.cumsum(bad), np.cumsum(~bad)) % 4 == 0 if min(bad.sum(), (~bad).sum()) >= 8 else np.ones(f.n, bool)
    w, bias = f.fit(~held if not held.all() else held)
    top, y = f.worst(f.scores(w, bias))[0][held], bad[held]
    o = np.argsort(-top, kind="stable")
    hit = np.cumsum(y[o])
    f1 = 2 * hit / (np.arange(1, len(o) + 1) + max(1, y.sum()))
    good = np.flatnonzero(f1 >= f1.max() - 0.005)  # the middle of the plateau
    below = top[o[min(good[-1] + 1, len(o) - 1)]]  # what the last place of the plateau leaves out
    return w.astype(np.float32), bias, float((top[o[good[0]]] + below) / 2)


def judge(texts: list[str | None], w: np.ndarray, bias: float) -> np.ndarray:
    """The score of the worst sentence of each text, as a logit; -30 where there is none."""
    out = np.full(len(texts), -30.0)
    parts, owner = [], []

    def flush() -> None:
        if parts:
            rows, cols = grams(parts)
            size = np.maximum(np.bincount(rows, minlength=len(parts)), 1)
            np.maximum.at(out, np.array(owner), np.bincount(rows, weights=w[cols], minlength=len(parts)) / np.sqrt(size) + bias)
            parts.clear()
            owner.clear()

    for i, t in enumerate(texts):
        if t:
            own = sentences(normal(t))
            parts += own
            owner += [i] * len(own)
            if len(parts) > 3000:
                flush()
    flush()
    return out


def labelled(documents: DataFrame, doc_labels: DataFrame) -> DataFrame:
    """(doc_id, text, bad) of a bounded sample of the labelled documents: the majority of raters, ties left out."""
    bad = F.sum(F.col("label").isin(*BAD).cast("int"))
    votes = doc_labels.groupBy("doc_id").agg(bad.alias("b"), F.sum((F.col("label") == "ok").cast("int")).alias("o")).where("coalesce(b, 0) <> coalesce(o, 0)")
    votes = votes.select("doc_id", (F.coalesce("b", F.lit(0)) > F.coalesce("o", F.lit(0))).alias("bad"))
    some = votes.where("bad").orderBy(F.xxhash64("doc_id")).limit(TRAIN_BAD).unionByName(votes.where("not bad").orderBy(F.xxhash64("doc_id")).limit(TRAIN_GOOD))
    return documents.select("doc_id", "text").where("text is not null").join(F.broadcast(some), "doc_id").distinct()


def fitted(documents: DataFrame, doc_labels: DataFrame) -> tuple[np.ndarray, float, float]:
    """``learn`` on the labelled sample, in a task; only the model (1 MB) comes to the driver.

    Queries of one session over the same tables share a model: it is fitted once.
    """
    docs, labels = documents.select("doc_id", "text"), doc_labels.select("doc_id", "label")
    app = documents.sparkSession.sparkContext.applicationId
    for at, d, v, model in _FITTED:
        if at == app and d.sameSemantics(docs) and v.sameSemantics(labels):
            return model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        rows.sort(key=lambda r: (hash((r[0], 17)), r[1]))
        if rows:
            w, bias, threshold = learn([r[1] for r in rows], np.array([r[2] for r in rows], bool))
            used = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([used, [-1, -2]]), pa.int32()), pa.array(np.concatenate([w[used], [bias, threshold]]), pa.float64())], names=["bucket", "weight"])

    got = labelled(documents, doc_labels).repartition(1).mapInArrow(run, "bucket int, weight double").toArrow()
    at, value = got["bucket"].to_numpy(), got["weight"].to_numpy()
    w = np.zeros(BUCKETS, np.float32)
    w[at[at >= 0]] = value[at >= 0]
    model = (w, float(value[at == -1][0]), float(value[at == -2][0])) if len(at) else (w, -30.0, 0.0)
    _FITTED.append((app, docs, labels, model))
    del _FITTED[:-4]
    return model


def scores(documents: DataFrame, doc_labels: DataFrame) -> DataFrame:
    """(doc_id, source, score, flagged): one row per row of ``documents``. score is a probability, 0.5 at the threshold."""
    shared = documents.sparkSession.sparkContext.broadcast(fitted(documents, doc_labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias, threshold = shared.value
        for batch in batches:
            z = judge(batch.column(2).to_pylist(), w, bias)
            p = 1 / (1 + np.exp(-np.clip(z - threshold, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array(z > threshold)], names=["doc_id", "source", "score", "flagged"])

    return documents.select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, score double, flagged boolean")


def rates(scored: DataFrame) -> DataFrame:
    """(source, n_docs, n_flagged, rate, mean_score), a null source included."""
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("flagged").cast("long")).alias("n_flagged"), F.avg(F.col("flagged").cast("double")).alias("rate"), F.avg("score").alias("mean_score"))
