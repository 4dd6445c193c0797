"""Documents that hold passages of held-out test items.

Method: template canonicalisation. Texts become words (characters for Chinese items); numbers, names and units become
typed placeholders, and every window of WINDOW canonical words is hashed. Windows of documents are hash-joined with those of
the items by template, and the matches are grouped by document, item and offset. Slot consistency then decides on the
values behind the placeholders:

* The values of a stretch are the item's own: the document quotes the item (``leaks``). A stretch of 20 words with at most one
  in ten changed leaves three unchanged windows of six, so a pair with fewer windows of equal values is no case; the others
  are checked exactly, by edit distance to both sides of every run of equal words.
* The values are others, but every value of the item stands for one value of the document all along the stretch, and the
  other way round: the item was re-parameterised (``reparameterised``). Values bound in two ways make no case.

A window of fewer than LITERALS plain words keeps its words, so placeholders alone never match. A word is a number by its
digits and a unit if it follows numbers. A name is capital within sentences, never small, never after an article (German
writes every noun with a capital) nor after a unit; a word that no item has is a name if the document writes it with a
capital. Chinese has numbers and units only.

* Items are taken in blocks of MAX_ITEMS, each of which is broadcast, so any number of items is served exactly.
* Documents are read once, in place; only those with a window of an item's template leave their task, as integers, in pieces
  of PIECE words that overlap by more than any stretch that decides, so a very long document is many rows.
* Every document is a row of its own: copies, however many, are only more rows.

Cases: null, empty and blank texts hold nothing; letter case, punctuation, white space, line breaks, markup, entities, JSON
escapes and invisible characters don't count; the closing instruction that items share is no test material;
items too short to hold a stretch match nothing; whole texts of any length are searched.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import stored

WINDOW = 6
WORDS, CHARS = "words", "chars"
LEAST = {WORDS: 20, CHARS: 30}
#: Plain words that a window needs for its placeholders to count.
LITERALS = 3
#: Items that are broadcast at a time.
MAX_ITEMS = 5000
#: Words of a piece of a document, and how far it reaches into the next: more than 2 x 30 characters and their errors.
PIECE, OVERLAP = 2048, 128
#: Words (characters) that a re-parameterised stretch has at least: about a sentence.
FOLLOWS = {WORDS: 12, CHARS: 18}
#: A closing sentence that so many items end with is an instruction.
SHARED_ENDINGS = 3

#: German articles and what takes their place; a noun after one is no name.
ARTICLES = set("der die das den dem des ein eine einen einem einer eines kein keine keinen keinem keiner im am zum zur vom beim ins ans sein seine seinen seinem seiner ihr ihre ihren ihrem ihrer unser unsere unseren diese dieser dieses diesen diesem jede jeder jedes jeden jedem".split())
_JSON = re.compile(r'\\u([0-9a-fA-F]{4})|\\([nrt"/\\])')
_TAG = re.compile(r"</?[A-Za-z!][^<>]{0,200}>")
_BROKEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[\s>|*#]*(?=[^\W\d_])")
_HAN = "㐀-䶿一-鿿豈-﫿"
_WORD = re.compile(rf"[{_HAN}]|[^\W_{_HAN}]+")
_CHAR = re.compile(r"[^\W_]")
_HAS_HAN = re.compile(rf"[{_HAN}]")
_INVISIBLE = {c: None for c in range(0x110000) if c < 0x3000 and unicodedata.category(chr(c)) == "Cf"} | {0xFEFF: None}


def cased(text: str) -> str:
    """The text without markup, escapes and invisible characters."""
    if "\\" in text:
        text = _JSON.sub(lambda m: chr(int(m[1], 16)) if m[1] else {"n": "\n", "r": "\n", "t": "\t"}.get(m[2], m[2]), text)
        text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "<" in text:
        text = _TAG.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(_INVISIBLE))
    if "-" in text:
        text = _BROKEN.sub("", text)
    return text


def plain(text: str) -> str:
    """``cased`` in one case."""
    return cased(text).casefold()


def tokens(text: str, mode: str) -> list[str]:
    """The words (characters) of a text in one case."""
    written = cased(text)
    return [w.casefold() for w in _WORD.findall(written)] if mode == WORDS else _CHAR.findall(written.casefold())


def _rolled(x: np.ndarray, w: int = WINDOW) -> np.ndarray:
    """A hash of every w successive numbers."""
    n = len(x) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(w):
        h = (h ^ (x[i : i + n].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


LITERAL, NUMBER, NAME, UNIT = range(4)


class Lexicon:
    """Numbers for the words of the items of one mode, and the type of each."""

    def __init__(self, texts: list[str], mode: str):
        self.mode = mode
        cut = [tokens(t, mode) for t in texts]
        self.number = {w: i for i, w in enumerate(sorted({w for ws in cut for w in ws}))}
        unit = Counter()
        for ws in cut:
            unit.update(b for a, b in zip(ws, ws[1:], strict=False) if a.isdigit() and not b.isdigit())
        capital, other = Counter(), Counter()
        for t in texts if mode == WORDS else []:
            for m in re.finditer(r"(?:(?<=[^\W_])|(?<=[^\W_],)) ([^\W\d_]+)", t):
                before = re.search(r"[^\W_]+(?=,?$)", t[max(0, m.start() - 40) : m.start()])
                before, w = before[0].casefold() if before else "", m[1].casefold()
                common = not m[1][0].isupper() or before in ARTICLES or before.isdigit() or unit[before] > 1
                (other if common else capital)[w] += 1
        self.kind = np.zeros(len(self.number), np.int8)
        for w, i in self.number.items():
            self.kind[i] = NUMBER if w.isdigit() else UNIT if unit[w] > 1 else NAME if capital[w] and not other[w] else LITERAL

    def ids(self, words: list[str], codes: np.ndarray | None = None) -> np.ndarray:
        """Numbers of words; of one that no item has a hash below zero, which tells its type too."""
        out = Codes(self).of(words) if codes is None else codes.copy()
        new = np.flatnonzero(out < 0)
        out[new] = [-1 - ((zlib.crc32(words[i].casefold().encode()) & 0xFFFFFFF) << 2 | -1 - int(out[i])) for i in new.tolist()]
        return out

    def kinds(self, ids: np.ndarray) -> np.ndarray:
        own = self.kind[np.maximum(ids, 0)] if len(self.kind) else np.zeros(len(ids), np.int8)
        return np.where(ids >= 0, own, (-1 - ids) & 3)

    def windows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(template, slots) of every window: the hash with placeholders, and the hash of the words themselves."""
        slots = _rolled(ids)
        if not len(slots):
            return slots, slots
        kinds = self.kinds(ids)
        plain_ = np.concatenate([[0], np.cumsum(kinds == LITERAL)])
        enough = plain_[WINDOW:] - plain_[:-WINDOW] >= LITERALS
        return np.where(enough, _rolled(np.where(kinds == LITERAL, ids, -(1 << 40) - kinds)), slots), slots


class Codes(dict):
    """The numbers of words as they are written, capitals and all; of words that no item has the type alone."""

    def __init__(self, lexicon: Lexicon, most: int = 1_000_000):
        super().__init__()
        self.lexicon, self.most = lexicon, most

    def __missing__(self, written: str) -> int:
        if len(self) >= self.most:
            self.clear()
        code = self.lexicon.number.get(written.casefold())
        if code is None:
            code = -1 - (NUMBER if written.isdigit() else NAME if written[0].isupper() else LITERAL)
        self[written] = code
        return code

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def may_match(codes: np.ndarray) -> bool:
    """Whether some window is free of words that can't be an item's."""
    bad = np.flatnonzero(codes == -1)
    return len(codes) >= WINDOW and (len(bad) == 0 or bool((np.diff(bad, prepend=-1, append=len(codes)) > WINDOW).any()))


def _ending(text: str) -> tuple[int, str]:
    """Where the last sentence begins, and that sentence."""
    body = text.rstrip()
    at = re.search(r"[^.!?。！？]*[.!?。！？]?\s*$", body[:-1]).start() if len(body) > 1 else 0
    return at, plain(body[at:]).strip()


def without_instruction(eval_items: DataFrame) -> DataFrame:
    """(item_id, text), each once, without a last sentence that SHARED_ENDINGS items or more end with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            ends = [_ending(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t[:at] for t, (at, _) in zip(texts, ends, strict=True)], pa.string()), pa.array([e for _, e in ends], pa.string())], names=["item_id", "text", "head", "ending"])

    rows = eval_items.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    cut = rows.mapInArrow(run, "item_id long, text string, head string, ending string")
    shared = cut.where("ending <> ''").groupBy("ending").agg(F.count_distinct("item_id").alias("n")).where(F.col("n") >= SHARED_ENDINGS)
    return cut.join(shared, "ending", "left").select("item_id", F.when(F.col("n").isNull(), F.col("text")).otherwise(F.col("head")).alias("text"))


class Items:
    """A block of items as numbers, with the hashes of their windows."""

    def __init__(self, rows: list[tuple[int, str]]):
        rows = [(i, t) for i, t in rows if t and t.strip()]
        chars = lambda t: len(_HAS_HAN.findall(t)) * 3 > len(t)
        by = {WORDS: [r for r in rows if not chars(r[1])], CHARS: [r for r in rows if chars(r[1])]}
        self.lexicon = {m: Lexicon([r[1] for r in v], m) for m, v in by.items()}
        self.text: dict[tuple[int, int], tuple[str, np.ndarray]] = {}
        for m, v in by.items():
            for n, (i, t) in enumerate(v):
                self.text[i, n] = (m, self.lexicon[m].ids(tokens(t, m)))
        self.wins = {key: self.lexicon[m].windows(ids) for key, (m, ids) in self.text.items()}
        of = lambda m, k: np.unique(np.concatenate([w[k] for key, w in self.wins.items() if self.text[key][0] == m] or [np.empty(0, np.int64)]))
        self.templates, self.slots = ({m: of(m, k) for m in by} for k in range(2))

    def windows(self) -> list[tuple]:
        """(mode, template, own, item_id, copy, at): the windows of all items; copy tells texts of one item apart."""
        return [(self.text[key][0], int(a), int(b), *key, at) for key, (t, s) in self.wins.items() for at, (a, b) in enumerate(zip(t, s, strict=True))]


def _runs(doc: np.ndarray, item: np.ndarray, w: int) -> list[tuple[int, int, int]]:
    """(place in item, place in doc, length) of the maximal runs of at least w equal words."""
    a, b = _rolled(item, w), _rolled(doc, w)
    order = np.argsort(a, kind="stable")
    lo, hi = np.searchsorted(a[order], b, "left"), np.searchsorted(a[order], b, "right")
    n = hi - lo
    j = np.repeat(np.arange(len(b)), n)
    i = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    o = np.lexsort((i, j - i))
    i, j = i[o], j[o]
    if not len(i):
        return []
    new = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (np.diff(j) != 1)]))
    ends = np.concatenate([new[1:], [len(i)]]) - 1
    return sorted(zip(i[new].tolist(), j[new].tolist(), (i[ends] - i[new] + w).tolist(), strict=True))


def _reach(item: list[int], doc: list[int], most: int) -> list[int]:
    """Words of ``item`` from its start that 0, 1, … ``most`` errors reach along ``doc`` from its start.

    The furthest point on each diagonal with so many words changed, left out or added (k: place in doc less place in item).
    """
    far, out = {0: 0}, []
    for e in range(most + 1):
        step = dict(far)
        for k, i in far.items() if e else ():
            for to, at in ((k, i + 1), (k - 1, i + 1), (k + 1, i)):
                if at <= len(item) and 0 <= at + to <= len(doc) and at > step.get(to, -1):
                    step[to] = at
        for k, i in step.items():
            while i < len(item) and i + k < len(doc) and item[i] == doc[i + k]:
                i += 1
            step[k] = i
        far = step
        out.append(max(far.values()))
    return out


def holds_stretch(doc: np.ndarray, item: np.ndarray, least: int) -> bool:
    """Whether ``doc`` holds at least ``least`` successive words of ``item``, at most one in ten changed, left out or added.

    Exact for ``least`` from 20 on: of a stretch of 2 x ``least`` words or more one half is a case too, so there are at most
    (2 x ``least`` - 1) // 10 errors; and one run of WINDOW equal words lies in it, from which both ends are reached.
    """
    most, far = (2 * least - 1) // 10, 2 * least
    words = item.tolist()
    for i, j, n in sorted(_runs(doc, item, WINDOW), key=lambda r: -r[2]):
        if n >= least:
            return True
        # words are added on the way, so the document is read a little further than the item
        after = _reach(words[i + n : i + n + far], doc[j + n : j + n + far + most].tolist(), most)
        before = _reach(words[max(0, i - far) : i][::-1], doc[max(0, j - far - most) : j][::-1].tolist(), most)
        if any((length := x + n + y) >= least and 10 * (a + b) <= length for a, x in enumerate(before) for b, y in enumerate(after)):
            return True
    return False


def _blocks(eval_items: DataFrame) -> Iterator[Items]:
    """The items in blocks of MAX_ITEMS or so, each collected when it is used."""
    rows = stored(without_instruction(eval_items))
    blocks = max(1, -(-rows.count() // MAX_ITEMS))
    for i in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i)
        yield Items(sorted({(r[0], r[1]) for r in part.collect()}))


PIECES = "doc_id long, mode string, piece int, ids array<int>, at array<int>, template array<long>, slots array<long>"


def _scanned(documents: DataFrame, items: Items) -> DataFrame:
    """The pieces of documents with a window of some item's template, and those windows."""
    shared = documents.sparkSession.sparkContext.broadcast(items)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = shared.value
        known_words = {m: Codes(x) for m, x in it.lexicon.items()}
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                written = cased(text)
                for mode in (WORDS, CHARS):
                    known, lexicon = it.templates[mode], it.lexicon[mode]
                    if not len(known) or (mode == CHARS and not _HAS_HAN.search(written)):
                        continue
                    words = _WORD.findall(written) if mode == WORDS else _CHAR.findall(written.casefold())
                    codes = known_words[mode].of(words)
                    if not may_match(codes):
                        continue
                    t, s = lexicon.windows(codes)
                    hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, t), len(known) - 1)] == t)
                    if not len(hit):
                        continue
                    ids = lexicon.ids(words, codes)
                    for k in range(-(-max(1, len(ids) - OVERLAP) // PIECE)):
                        own = hit[(hit >= k * PIECE) & (hit <= k * PIECE + PIECE + OVERLAP - WINDOW)]
                        if len(own):
                            for c, v in zip(out, (doc, mode, k, ids[k * PIECE : (k + 1) * PIECE + OVERLAP].astype(np.int32), (own - k * PIECE).astype(np.int32), t[own], s[own]), strict=True):
                                c.append(v)
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc_id", "mode", "piece", "ids", "at", "template", "slots"])

    return stored(documents.select("doc_id", "text").where("text is not null").mapInArrow(scan, PIECES))


def _met(scanned: DataFrame, items: Items) -> DataFrame:
    """(doc_id, mode, piece, item_id, copy, off, windows, same): windows that share a template with the item at one offset,
    and those of them whose slots hold the item's own values."""
    win = scanned.select("doc_id", "mode", "piece", F.explode(F.arrays_zip("at", "template", "slots")).alias("w")).select("doc_id", "mode", "piece", F.col("w.at").alias("here"), "w.template", "w.slots")
    table = scanned.sparkSession.createDataFrame(items.windows() or [("", 0, 0, 0, 0, 0)], "mode string, template long, own long, item_id long, copy int, there int")
    met = win.join(F.broadcast(table), ["mode", "template"])  # a block of items
    return met.groupBy("doc_id", "mode", "piece", "item_id", "copy", (F.col("here") - F.col("there")).alias("off")).agg(F.count(F.lit(1)).alias("windows"), F.sum((F.col("slots") == F.col("own")).cast("long")).alias("same"))


def _verified(scanned: DataFrame, asked: DataFrame, items: Items, judge: Callable, out: str) -> DataFrame:
    """``judge(items, mode, ids, asked)`` of every piece with its ``asked`` structs: rows of ``out`` without doc_id and mode."""
    shared = scanned.sparkSession.sparkContext.broadcast(items)
    names = [f.split()[0] for f in out.split(", ")]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, mode, ids, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mode", "ids", "asked")), strict=True):
                rows += [(doc, mode, *r) for r in judge(shared.value, mode, np.array(ids, np.int64), wanted)]
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * (len(names) - 2)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    key = ["doc_id", "mode", "piece"]
    return asked.join(scanned.select(*key, "ids"), key).mapInArrow(check, out)


def _quoted(items: Items, mode: str, ids: np.ndarray, asked: list[dict]) -> Iterator[tuple]:
    for a in asked:
        if holds_stretch(ids, items.text[a["item_id"], a["copy"]][1], LEAST[mode]):
            yield (a["item_id"],)


def leaks(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of every document that holds a stretch of an item, each pair once."""
    found = None
    # a stretch of n words with n / 10 changed leaves 0.4 n - 5 unchanged windows at least
    need = F.when(F.col("mode") == WORDS, int(0.4 * LEAST[WORDS]) - WINDOW + 1).otherwise(int(0.4 * LEAST[CHARS]) - WINDOW + 1)
    for items in _blocks(eval_items):
        scanned = _scanned(documents, items)
        met = _met(scanned, items).where("same > 0").groupBy("doc_id", "mode", "piece", "item_id", "copy").agg(F.sum("same").alias("n")).where(F.col("n") >= need)
        asked = met.groupBy("doc_id", "mode", "piece").agg(F.collect_list(F.struct("item_id", "copy")).alias("asked"))
        part = _verified(scanned, asked, items, _quoted, "doc_id long, mode string, item_id long").select("doc_id", "item_id")
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def _bound(items: Items, mode: str, ids: np.ndarray, asked: list[dict]) -> Iterator[tuple]:
    """(item_id, windows, consistent, bindings) of the longest stretch at one offset with one value for each of the item's."""
    lexicon = items.lexicon[mode]
    slots = _rolled(ids)
    known = items.slots[mode]
    quoted = known[np.minimum(np.searchsorted(known, slots), len(known) - 1)] == slots  # some item's very words
    mine = lexicon.kinds(ids)
    for a in asked:
        item = items.text[a["item_id"], a["copy"]][1]
        lo, hi = max(0, a["off"]), min(len(ids), len(item) + a["off"])
        d, i = ids[lo:hi], item[lo - a["off"] : hi - a["off"]]
        kinds = lexicon.kinds(i)
        follows = (kinds == mine[lo:hi]) & ((kinds != LITERAL) | (d == i))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], follows.astype(np.int8), [0]])))
        best = None
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e - s < FOLLOWS[mode]:
                continue
            slot = kinds[s:e] != LITERAL
            pairs = set(zip(i[s:e][slot].tolist(), d[s:e][slot].tolist(), strict=True))
            changed = sum(x != y for x, y in pairs)
            own = quoted[lo + s : lo + e - WINDOW + 1]
            if changed and len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(pairs) and 2 * own.sum() < len(own):
                same = int((slots[lo + s : lo + e - WINDOW + 1] == _rolled(i[s:e])).sum())
                best = max(best or (0,), (e - s - WINDOW + 1, same, changed))
        if best:
            yield (a["item_id"], *best)


def reparameterised(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(doc_id, mode, item_id, windows, consistent, bindings): items that a document follows, with other values, for a stretch.

    The stretch has FOLLOWS words or more, all plain words are the item's, and values correspond one to one: of equal values of the
    item none has two in the document, and the other way round. windows: windows of the longest such stretch; consistent:
    those with the item's own values; bindings: values that are changed. What quotes another item isn't re-parameterised.
    """
    found = None
    need = F.when(F.col("mode") == WORDS, FOLLOWS[WORDS] - WINDOW + 1).otherwise(FOLLOWS[CHARS] - WINDOW + 1)
    out = "doc_id long, mode string, item_id long, windows long, consistent long, bindings long"
    for items in _blocks(eval_items):
        scanned = _scanned(documents, items)
        # windows of too few plain words match by their very words only, and are missing from the count of a re-parameterised stretch
        met = _met(scanned, items).where(F.col("windows") * 2 >= need).where("same < windows")
        asked = met.groupBy("doc_id", "mode", "piece").agg(F.collect_list(F.struct("item_id", "copy", "off")).alias("asked"))
        part = _verified(scanned, asked, items, _bound, out)
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("windows", "consistent", "bindings")).alias("b")
    return found.groupBy("doc_id", "mode", "item_id").agg(best).select("doc_id", "mode", "item_id", "b.*")


def leaked_items(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(item_id, suite, split, n_docs): every test item with the number of documents that leak it, 0 included."""
    n = leaks(documents, eval_items).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return eval_items.select("item_id", "suite", "split").dropDuplicates(["item_id"]).join(n, "item_id", "left").select("item_id", "suite", "split", F.coalesce("n", F.lit(0)).alias("n_docs"))
