"""Records that name one person or organisation under different spellings.

Method: MinHash banding over padded q-grams proposes pairs of names within a brain; the number of bands is tuned from
the collision curve. Monge-Elkan similarity of their words verifies them, and star clustering groups them.

* A record goes by one name: its title, or a fuller alias if the title is an abbreviation, an initial or Chinese. Equal
  names of a brain are one node, so copies, however many, make no pairs before the end, and equal names always link.
* Nodes meet in bands by a join on the band's hash; the pairs of a band that are equal in several bands count once. A bucket
  of a brain with over WIDE names, and an entity of any size, is joined in blocks of BLOCK, so no task holds all its pairs.
* Verification: every word needs its partner. The inner similarity is graded: equal, a nickname, sounding alike, a soft edit
  distance (a vowel for a vowel costs half), an abbreviation, or an initial. Numbers must be equal, initials must not
  contradict, one shared word never suffices, and at most one word in two differs in its letters.
* Star clustering in rounds of joins until every node is done: a node with more neighbours than any of its unassigned
  neighbours becomes a centre and takes them. Names that only give an initial join the cluster of the full names they fit if
  that is one cluster.

Cases: null brain, slug or title leaves a record out, and so does a title of under three letters (two Han characters); broken alias lists are
read as far as they go; aliases without two words are junk; a record sent twice counts once; names without two words (or
letters) match equal names only; two capitals after a single word are read as initials, so "Siemens AG" also meets a person
of that name with these initials.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut
from corpusloom.tables import current_rows

Q = 2
ROWS = 3
#: Recall wanted for pairs of this Jaccard similarity of q-grams; the number of bands follows.
LEAST_JACCARD, RECALL = 0.40, 0.97
MIN_SCORE = 0.85
#: Names of a brain beyond which its bands are joined in blocks, and names (records) of a block.
WIDE, BLOCK = 20_000, 2000

#: Forms of address and legal forms that are no part of a name.
ADDRESS = {"mr", "mrs", "ms", "miss", "dr", "prof", "dipl", "ing", "sir", "the", "jr", "sr", "herr", "frau"}
LEGAL = {"inc", "incorporated", "corp", "corporation", "ltd", "limited", "llc", "llp", "plc", "co", "company", "gmbh", "ag", "ab", "sa", "oy", "as", "bv", "nv", "kg", "srl", "spa"}
LINKING = {"and", "und", "y", "et", "of", "de", "der", "die", "das", "for"}
#: Short forms of given names.
NICKNAMES = {
    "alexander": "alex sasha xander lex", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben benny benji", "charles": "charlie chuck chas charley",
    "christopher": "chris kit topher", "daniel": "dan danny", "deborah": "debbie deb debra", "edward": "ed eddie ted ned teddy", "elizabeth": "liz beth betty lizzie betsy libby eliza bess",
    "frances": "fran frankie fanny francie", "francis": "frank", "friedrich": "fritz fred freddy", "gabriela": "gabi gaby", "gregory": "greg", "henry": "hank harry hal", "ignacio": "nacho",
    "james": "jim jimmy jamie", "jennifer": "jen jenny jenn", "johannes": "hannes hans johann", "john": "jack johnny", "jonathan": "jon jonny", "joseph": "joe joey", "katherine": "kate kathy katie kat kitty kathryn",
    "lucia": "lucy", "margaret": "maggie meg peggy marge margie madge", "matthew": "matt matty", "michael": "mike mick mickey", "nicholas": "nick nicky nico", "patricia": "pat patty trish tricia patsy",
    "quentin": "quent", "rebecca": "becky becca", "richard": "rick dick rich richie ricky", "robert": "bob rob bobby robbie", "samuel": "sam sammy", "stephen": "steve steven", "susan": "sue susie suzy suzie",
    "thomas": "tom tommy", "victoria": "vicky vicki tori vikki", "viktor": "vik", "william": "bill will billy willy willie", "wilhelm": "willi", "theodore": "theo", "timothy": "tim timmy", "jose": "pepe", "franz": "franzl",
    "guillermo": "memo guille", "francisco": "paco pancho curro", "enrique": "quique", "eduardo": "lalo", "roberto": "beto", "manuel": "manolo", "rafael": "rafa", "guadalupe": "lupe", "jesus": "chuy",
}
FULL_NAME = {short: full for full, shorts in NICKNAMES.items() for short in shorts.split()}
_HAN = re.compile(r"[㐀-䶿一-鿿]")
_WORD = re.compile(r"[^\W_]+")


#: Spellings of one sound, applied in this order.
SOUNDS = [("sch", "s"), ("ph", "f"), ("ck", "k"), ("ch", "k"), ("th", "t"), ("qu", "kv"), ("x", "ks"), ("q", "k"), ("c", "k"), ("z", "s"), ("w", "v"), ("y", "i"), ("j", "i")]
VOWELS = frozenset("aeiou")


@lru_cache(200_000)
def sound(word: str) -> str:
    """How a word sounds, roughly: one spelling per sound, no h within, no letter twice."""
    if not word.isascii():
        return word
    out = word
    for written, plain in SOUNDS:
        out = out.replace(written, plain)
    return re.sub(r"(.)\1+", r"\1", out[:1] + out[1:].replace("h", ""))


def _fold(s: str) -> str:
    s = unicodedata.normalize("NFKD", s.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("æ", "ae").replace("Æ", "AE").replace("ł", "l").replace("Ł", "L"))
    return "".join(c for c in s if unicodedata.category(c) not in ("Mn", "Cf"))


def name_of(text: str) -> str:
    """The words of a name, folded, in order; an initial ends in a dot. Forms of address and legal forms are left out."""
    text = unicodedata.normalize("NFKC", text)
    if _HAN.search(text):
        return "".join(_HAN.findall(text))
    text = re.sub(r"(?<=\w)['’](?=\w)", "", _fold(text))
    text = re.sub(r"(?<![^\W_])(?:[^\W\d_]\.){2,}(?:[^\W\d_](?![^\W_]))?", lambda m: _spelled(m[0]), text)
    text = re.sub(r"(?i)\b(g?gmbh)\b", lambda m: m[0].lower(), text)
    text = re.sub(r"(?<=[a-z]{2})(?=[A-Z])", " ", text)
    shouted = not re.search(r"[a-z]", text)
    out: list[str] = []
    legal: list[str] = []
    for w in _WORD.findall(text):
        low = w.lower()
        if low in ADDRESS or low in LINKING and len(low) > 1:
            if len(w) == 2 and w.isupper() and not shouted and len(out) == 1:
                legal.append(w)  # "Cortuton MR": initials after the surname
            continue
        if low in LEGAL:
            legal.append(w)
        elif len(w) == 1 and w.isalpha():
            out.append(low + ".")
        elif len(w) <= 3 and w.isupper() and w.isalpha() and not shouted and out:
            out += [c.lower() + "." for c in w]  # initials after the surname
        else:
            out.append(low)
    if len(out) == 1 and legal and len(legal[0]) <= 3 and legal[0].isupper() and not shouted:
        out += [c.lower() + "." for c in legal[0]]
    elif len(out) == 1 and legal:
        out.append(legal[0].lower())  # a single word is told apart by its legal form
    return " ".join(out or [w.lower() for w in _WORD.findall(text)])


def _spelled(dotted: str) -> str:
    """g.m.b.h. is a legal form; other dotted letters are initials."""
    joined = dotted.replace(".", "")
    return joined + " " if joined.lower() in LEGAL else " ".join(joined) + " "


def kind_of(name: str) -> str:
    """full, initial (one word and initials) or none (too little to go by unless another name is equal)."""
    words = name.split()
    if len(words) == 2 and words[1] in LEGAL:
        words = words[:1]
    full = [w for w in words if not w.endswith(".")]
    if not full or sum(map(len, words)) < 4 or (len(words) == 1 and not (len(words[0]) >= 10)):
        return "none"
    if len(full) == 1 and len(words) > 1:
        return "initial" if len(full[0]) > 2 else "none"
    return "full"


def aliases_of(raw: str | None, slug: str) -> list[str]:
    """The aliases of a JSON list, the slug left out; of a list that is cut off, those that are whole."""
    if not raw:
        return []
    try:
        got = json.loads(raw)
        got = [x for x in got if isinstance(x, str)] if isinstance(got, list) else []
    except ValueError:
        got = []
        for m in re.finditer(r'"((?:[^"\\]|\\.)*)"', raw):
            try:
                got.append(json.loads(m[0]))
            except ValueError:
                pass
    return [x for x in got if x != slug]


def record_name(title: str, aliases: list[str]) -> str:
    """The name a record goes by: an alias of two words or more if the title says too little, else the title."""
    own = name_of(title)
    kind = "none" if _HAN.search(own) else kind_of(own)
    if kind != "full" or len(own.split()) == 1:
        full = [n for n in (name_of(a) for a in aliases if not _HAN.search(a)) if kind_of(n) == "full" and len(n.split()) > 1]
        if full:
            return max(full, key=lambda n: (len(n), n))
    return own


def canonical(words: list[str]) -> list[str]:
    return [FULL_NAME.get(w, w) for w in words]


def _near(a: str, b: str) -> bool:
    """At most one letter added, left out, changed or swapped with its neighbour."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


def _short_for(a: str, b: str) -> bool:
    """An abbreviation: the letters of a in their order within b, from the first on."""
    if not 3 <= len(a) < len(b) - 1 or a[0] != b[0]:
        return False
    it = iter(b)
    return all(c in it for c in a)


def soft_distance(a: str, b: str) -> float:
    """0 to 1: one letter added, left out, changed or swapped costs 1, a vowel for a vowel half of it; more is infinite."""
    if a == b:
        return 0.0
    if abs(len(a) - len(b)) > 1:
        return math.inf
    if len(a) == len(b):
        n = 0
        for x, y in zip(a, b, strict=True):
            if x != y:
                n += 1 if x in VOWELS and y in VOWELS else 3
                if n > 2:
                    break
        else:
            return 0.5 * n
    return 1.0 if _near(a, b) else math.inf


FULL_SOUND = {sound(short): sound(full) for full, shorts in NICKNAMES.items() for short in shorts.split()}


def _letters(word: str) -> int:
    """The letters of a word as bits."""
    out = 0
    for c in word:
        out |= 1 << (ord(c) % 61)
    return out


@lru_cache(500_000)
def _facts(word: str) -> tuple[str, str, str, int, int, bool]:
    s = sound(word)
    return s, FULL_SOUND.get(s, s), FULL_NAME.get(word, word), _letters(s), _letters(word), word.isdigit()


def word_similarity(a: str, b: str) -> float:
    """1 equal, .97 a nickname, .95 sounding alike, .925 to .9 nearly so (``soft_distance``), .88 an abbreviation, else 0."""
    if a == b:
        return 1.0
    (x, x_full, a_full, x_bits, a_bits, a_digit), (y, y_full, b_full, y_bits, b_bits, b_digit) = _facts(a), _facts(b)
    if a_digit or b_digit:
        return 0.0
    if a_full == b_full or (x_full == y_full and x != y):
        return 0.97
    # letters that only one of the two has: what a single slip can leave
    if min(len(a), len(b)) >= 4:
        if (a_bits ^ b_bits).bit_count() <= 2 and _near(a, b):
            return 0.9
        if (x_bits ^ y_bits).bit_count() <= 4 and min(len(x), len(y)) >= 4:
            d = soft_distance(x, y)
            if d == 0 or d < math.inf and max(len(x), len(y)) > 5:
                return 0.95 - 0.05 * d
    if a[0] == b[0] and (a_bits & ~b_bits == 0 or b_bits & ~a_bits == 0) and _short_for(*sorted((a, b), key=len)):
        return 0.88
    return 0.0


def similarity(a: str, b: str) -> float:
    """Monge-Elkan similarity of two names with one partner per word, 0 if a word has none or something contradicts."""
    if a == b:
        return 1.0
    wa, wb = a.split(), b.split()
    fa, fb = ([w for w in ws if not w.endswith(".")] for ws in (wa, wb))
    ia, ib = ([w[0] for w in ws if w.endswith(".")] for ws in (wa, wb))
    # words written together or apart, the surname first or last
    turned = lambda ws: {"".join(ws), "".join(ws[1:] + ws[:1]), "".join(ws[-1:] + ws[:-1])}
    if len(fa) != len(fb) and sum(map(len, fa)) >= 6 and ("".join(fa) in turned(fb) or "".join(fb) in turned(fa)):
        return 0.98
    pairs = sorted(((word_similarity(x, y), i, j) for i, x in enumerate(fa) for j, y in enumerate(fb)), key=lambda p: -p[0])
    la, lb, scores, errors, exact, anchor = set(range(len(fa))), set(range(len(fb))), [], 0, 0, False
    for s, i, j in pairs:
        if s > 0 and i in la and j in lb:
            la.discard(i)
            lb.discard(j)
            scores.append(s)
            errors += s in (0.9, 0.925)
            exact += s == 1
            anchor |= s >= 0.9 and min(len(fa[i]), len(fb[j])) >= 3
    # an initial stands for a word only where the name has but one word besides
    for left, words, initials, other in ((la, fa, ib, fb), (lb, fb, ia, fa)):
        for i in sorted(left) if len(other) == 1 else ():
            for c in {words[i][0], FULL_NAME.get(words[i], words[i])[0]}:
                if c in initials and i in left:
                    initials.remove(c)
                    left.discard(i)
                    scores.append(0.86)
    if la or lb or not anchor or errors > (2 if exact and len(fa) > 2 else 1):
        return 0.0
    for c in list(ia):
        if c in ib:
            ia.remove(c)
            ib.remove(c)
            scores.append(1.0)
    if ia and ib or len(scores) < 2:
        return 0.0
    return sum(scores) / len(scores)


def bands_needed(jaccard: float = LEAST_JACCARD, recall: float = RECALL, rows: int = ROWS) -> int:
    """The collision curve 1 - (1 - j^rows)^bands, solved for bands."""
    return math.ceil(math.log(1 - recall) / math.log(1 - jaccard**rows))


def q_grams(name: str) -> set[str]:
    """Padded q-grams of every word, nicknames written out; the order of words doesn't matter."""
    out = set()
    for w in canonical(name.replace(".", "").split()):
        p = f"^{w}$"
        out |= {p[i : i + Q] for i in range(len(p) - Q + 1)}
    return out


def band_hashes(names: list[str], bands: int, rows: int = ROWS, seed: int = 3) -> np.ndarray:
    """(names, bands) hashes of each band's minima."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 61, bands * rows, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(1, 1 << 61, bands * rows, dtype=np.uint64)
    sets = [sorted(q_grams(n)) or ["^$"] for n in names]
    flat = np.array([hash_of(g) for s in sets for g in s], np.uint64)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.zeros((len(names), bands), np.uint64)
    for k in range(bands):
        h = np.full(len(names), k + 1, np.uint64)
        for r in range(rows):
            x = (flat * a[k * rows + r] + b[k * rows + r]) >> np.uint64(11)
            h = (h ^ np.minimum.reduceat(x, starts)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        out[:, k] = h
    return out


def hash_of(gram: str) -> int:
    h = 1469598103934665603
    for c in gram:
        h = ((h ^ ord(c)) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return h ^ (h >> 29)


def named_records(registry: DataFrame) -> DataFrame:
    """(brain_id, slug, name, kind): the active current records and the name each goes by."""
    now = current_rows(registry.select("brain_id", "slug", "status", "title", "aliases_json", "updated_at"), ["brain_id", "slug"])
    now = now.where("brain_id is not null and slug is not null and title is not null and lower(trim(status)) = 'active'").select("brain_id", "slug", "title", "aliases_json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [record_name(t, aliases_of(a, s)) for s, t, a in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array([kind_of(n) for n in names], pa.string())], names=["brain_id", "slug", "name", "kind"])

    return now.mapInArrow(run, "brain_id string, slug string, name string, kind string").where(F.length(F.regexp_replace("name", "[ .]", "")) >= F.when(F.col("name").rlike(r"\p{IsHan}"), 2).otherwise(3))


def pairs_in_blocks(rows: DataFrame, keys: list[str], member: str, n: str = "n", block: int | None = None) -> DataFrame:
    """(keys, a, b), a < b: all pairs of members that share the keys; ``n`` is the number of members of a key.

    Members are dealt into blocks, and every pair of blocks is a key of its own, so a task joins two blocks at most.
    """
    rows = rows.withColumn("_s", F.ceil(F.col(n) / (block or BLOCK)).cast("int")).withColumn("_b", F.pmod(F.xxhash64(member), F.col("_s")).cast("int"))
    left = rows.select(*keys, F.col(member).alias("a"), F.col("_b").alias("_i"), F.explode(F.sequence(F.col("_b"), F.col("_s") - 1)).alias("_j"))
    right = rows.select(*keys, F.col(member).alias("b"), F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_i"), F.col("_b").alias("_j"))
    met = left.join(right, [*keys, "_i", "_j"]).where("_i < _j or a < b")
    return met.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def name_edges(nodes: DataFrame) -> DataFrame:
    """(a, b, score) with a < b, both ways of one pair once: the verified pairs of ``nodes`` (node, brain_id, name)."""
    bands = bands_needed()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            h = band_hashes(batch.column(2).to_pylist(), bands).view(np.int64)
            node = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), bands)
            brain = batch.column(1).take(pa.array(np.repeat(np.arange(batch.num_rows), bands)))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), brain, pa.array(h.ravel())], names=["node", "brain_id", "band"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.array([similarity(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], float)
            t = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())], names=["a", "b", "score"])
            yield t.filter(pa.array(s >= MIN_SCORE))

    def banded(of: DataFrame) -> DataFrame:
        return of.select("node", "brain_id", "name").mapInArrow(run, "node long, brain_id string, band long").select("node", F.xxhash64("brain_id", "band").alias("band"))

    # a bucket has no more names than its brain
    wide = cut(nodes.groupBy("brain_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WIDE).select("brain_id"))
    wide = None if wide.isEmpty() else wide
    keyed = banded(nodes if wide is None else nodes.join(wide, "brain_id", "left_anti"))
    keyed_wide = None if wide is None else banded(nodes.join(wide, "brain_id", "left_semi"))
    met = keyed.withColumnRenamed("node", "a").join(keyed.withColumnRenamed("node", "b"), "band").where("a < b").select("a", "b")
    if wide is not None:
        counted = keyed_wide.join(keyed_wide.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "band")
        met = met.unionByName(pairs_in_blocks(counted, ["band"], "node").select("a", "b"))
    met = met.distinct()
    left, right = nodes.select(F.col("node").alias("a"), F.col("name").alias("x")), nodes.select(F.col("node").alias("b"), F.col("name").alias("y"))
    return met.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(verify, "a long, b long, score double")


def star_clusters(edges: DataFrame, weight: DataFrame) -> DataFrame:
    """(node, centre) by greedy stars in the order of degree, then ``weight`` (node, w), then node; rounds of joins.

    Every round makes the first of the open nodes a centre at least, so it goes on until none is open.

    edges: (a, b), each pair once. Nodes without an edge don't appear.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("d")).join(weight.select(F.col("node").alias("a"), "w"), "a", "left")
    rank = degree.select("a", F.struct("d", F.coalesce("w", F.lit(0)).alias("w"), F.col("a").alias("n")).alias("p"))
    open_ = cut(both.join(rank, "a").join(rank.select(F.col("a").alias("b"), F.col("p").alias("q")), "b"))
    done = None
    while True:
        best = open_.groupBy("a").agg(F.first("p").alias("p"), F.max("q").alias("q"))
        centres = cut(best.where("p > q").select("a", "p"))
        taken = open_.join(centres.select(F.col("a").alias("b")), "b", "left_semi").groupBy("a").agg(F.max("q").alias("c")).select(F.col("a").alias("node"), F.col("c.n").alias("centre"))
        new = cut(centres.select(F.col("a").alias("node"), F.col("a").alias("centre")).unionByName(taken))
        done = new if done is None else done.unionByName(new)
        gone = new.select(F.col("node").alias("a"))
        open_ = open_.join(gone, "a", "left_anti").join(gone.withColumnRenamed("a", "b"), "b", "left_anti")
        # nodes whose neighbours are all taken stand alone
        open_ = cut(open_)
        if open_.isEmpty():
            return done


def clustered_names(registry: DataFrame) -> DataFrame:
    """(brain_id, slug, entity): active records with the cluster of their name; a name that is alone is its own."""
    records = cut(named_records(registry).withColumn("node", F.xxhash64("brain_id", "name")))
    nodes = cut(records.groupBy("node").agg(F.first("brain_id").alias("brain_id"), F.first("name").alias("name"), F.first("kind").alias("kind"), F.count(F.lit(1)).alias("n")))
    edges = cut(name_edges(nodes.where("kind <> 'none'")))
    kind = nodes.select("node", F.col("kind") == "initial")
    a, b = (kind.toDF(c, f"{c}_initial") for c in "ab")
    typed = cut(edges.join(a, "a").join(b, "b"))
    weight = nodes.select("node", F.length("name").cast("long").alias("w"))
    full = star_clusters(typed.where("not a_initial and not b_initial"), weight)
    # an initial fits one cluster, or it is left alone
    mixed = typed.where("a_initial <> b_initial").select("score", F.when(F.col("a_initial"), F.col("a")).otherwise(F.col("b")).alias("node"), F.when(F.col("a_initial"), F.col("b")).otherwise(F.col("a")).alias("full"))
    home = mixed.join(full.select(F.col("node").alias("full"), "centre"), "full", "left").groupBy("node", F.coalesce("centre", "full").alias("centre")).agg(F.max("score").alias("score"))
    best = home.groupBy("node").agg(F.max("score").alias("best"))  # a middle initial that agrees decides
    fits = cut(home.join(best, "node").where("score > best - 0.01").groupBy("node").agg(F.min("centre").alias("centre"), F.max("centre").alias("other")))
    alone = typed.where("a_initial and b_initial").join(fits.select(F.col("node").alias("a")), "a", "left_anti").join(fits.select(F.col("node").alias("b")), "b", "left_anti")
    groups = full.unionByName(fits.where("centre = other").select("node", "centre")).unionByName(star_clusters(alone, weight))
    ambiguous = fits.where("centre <> other").select("node", F.lit(True).alias("ambiguous"))
    out = records.select("brain_id", "slug", "node").join(groups, "node", "left").join(ambiguous, "node", "left")
    return out.select("brain_id", "slug", F.coalesce("centre", "node").alias("entity"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"))


def variant_pairs(registry: DataFrame) -> DataFrame:
    """(brain_id, slug_a, slug_b), slug_a < slug_b: all pairs of records within one entity."""
    c = cut(clustered_names(registry))
    many = c.groupBy("brain_id", "entity").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    c = c.join(many, ["brain_id", "entity"])
    return pairs_in_blocks(c, ["brain_id", "entity"], "slug").select("brain_id", F.col("a").alias("slug_a"), F.col("b").alias("slug_b"))
