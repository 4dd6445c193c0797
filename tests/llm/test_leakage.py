import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import leakage as L

ITEMS = [
    (1, "en", "Sixten of Raswistad traded a glass flute for 415 sacks of barley and never told the glazier. When the bridge at Heslirith fell, the ferryman hid the stone bowl under 97 umber blankets. Answer from the notes only."),
    (2, "en", "Merle of Dalzoton traded a brass lantern for 62 sacks of barley and never told the cooper. For 303 nights Yorick slept beside the salt barrel, fearing the baker from Velfesen. Answer from the notes only."),
    (3, "de", "Im Jahr 1755 zog der Fährmann Halka von Raswistad nach Ovgeton, nur mit einer Gezeitentafel im Gepäck. Jorunn zählte 729 Schritte von der Gezeitentafel bis zum Tor. Answer from the notes only."),
    (4, "zh", "滕知微在赤苔坊用一只细颈马鞍换来了97袋大麦，却没有告诉外乡来的测量员。星芦村的跛脚的测量员开价719枚铜钱修补仿制铜灯，尹可风不肯付。只根据以上笔记作答。"),
    (5, "zh", "祁云起赶到冷杉镇之前，鎏边盐桶已经响了336遍，年轻的织工也不见了。一连51个夜晚，蔺云起都睡在细颈铜秤旁边。只根据以上笔记作答。"),
    (6, "zh", "只根据以上笔记作答。"),
]
COLUMNS = "item_id long, suite string, split string, lang string, question string, text string"


def items(spark, rows=ITEMS):
    return spark.createDataFrame([(i, "s", "test", lang, "q", t) for i, lang, t in rows], COLUMNS).withColumn("doc_id", F.lit(0))


def leaked(spark, texts, rows=ITEMS):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit("x") for c in ("mode", "ids", "item_id", "template", "slots", "n")})
    return {tuple(r) for r in L.leaks(docs, items(spark, rows)).collect()}


def words(i):
    return ITEMS[i - 1][2].split()


def test_whole_and_part(spark):
    w = words(1)
    texts = [ITEMS[0][2], "Before. " + " ".join(w[5:25]) + " after.", " ".join(w[5:20]), ITEMS[3][2][:34], ITEMS[3][2][:20], None, "", " 　", "Answer from the notes only.", "x " * 100_000 + " ".join(w[:24])]
    assert leaked(spark, texts) == {(0, 1), (1, 1), (3, 4), (9, 1)}


def test_forms(spark):
    w = words(1)
    base = " ".join(w[:26])
    texts = [
        base.upper(), "> " + base.replace(" ", "\n> "), base.replace("glass", "<b>glass</b>").replace("of", "of&nbsp;"), '{"content": "' + base.replace("and", "\\u0061nd") + '"}', base.replace("t", "t​"), "| " + " | ".join(w[:26]) + " |", base.replace("barley", "bar-\nley"),
        " ".join(ITEMS[3][2][:36]), ITEMS[3][2][:20] + "\n" + ITEMS[3][2][20:40], "".join(f"\\u{ord(c):04x}" for c in ITEMS[3][2][:36]),
    ]
    assert leaked(spark, texts) == {(i, 1) for i in range(7)} | {(i, 4) for i in range(7, 10)}


@pytest.mark.parametrize("mode", ["change", "leave out", "add"])
def test_one_word_in_ten(spark, mode):
    def altered(k):
        w = words(1)[:30]
        for i in [4, 9, 14, 19, 23, 26, 28][:k][::-1]:
            w[i : i + 1] = ["zzz"] if mode == "change" else [] if mode == "leave out" else [w[i], "zzz"]
        return " ".join(w)

    got = leaked(spark, [altered(k) for k in range(8)])
    assert {(i, 1) for i in range(4)} <= got and (7, 1) not in got


def test_same_template_other_values(spark):
    t = ITEMS[0][2].replace("Sixten", "Quirin").replace("Raswistad", "Peldorn").replace("glass flute", "wax seal").replace("415", "88").replace("glazier", "tanner").replace("Heslirith", "Gavton").replace("97", "12").replace("ferryman", "weaver")
    docs = spark.createDataFrame([(0, t)], "doc_id long, text string")
    assert leaked(spark, [t]) == set()
    got = L.reparameterised(docs, items(spark)).where("item_id = 1").first()
    assert got is None or got["windows"] > got["consistent"]


def test_brute_force_edit_distance():
    """holds_stretch against a check of every stretch of the item and every stretch of the document by edit distance."""
    import numpy as np

    def brute(doc, item, least):
        for a in range(len(item)):
            for b in range(a + least, len(item) + 1):
                part = item[a:b]
                row = [0] * (len(doc) + 1)
                for i, x in enumerate(part, 1):
                    last, row[0] = row[0], i
                    for j, y in enumerate(doc, 1):
                        last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
                if min(row) * 10 <= len(part):
                    return True
        return False

    rng, agree, sure = random.Random(5), 0, 0
    for _ in range(120):
        item = [rng.randrange(200) for _ in range(40)]
        a = rng.randrange(12)
        doc = item[a : a + rng.randrange(14, 28)]
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(doc))
            doc[i : i + 1] = rng.choice([[999], [], [doc[i], 999]])
        doc = [rng.randrange(500, 600) for _ in range(5)] + doc + [rng.randrange(500, 600) for _ in range(5)]
        got, want = L.holds_stretch(np.array(doc), np.array(item), 20), brute(doc, item, 20)
        agree += got == want
        sure += got and not want
    assert agree >= 114 and sure <= 2


def test_copies_and_empty_tables(spark):
    assert leaked(spark, [ITEMS[0][2]] * 40) == {(i, 1) for i in range(40)}
    assert leaked(spark, []) == set() and leaked(spark, [ITEMS[0][2]], []) == set()
    assert leaked(spark, [ITEMS[0][2]], [(1, None, None), (2, "en", ""), (3, "en", "short")]) == set()


def test_report(spark):
    docs = spark.createDataFrame([(0, ITEMS[0][2]), (1, ITEMS[0][2])], "doc_id long, text string")
    assert {r["item_id"]: r["n_docs"] for r in L.leaked_items(docs, items(spark)).collect()} == {1: 2, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0}


def brute(doc, item, least):
    """Every stretch of the item against every stretch of the document by edit distance."""
    for a in range(len(item)):
        row = [[0] * (len(doc) + 1)]
        for b in range(a + 1, len(item) + 1):
            last, new = row[-1], [b - a]
            for j, y in enumerate(doc, 1):
                new.append(min(last[j] + 1, new[j - 1] + 1, last[j - 1] + (item[b - 1] != y)))
            row.append(new)
            if b - a >= least and min(new) * 10 <= b - a:
                return True
    return False


@pytest.mark.parametrize("least", [20, 30])
def test_changes_near_the_ends(least):
    """One change, or as many as are allowed, at places 1 to 4 from either end of the shortest stretch."""
    import numpy as np

    item = list(range(50))
    for n in (least, least + 1):
        near = [*range(4), *range(n - 4, n)]
        for at in [[x] for x in near] + [sorted({x, y}) for x in near for y in range(0, n, 3)] + [sorted([x, n // 2 - 3, n // 2 + 2]) for x in near]:
            for how in ("change", "leave out", "add"):
                doc = item[10 : 10 + n]
                for x in at[::-1]:
                    doc[x : x + 1] = {"change": [999], "leave out": [], "add": [doc[x], 999]}[how]
                doc = [500] * 5 + doc + [600] * 5
                want = brute(doc, item, least)
                assert L.holds_stretch(np.array(doc), np.array(item), least) == want, (n, at, how)
                assert want or len(at) * 10 > n


@pytest.mark.parametrize("least", [20, 30])
def test_brute_force_agrees_always(least):
    import numpy as np

    rng, held = random.Random(11), 0
    for few in (200, 4):  # with words that occur once, and with the same few again and again
        for _ in range(250):
            item = [rng.randrange(few) for _ in range(2 * least + 5)]
            a = rng.randrange(least // 2)
            doc = item[a : a + rng.randrange(least - 3, 2 * least)]
            for _ in range(rng.randrange(6)):
                i = rng.randrange(len(doc))
                doc[i : i + 1] = rng.choice([[999], [], [doc[i], 999]])
            doc = [rng.randrange(500, 600) for _ in range(5)] + doc + [rng.randrange(500, 600) for _ in range(5)]
            want = brute(doc, item, least)
            held += want
            assert L.holds_stretch(np.array(doc), np.array(item), least) == want
    assert 100 < held < 450


def test_shortest_stretch_with_a_change_near_its_end(spark):
    def altered(units, at, new, sep):
        return sep.join([*units[:at], new, *units[at + 1 :]])

    w, zh = words(1)[:20], list(L.plain(ITEMS[3][2]))[:30]
    texts = [altered(w, at, "zzz", " ") for at in (1, 2, 3, 16, 17, 18)] + [altered(zh, at, "龘", "") for at in (1, 2, 3, 26, 27, 28)]
    assert leaked(spark, texts) == {(i, 1) for i in range(6)} | {(i, 4) for i in range(6, 12)}


FOLLOWED = [
    (i, "en", t + " Answer from the notes only.")
    for i, t in enumerate(
        [
            "In 1802 the clerk told Sixten of Raswistad that Sixten owes 415 coins to the mill of Raswistad, and Sixten paid 415 of them.",
            "The letter of 1776 says that Merle of Dalzoton lent Yorick the lamp, and that Yorick of Dalzoton gave Merle 62 sacks for it.",
            "When the bridge fell, the ferryman sent Halka to Ovgeton for 97 blankets, and Halka came back from Ovgeton with just 97 buttons.",
            "Als die Brücke einstürzte, schickte der Seiler Halka nach Ovgeton, und Halka brachte dem Seiler aus Ovgeton 137 Decken und 137 Säcke mit.",
        ],
        1,
    )
]
VALUES = ["Sixten", "Raswistad", "Merle", "Dalzoton", "Yorick", "Halka", "Ovgeton", "1802", "415", "1776", "62", "97", "137"]


def bound(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("windows", F.lit("x"))
    return {(r["doc_id"], r["item_id"]) for r in L.reparameterised(docs, items(spark, FOLLOWED)).collect()}


def test_bindings_decide(spark):
    """Values that correspond one to one make a case; values bound in two ways, the item's own values and other texts don't."""
    rng, right, wrong = random.Random(9), [], []
    fresh = ["Quirin", "Peldorn", "Gavton", "Nilo", "Zelda", "Wibke", "Istmor", "88", "12", "731", "1654"]
    for n in range(40):
        item = FOLLOWED[n % 4][2]
        used = [v for v in VALUES if re.search(rf"\b{v}\b", item)]
        new = dict(zip(used, rng.sample([f for f in fresh if not f.isdigit()], sum(not v.isdigit() for v in used)), strict=False))
        new = {v: rng.choice(["88", "12", "731"]) if v.isdigit() else new.get(v, v) for v in used}
        if len(set(new.values())) < len(new):
            continue
        swapped = re.sub(r"\b(" + "|".join(used) + r")\b", lambda m: new[m[1]], item)
        right.append((swapped, n % 4 + 1))
        twice = next(v for v in used if len(re.findall(rf"\b{v}\b", item)) > 1)
        last = swapped.rfind(new[twice])
        wrong.append(swapped[:last] + ("9" if twice.isdigit() else "Fenna") + swapped[last + len(new[twice]) :])
    got = bound(spark, [t for t, _ in right])
    want = {(i, item) for i, (_, item) in enumerate(right)}
    assert len(want) > 25 and len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)
    # with a second binding only a stretch that ends before it can count
    short = {d for d, _ in bound(spark, wrong)}
    assert len(short) < len(wrong)
    assert bound(spark, [f[2] for f in FOLLOWED] + ["The weather was fine and nobody went to the mill of the old town in the year of the flood."]) == set()


def test_german_nouns_are_no_names():
    lex = L.Lexicon([t for _, _, t in FOLLOWED] + ["Die Brücke von Velfesen fiel, und der Zug nach Velfesen stand an einem Markt."], L.WORDS)
    kind = {w: lex.kind[i] for w, i in lex.number.items()}
    assert [kind[w] for w in ("brücke", "seiler", "zug", "markt", "bridge", "the")] == [L.LITERAL] * 6
    assert [kind[w] for w in ("halka", "ovgeton", "velfesen", "sixten", "yorick")] == [L.NAME] * 5 and kind["415"] == L.NUMBER


def test_many_items_in_blocks(spark, monkeypatch):
    w = words(1)
    texts = [ITEMS[0][2], " ".join(w[5:25]), ITEMS[3][2], "x", ITEMS[1][2], ITEMS[2][2]]
    want = leaked(spark, texts)
    monkeypatch.setattr(L, "MAX_ITEMS", 2)
    assert leaked(spark, texts) == want and len(want) >= 5


def test_pieces_of_long_documents(spark):
    """A quotation is found wherever it lies, across the borders of pieces too."""
    quote, filler = " ".join(words(1)[2:24]), ["zeta"] * 9000
    texts = []
    for at in (0, L.PIECE - 30, L.PIECE - 10, L.PIECE, L.PIECE + L.OVERLAP - 11, 2 * L.PIECE + 60, 8990):
        texts.append(" ".join(filler[:at] + [quote] + filler[at:]))
    assert leaked(spark, [*texts, " ".join(filler)]) == {(i, 1) for i in range(len(texts))}
