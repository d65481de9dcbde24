import random

import numpy as np

from qatlam.llm import leaks as L

VOCAB = [a + b + c for a in ("ka", "mo", "shi", "to", "zu") for b in ("lin", "rat", "bek", "dor") for c in ("da", "lar", "ni", "gan", "mi")]
ITEM = [VOCAB[(i * 37) % 97] for i in range(60)]


def doc(middle, seed=0):
    rng = random.Random(seed)
    noise = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    return " ".join(noise[:30]) + " " + " ".join(middle) + " " + " ".join(noise[30:])


def leaks(spark, docs, items, **how):
    """{doc_id: {item_id: row}} of texts by id."""
    found = L.find_leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"), **how)
    out = {d: {} for d in docs}
    for r in found.collect():
        out[r["doc_id"]][r["item_id"]] = r
    return out


OWN = {1: " ".join(ITEM), 2: "Matnni oʻqing va savolga javob yozing " + " ".join(reversed(ITEM))}
CYR = "Ўзбекистон ерида ғалаба учун янги эртак ёзган шоир бугун яна шаҳар боғида шогирдлари билан учрашди"
LAT = "Oʻzbekiston yerida gʻalaba uchun yangi ertak yozgan shoir bugun yana shahar bogʻida shogirdlari bilan uchrashdi"
HAN = "春天来了花园里的花都开了孩子们在树下唱歌跳舞老人们坐在长椅上看着远处的山和天边的云彩慢慢变红"
MYA = "နေပူသောနေ့တစ်နေ့တွင်ကလေးများသည်မြစ်ကမ်းဘေးတွင်ကစားနေကြပြီးအဘိုးအိုကငါးဖမ်းနေသည်"
DEV = "नमस्ते दोस्तों आज हम सब मिलकर नदी के किनारे बैठेंगे और पुराने दिनों की बातें करेंगे फिर शाम को घर लौटेंगे"


def changed(seed):
    rng = random.Random(seed)
    words = []
    for k, w in enumerate(ITEM):
        if k % 8 == 5:
            kind = rng.randrange(3)
            words += ["zzz"] if kind == 0 else [w, "zzz"] if kind == 1 else []
        else:
            words.append(w)
    return doc(words, seed)


def two_of_fourteen(kind):
    """Fourteen words with the fourth and the ninth changed, missing, or one more after them: no five words running agree."""
    out = []
    for k, w in enumerate(ITEM[:14]):
        out += [w] if k not in (3, 8) else {"changed": [f"zz{k}"], "missing": [], "more": [w, f"zz{k}"]}[kind]
    return doc(out, 7)


def test_cases(spark):
    rng = random.Random(4)
    shuffled = ITEM[:]
    rng.shuffle(shuffled)
    items = OWN | {3: LAT, 4: HAN, 5: MYA, 6: DEV}
    copied = {
        10: doc(ITEM), 11: doc(ITEM[20:33]), 12: "\n".join(ITEM).upper().replace(" ", ", "), 13: doc(ITEM[:13], 1) + " " + doc(ITEM[40:53], 2), **{100 + k: changed(k) for k in range(12)},
        30: two_of_fourteen("changed"), 31: two_of_fourteen("missing"), 32: two_of_fourteen("more"),
    }
    written = {40: CYR.replace(" ", " — "), 41: "O'zbekiston yerida g`alaba uchun yangi ertak, yozgan shoir! Bugun yana SHAHAR bog’ida shogirdlari bilan uchrashdi"}
    scripts = {50: "前面" + HAN, 51: HAN[6:40], 52: MYA, 53: "x " + DEV.replace(" ", "  ") + " y", 54: "、".join(HAN)}
    no = {
        60: doc(shuffled), 61: doc(ITEM[10:18]), 62: doc([w for x in ITEM[:20] for w in (x, "aa", "bb", "cc")]), 63: "Matnni oʻqing va savolga javob yozing " * 3, 64: "", 65: " ",
        66: "".join(random.Random(1).sample(HAN, len(HAN))), 67: HAN[:12], 68: DEV[:40],
    }
    got = {d: set(x) for d, x in leaks(spark, copied | written | scripts | no, items).items()}
    assert {d: got[d] for d in copied} == dict.fromkeys(copied, {1})
    assert {d: got[d] for d in written} == dict.fromkeys(written, {3})
    assert {d: got[d] for d in scripts} == {50: {4}, 51: {4}, 52: {5}, 53: {6}, 54: {4}}
    assert {d: got[d] for d in no} == dict.fromkeys(no, set())


def test_stock_of_many_items(spark):
    """A passage that many items share is nobody's; an item is found by what is its own, its copies too."""
    header = "Quyidagi matnni diqqat bilan oʻqing va berilgan savollarga toʻliq javob yozing hamda fikringizni isbotlang"
    rng = random.Random(3)
    own = {k: header + " " + " ".join(f"soz{rng.randrange(10**6)}" for _ in range(30)) for k in range(300)}
    own[300] = own[299]
    docs = {1: header, 2: "Bosh soʻz. " + header + " oxiri", 3: own[7], 4: " ".join(own[9].split()[14:]), 5: own[299].upper()}
    assert {d: set(x) for d, x in leaks(spark, docs, own).items()} == {1: set(), 2: set(), 3: {7}, 4: {9}, 5: {299, 300}}


def test_items_that_share_nearly_all(spark):
    """However many items share a passage or a template, it is no stock if they are made of it; what one item alone has tells them apart."""
    rng = random.Random(8)

    def own(n):
        return " ".join(f"soz{rng.randrange(10**6)}" for _ in range(n))

    header = own(14)
    passage, sentence = header + " " + own(60), "agar {a} kg olma bilan {b} kg nok va {c} dona uzum yana {d} dona anor olinib {e} kishiga teng boʻlinsa har biriga qancha tegadi"
    questions = {k: passage + " " + own(10) for k in range(6)}
    near = own(20).split()
    variants = {10 + k: " ".join([*near[:6], f"bir{k}", *near[6:15], f"ikki{k}", *near[15:]]) for k in range(8)}
    values = {20 + k: {v: 10 * k + n + 1 for n, v in enumerate("abcde")} for k in range(9)}
    problems = {k: sentence.format(**v) for k, v in values.items()}
    others = {100 + k: header + " " + own(30) for k in range(60)}
    names = {200 + k: " ".join(f"dedi {n}{k} keyin" for n in ("Alisher", "Botir", "Vali", "Gani", "Davron", "Elyor", "Zokir")) for k in range(7)}
    docs = {
        1: doc(questions[2].split()[30:60]), 2: doc(questions[2].split(), 1), 3: doc(header.split()), 4: doc(variants[13].split()), 5: doc(variants[13].split()[7:15] + variants[13].split()[:3]),
        6: doc(problems[23].split()), 7: doc(sentence.format(a=901, b=902, c=903, d=904, e=905).split()), 8: "bugun u " + names[203] + " deb yozdi",
    }
    got = leaks(spark, docs, questions | variants | problems | others | names)
    assert set(got[1]) == set(got[2]) == set(questions)
    assert set(got[3]) == set() and set(got[5]) == set()
    assert set(got[4]) == set(variants) and got[4][13]["edits"] == 0
    assert set(got[6]) == set(got[7]) == set(problems) and got[6][23]["edits"] == 0
    assert 203 in got[8] and not got[8][203]["reparameterised"]


def test_numbers_alone(spark):
    """An item of nothing but numbers is found by their values in order."""
    rng = random.Random(2)
    numbers = [str(rng.randrange(10**4)) for _ in range(20)]
    docs = {1: doc(numbers), 2: doc(numbers[3:17], 1), 3: doc(sorted(numbers), 2), 4: doc([str(int(n) + 1) for n in numbers], 3), 5: doc([*numbers[:8], "7", *numbers[9:]], 4)}
    assert {d for d, x in leaks(spark, docs, {1: " ".join(numbers)}).items() if x} == {1, 2, 5}


def test_items_of_a_document_in_parts(spark, monkeypatch):
    """Items held in several rows for one document give the same pairs."""
    items = {k: " ".join(ITEM[k : k + 20]) for k in range(0, 40, 10)}
    whole = leaks(spark, {1: doc(ITEM)}, items)
    monkeypatch.setattr(L, "ITEMS_AT_ONCE", 1)
    assert leaks(spark, {1: doc(ITEM)}, items) == whole and set(whole[1]) == set(items)


def test_stock_of_many_documents(spark, monkeypatch):
    monkeypatch.setattr(L, "STOCK_DOCUMENTS", 5)
    greeting = " ".join(f"salom{k}" for k in range(14))
    own = " ".join(ITEM[:30])
    docs = {k: doc([], k) + " " + greeting for k in range(40)} | {100 + k: doc(ITEM[:30], k) for k in range(3)} | {200 + k: own + " " + greeting for k in range(2)}
    got = leaks(spark, docs, {1: own + " " + greeting})
    assert {d for d, x in got.items() if x} == {100, 101, 102, 200, 201}


def test_reparameterised(spark):
    text = "agar {a} kg olma va {b} kg nok olinsa hammasi necha kg boʻladi deb soʻradi {n} oʻz shogirdi {m} dan keyin yana {a} kg qoʻshdi"
    fill = dict(a=35, b=9, n="Karim", m="Salim")
    docs = {1: text.format(**fill), 2: text.replace("{a}", "40", 1).format(**fill), 3: text.format(a=12, b=7, n="Anvar", m="Botir")}
    got = leaks(spark, docs, {1: text.format(a=12, b=7, n="Anvar", m="Botir")})
    assert set(got[1]) == set(got[2]) == set(got[3]) == {1}
    assert got[2][1]["edits"] > got[1][1]["edits"] and got[3][1]["edits"] == 0 and not got[3][1]["reparameterised"]


def test_template_of_a_word_problem(spark):
    """Where nearly every word is a slot or beside one, the template alone joins the two."""
    text = "Olim {a} dona, Vali {b} dona, Soli {c} dona, Gani {d} dona, Toir {e} dona kitob oldi va {a} dona berdi"
    got = leaks(spark, {1: text.format(a=31, b=32, c=33, d=34, e=35)}, {1: text.format(a=1, b=2, c=3, d=4, e=5)}, edit_every=6)
    assert got[1][1]["edits"] == 0


def test_slots_and_units():
    w = L.Words(["Olma 5 kg va 3 soatda Karim keldi kg", "", "7 mkm 2026-yilning kuni"])
    assert w.kinds.tolist() == [0, L.NUMBER, L.UNIT, 0, L.NUMBER, L.UNIT, L.NAME, 0, 0, L.NUMBER, L.UNIT, L.NUMBER, L.UNIT, 0]
    assert w.starts.tolist() == [0, 9, 9, 14]


def test_windows_against_single_texts():
    """A batch's windows are those of its texts one by one; none crosses from one text into the next."""
    texts = [doc(ITEM), "a b c", "", doc(ITEM[:20], 3) + " 5 kg Karim 7 dollar", LAT, HAN]

    def keys(batch):
        w = L.Words(batch)
        return sorted((int(np.searchsorted(w.starts, a, side="right") - 1), int(k)) for at, key, _ in w.windows() for a, k in zip(at, key, strict=True))

    assert keys(texts) == sorted((n, k) for n, t in enumerate(texts) for _, k in keys([t]))


def test_bitmap(spark):
    rng = np.random.default_rng(5)
    keys = rng.integers(-(2**63), 2**63 - 1, 5000)
    held = L._bitmap(spark.createDataFrame([(int(k),) for k in keys], "key long"), 5000)
    assert L._in_bitmap(keys, held).all()
    assert L._in_bitmap(rng.integers(-(2**63), 2**63 - 1, 100_000), held).mean() < 0.01
    assert not L._in_bitmap(keys, L._bitmap(spark.createDataFrame([], "key long"), 0)).any()


def test_alignment_breaks_off():
    item = list(range(40))
    assert L.align(item[:20] + [99] * 11 + item[20:], item)[:3] == (20, 0, 20)
    assert L.align(item[5:30], item, band=(-8, -2)) == L.align(item[5:30], item) and L.align(item[5:30], item, stock=frozenset(range(10)))[4] == 20
    assert L.align([99, *item[:10], 98, *item[10:20]], item)[:3] == (20, 1, 20)
    assert L.align([], item)[0] == 0 and L.align(item, [])[0] == 0


def test_other_alignments_than_the_best():
    """A stretch holds the item if any alignment of it does: the best one may run on into a denser part, or end at its last edit."""
    item = [f"a{k}" for k in range(60)]
    dense = [w if k % 4 else "zz" for k, w in enumerate(item)]

    def held(doc, stock=frozenset()):
        hits = [(p, i) for p in range(len(doc) - 4) for i in range(len(item) - 4) if doc[p : p + 5] == item[i : i + 5]] or [(0, 0)]
        return L.judge(doc, [0] * len(doc), item, [0] * len(item), hits, stock, 12, 6) is not None

    assert held(item[:13] + dense[13:]) and held(dense[:47] + item[47:]) and held(dense[:24] + item[24:37] + dense[37:])
    assert held([item[0], "zz", *item[2:13], "y"]) and held(["y", *item[:11], "zz", item[12]])
    assert not held(dense) and not held(item[:11]) and not held([*item[:11], "zz"]) and not held([*item[:6], "zz", "zz", "zz", *item[9:14]])
    assert held(["zz", *item[47:]], stock=frozenset(range(47))) and not held(dense[:20] + item[20:33], stock=frozenset(range(60)))


def test_tables(spark):
    docs = spark.createDataFrame([(1, doc(ITEM), "x"), (1, doc(ITEM), "y"), (2, doc(ITEM[:15] + ["q"] * 30 + ITEM[::-1][:20]), "x"), (3, None, "x"), (None, doc(ITEM), "x"), (4, "", "x")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(10, " ".join(ITEM)), (11, " ".join(ITEM[::-1])), (12, None), (None, "x"), (10, " ".join(ITEM))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in L.find_leaks(docs, items).collect()}
    assert got == {(1, 10), (2, 10), (2, 11)}
    assert L.find_leaks(docs, items).count() == 3
    assert L.find_leaks(docs, items.limit(0)).count() == 0 and L.find_leaks(docs.limit(0), items).count() == 0


def test_batches_in_pieces(spark, monkeypatch):
    """Pieces of any size hold whole texts and give the same pairs."""
    import pandas as pd

    batch = pd.DataFrame({"text": ["a" * n for n in (5, 0, 90, 3, 3, 200, 1)]})
    monkeypatch.setattr(L, "CHARS_AT_ONCE", 50)
    pieces = list(L._pieces(iter([batch, batch.iloc[:0]])))
    assert len(pieces) > 2 and [t for p in pieces for t in p["text"]] == batch["text"].tolist()
