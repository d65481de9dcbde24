import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from qatlam.llm import encoding as E

LATIN = "kitob maktab oʻzbek gʻalaba maʼno bilan uchun yangi katta daftar shahar daryo bogʻ togʻ oʻqituvchi kelgan yozgan bordi".split()
CYRILLIC = "китоб мактаб ўзбек ғалаба билан учун янги катта дафтар шаҳар дарё қишлоқ ўқитувчи келган ёзган борди отсонни личитлар".split()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    return [("tokens", i, rng.choice(LATIN if rng.random() < 0.7 else CYRILLIC)) for i in range(6000)]


@pytest.fixture(scope="module")
def detector(spark, rows):
    texts = spark.createDataFrame(rows, "tbl string, row_id long, text string").select("text")
    return E.Detector(E.pair_scores(texts))


def garbled():
    for w in ("oʻqituvchi", "gʻalaba", "китоб", "ўқитувчи", "шаҳар"):
        raw = w.encode()
        for codec in ("latin-1", "cp1251", "koi8-r", "cp437", "mac_cyrillic"):
            try:
                yield raw.decode(codec), w
            except UnicodeDecodeError:
                pass
    for w in ("мактаб", "отсонни", "личитлар", "билан"):
        yield w.encode("cp1251").decode("latin-1"), w
        yield w.encode("koi8-r").decode("cp1251"), w
        yield w.encode("cp1251").decode("koi8-r"), w
    for w in ("kitob", "daftar"):
        yield (w + "lar" * (len(w) % 2)).encode().decode("utf-16-le"), w + "lar" * (len(w) % 2)
    twice = "gʻalaba".encode().decode("cp1252").encode().decode("cp1252", "ignore")
    yield twice, "gʻalaba"


@pytest.mark.parametrize(("text", "right"), list(garbled()))
def test_restored(detector, text, right):
    got = detector.judge(text)
    assert got.restored == right if got.kind != E.OPEN else right in got.candidates


def test_restored_in_a_corpus(spark, rows):
    """Single garbled values among ordinary ones, each restored; counts decide what the pairs leave open."""
    # bytes read two by two are whole values of their own characters: one in 6000 values isn't improbable yet
    wrong = {text: right for text, right in garbled() if not any("\u2e80" <= c for c in text)}
    more = [("analyses", k, text) for k, text in enumerate(wrong)]
    df = spark.createDataFrame(rows + more, "tbl string, row_id long, text string")
    for parts in (2, 7):
        got = {r["text"]: r["restored"] for r in E.find_garbled(df.repartition(parts)).collect()}
        assert got == wrong


@pytest.mark.parametrize("text", [*LATIN, *CYRILLIC, "naïve", "Êdöm", "señor", "请东争", "№", "°", "«", "👍", "ВСД", "КВВР", "уооое", "", " ", "oʻzbek’s", "José", "яна"])
def test_genuine(detector, text):
    assert detector.judge(text).kind in (None, E.OPEN)


def test_lost(detector):
    for text in ("ki�ob", "o\x80\x99", "ki??ob", "ш?ҳар"):
        assert detector.judge(text).kind == E.SURE
    assert detector.judge("ki�ob").restored is None
    for text in ("?", "???", "kim?", "— ?"):
        assert detector.judge(text).kind is None


def test_two_byte_text_read_byte_by_byte(detector):
    for right in ("kitob", "шаҳар"):
        for codec in ("utf-16-le", "utf-16-be"):
            assert detector.judge(right.encode(codec).decode("latin-1")) == E.Verdict(E.SURE, right)


def test_counts_decide_swaps(spark):
    """A form more common than what it would stand for is a word of its own; an open one needs a far more common word."""
    judged = spark.createDataFrame([("абв", E.SWAP, "где", []), ("жзи", E.SWAP, "йкл", []), ("мноп", E.OPEN, None, ["стуф", "хцчш"]), ("прст", E.OPEN, None, ["щъыь"])], "text string, kind string, restored string, candidates array<string>")
    texts = [("абв",)] * 9 + [("Где",)] * 3 + [("жзи",)] * 4 + [("мноп",)] * 2 + [("хцчш",)] * 9 + [("стуф",)] * 8 + [("прст",), (None,), ("щъыь",)]
    got = {(r["text"], r["restored"]) for r in E.decide_swaps(judged, spark.createDataFrame(texts, "text string")).collect()}
    assert got == {("жзи", "йкл"), ("мноп", "хцчш")}


@given(st.lists(st.floats(-5, 5, allow_nan=False).map(lambda x: round(x, 2)), max_size=30))
def test_segments(weights):
    """The maximal segments: the best one is found, and they don't overlap."""
    got = E.maximal_segments(weights)
    sums = np.concatenate([[0], np.cumsum(weights)])
    best = max((sums[j] - sums[i] for i in range(len(sums)) for j in range(i + 1, len(sums))), default=0)
    assert max((s for _, _, s in got), default=0) == pytest.approx(max(0, best))
    assert all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))
    assert all(s == pytest.approx(sums[e] - sums[b]) and s > 0 for b, e, s in got)


def test_pair_counts(spark):
    df = spark.createDataFrame([("ab",), ("ab",), ("",), (None,), ("A",)], "t string")
    got = {(r["a"], r["b"]): r["n"] for r in E.pair_counts(df).collect()}
    a, b = ord("a"), ord("b")
    assert got == {(0, a): 3, (a, b): 2, (b, 0): 2, (a, 0): 1}
    assert E.class_table().max() < E.CLASSES


def test_records(spark, rows):
    more = [("tokens", 9001, "gÊ»alaba"), ("tokens", 9001, "gÊ»alaba"), ("analyses", 9001, "ки�об"), ("tokens", 9002, None), ("tokens", None, "gÊ»alaba"), ("tokens", 9003, "kitоb")]
    got = {(r["tbl"], r["row_id"]): r["restored"] for r in E.find_garbled(spark.createDataFrame(rows + more, "tbl string, row_id long, text string")).collect()}
    assert got == {("tokens", 9001): "gʻalaba", ("analyses", 9001): None}
    assert E.find_garbled(spark.createDataFrame([], "tbl string, row_id long, text string")).count() == 0


def test_long_value(detector):
    assert detector.judge("kitob " * 20_000).kind is None


def test_every_candidate_is_tried(monkeypatch):
    detector = E.Detector(np.zeros((1, 1)))
    monkeypatch.setattr(E, "_inverse_utf8", lambda text: [*(f"no{i}" for i in range(50)), "yes"] if text == "garbled" else [])
    monkeypatch.setattr(E, "_inverse_pairs", lambda text: [])
    monkeypatch.setattr(E, "_plausible", lambda text: True)
    monkeypatch.setattr(detector, "cost", lambda text: 0.0 if text == "yes" else 100.0)
    assert detector._restore("garbled", "", "").restored == "yes"
