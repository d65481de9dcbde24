import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qatlam import train_bpe
from qatlam.operators import bpe as B
from qatlam.plans import pairs as P

CORPUS = [
    "Salom! O'zbekiston - go'zal va mehmondo'st yurt!", "Maktablarimizda o'quvchilar va o'qituvchilar ko'p.", "Bog'da 100% yangi ko'chatlar va daraxtlar o'smoqda.",
    "Kitoblarimiz va daftarlarimiz maktabda qoldi.", "To'g'ri so'z - a'lo fazilat, ma'no va san'at.", "Mexanizatsiyalashtirish bo'yicha ishlar boshlandi.",
    "O'zbekiston tarixi juda qadimiy va boydir.", "2026-yilda yangi marralar zabt etiladi.",
]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.fixture(scope="module")
def model(spark):
    return B.train(docs(spark, *CORPUS, None, ""), 150, 2)


def test_model(model):
    assert [model.vocab[t] for t in B.SPECIALS] == [0, 1, 2, 3]
    assert len(model.merges) > 0 and len(model) <= 150 and sorted(model.vocab.values()) == list(range(len(model)))
    assert model[model.vocab["a"]] == "a" and "a" in model
    with pytest.raises(KeyError):
        model["nothing"]


def test_merges_are_greedy(spark, model):
    """Each merge is the most frequent pair of what the ones before it left."""
    words = {r["word"]: r["n"] for r in B.word_counts(docs(spark, *CORPUS)).collect()}
    pieces = {w: list(w) for w in words}
    for pair in model.merges:
        counts = Counter()
        for w, n in words.items():
            for p in zip(pieces[w], pieces[w][1:], strict=False):
                counts[p] += n
        assert pair == min(counts, key=lambda p: (-counts[p], p))
        pieces = {w: B._merge(p, *pair) for w, p in pieces.items()}
    assert all(B.segment(w, model.ranks) == p for w, p in pieces.items())


def test_distributed_steps_agree(spark, model):
    size = 4 + len({c for w in B.word_counts(docs(spark, *CORPUS)).collect() for c in w["word"]}) + 1 + 10
    small = B.train(docs(spark, *CORPUS), size, 2)
    assert len(small.merges) == 10 and B.train(docs(spark, *CORPUS), size, 2, driver_words=0).merges == small.merges == model.merges[: len(small.merges)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=9), min_size=1, max_size=8))
def test_merge_expression(spark, texts):
    df = spark.createDataFrame([(list(t),) for t in texts], "p array<string>").select("p", B.merge_pieces(F.col("p"), "a", "b").alias("x"), B.merge_pieces(F.col("p"), "a", "a").alias("y"))
    for p, x, y in df.collect():
        assert (x, y) == (B._merge(p, "a", "b"), B._merge(p, "a", "a"))


def test_round_trip(spark, model):
    texts = [*CORPUS, "yangi  so'z", "", None]
    ids = B.encode(docs(spark, *texts), model, add_bos=True, add_eos=True)
    lists = {r["doc_id"]: r["ids"] for r in ids.collect()}
    assert all(x[0] == 2 and x[-1] == 3 for x in lists.values()) and lists[9] == [2, 3] == lists[10]
    back = {r["doc_id"]: r["text"] for r in B.decode(ids, model.vocab_table(spark)).collect()}
    plain = docs(spark, *texts).select("doc_id", F.coalesce(B.T.normalize_apostrophes("text"), F.lit(""))).collect()
    assert back == {i: t for i, t in plain}
    assert B.decode(spark.createDataFrame([(1, [0, 99999])], "doc_id long, ids array<int>"), model.vocab_table(spark), skip_special=False).first()["text"] == "<pad><unk>"


def test_pieces(spark, model):
    for r in B.tokenize(docs(spark, *CORPUS), model).collect():
        assert "".join(r["pieces"]) == r["word"]


def test_padding(spark):
    df = spark.createDataFrame([("a", [1, 2, 3]), ("a", [1]), ("b", [5, 6])], "k string, ids array<int>")
    assert sorted(tuple(r["ids"]) for r in B.pad_batch(df).collect()) == [(1, 0, 0), (1, 2, 3), (5, 6, 0)]
    assert sorted(tuple(r["ids"]) for r in B.pad_batch(df, "k").collect()) == [(1, 0, 0), (1, 2, 3), (5, 6)]
    assert sorted(tuple(r["ids"]) for r in B.pad_batch(df, max_length=2).collect()) == [(1, 0), (1, 2), (5, 6)]
    assert B.pad_batch(df.limit(0)).count() == 0


def test_files(model, tmp_path):
    model.save(str(tmp_path / "m.json"))
    again = B.Model.load(str(tmp_path / "m.json"))
    assert (again.merges, again.vocab, again.vocab_size) == (model.merges, model.vocab, 150)
    (tmp_path / "bad.json").write_text("{}")
    (tmp_path / "worse.json").write_text("not json")
    for name, error in (("none.json", FileNotFoundError), ("bad.json", ValueError), ("worse.json", ValueError)):
        with pytest.raises(error):
            B.Model.load(str(tmp_path / name))


def test_refusals(spark):
    with pytest.raises(ValueError):
        B.Model(3)
    with pytest.raises(ValueError):
        B.train(docs(spark, "a"), 100, 0)
    assert B.train(docs(spark, None, ""), 100).vocab == B.SPECIALS
    with pytest.raises(ValueError):
        B.train(docs(spark, "a").limit(0), 100)


def test_command(spark, tmp_path):
    (tmp_path / "c.txt").write_text("Salom salom SALOM\ndunyo\n", encoding="utf-8")
    train_bpe.main(["--corpus", str(tmp_path / "c.txt"), "--output", str(tmp_path / "o.json"), "--vocab_size", "30"])
    trained = B.Model.load(str(tmp_path / "o.json"))
    assert trained.vocab["[PAD]"] == 0 and "salom" in trained


def test_registered_model_has_the_default_size(spark, data):
    """The queries' merges are those of a model trained with nothing said of its size."""
    full = B.train(P.table(spark, data, "documents"))
    assert len(full.merges) > 1200
    assert [(r["left"], r["right"]) for r in P.bpe_train(spark, data).orderBy("rank").collect()] == full.merges
    assert P.bpe_train_plain(spark, data).count() > 1200


def test_linked_merges_against_plain_ones():
    rng = random.Random(11)
    for _ in range(200):
        words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))): rng.randrange(1, 5) for _ in range(6)}
        greedy, pieces = B._Greedy(words.items()), {w: list(w) for w in words}
        while top := greedy.best():
            counts = Counter()
            for w, n in words.items():
                for p in zip(pieces[w], pieces[w][1:], strict=False):
                    counts[p] += n
            assert top == (want := min(counts.items(), key=lambda x: (-x[1], x[0]))) or (top[1], top[0]) == (want[1], want[0])
            greedy.join(top[0])
            pieces = {w: B._merge(p, *top[0]) for w, p in pieces.items()}
        assert all(len(p) == 1 for p in pieces.values())


def test_words_and_marks(spark):
    """As the pre-tokenizers Whitespace and Punctuation, one after the other, have it."""
    from tokenizers.pre_tokenizers import Punctuation, Sequence, Whitespace

    cut = Sequence([Whitespace(), Punctuation()])
    texts = [*CORPUS, "a_b--c €$+5 x", "oʻzbek maʼno", "ёлка №5 — «да»…", "नमस्ते 你好。", "é̈ x‿y", "", "  "]
    got = {r["doc_id"]: r["w"] for r in docs(spark, *texts).select("doc_id", B.T.words_and_marks("text").alias("w")).collect()}
    assert got == {i: [w for w, _ in cut.pre_tokenize_str(t)] for i, t in enumerate(texts)}


def test_nothing_is_shuffled(spark, model):
    for df in (B.tokenize(docs(spark, *CORPUS), model), B.encode(docs(spark, *CORPUS), model), B.decode(B.encode(docs(spark, *CORPUS), model), model.vocab_table(spark))):
        assert "Join" not in (plan := df._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning" not in plan


def test_words_beyond_those_kept(spark, model, monkeypatch):
    calls = []
    monkeypatch.setattr(B, "KEPT_WORDS", 2)
    get = B._remembered(lambda w: calls.append(w) or w.upper())
    assert [get(w) for w in "a b a c a b".split()] == list("ABACAB") and calls == ["a", "b", "c", "a", "b"]
