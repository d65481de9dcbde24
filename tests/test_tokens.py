import json

import pytest
from pyspark.sql import functions as F

from qatlam.operators import analysis as A
from qatlam.operators import bpe as B
from qatlam.operators import tokens as K
from qatlam.operators import vocab as V
from qatlam.sources import lexicon as X
from qatlam.sources import models as M

STEMS = ["kitob", "maktab", "o'qi", "yoz"]


@pytest.fixture(scope="module")
def stems(spark):
    return X.dictionary(spark.createDataFrame([(s,) for s in STEMS], "stem string"))


@pytest.fixture(scope="module")
def affixes(spark):
    return A.default_affixes(spark)


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def strings(spark, stems, affixes, text, style, **more):
    row = K.token_strings(K.tokenize(docs(spark, text), stems, affixes, **more), style).first()
    return row["strings"] if row else []


def test_styles(spark, stems, affixes):
    assert strings(spark, stems, affixes, "kitoblarimizga", "hybrid") == ["Ġkitob", "##lar", "##imiz", "##ga"]
    assert strings(spark, stems, affixes, "kitoblarimizga", "bert") == ["kitob", "##lar", "##imiz", "##ga"]
    assert strings(spark, stems, affixes, "Kitobda, KITOBDA!", "plus") == ["Kitob", "+da", ",", "KITOB", "+da", "!"]
    assert strings(spark, stems, affixes, "kitobda", "gpt") == ["Ġkitob", "da"]
    assert strings(spark, stems, affixes, "kitobda", "sentencepiece") == [" kitob", "da"]
    assert strings(spark, stems, affixes, "kitobda", "none") == ["kitob", "da"]


def test_tokens(spark, stems, affixes):
    rows = K.tokenize(docs(spark, "Maktabda <b>Pythonda</b> 7 zzz.", None, "", " "), stems, affixes, include_spaces=True).orderBy("doc_id", "pos").collect()
    assert [(r["doc_id"], r["text"], r["token_type"], r["is_morph"], r["is_bpe"]) for r in rows] == [
        (0, "Maktabda", "word", True, False), (0, " ", "whitespace", False, False), (0, "Pythonda", "word", True, False), (0, " ", "whitespace", False, False),
        (0, "7", "word", False, False), (0, " ", "whitespace", False, False), (0, "zzz", "word", False, False), (0, ".", "punctuation", False, False),
    ]
    assert rows[0]["morph"]["root"] == "maktab" and rows[2]["morph"]["is_found"] is False and rows[2]["morph"]["root"] == "python"


def test_bpe_fallback(spark, stems, affixes):
    model = B.train(docs(spark, "python python python zzz zzz"), 40, 1)
    rows = {r["text"]: r for r in K.tokenize(docs(spark, "Kitobda pythonda zzz"), stems, affixes, model=model).collect()}
    assert (rows["Kitobda"]["is_bpe"], rows["Kitobda"]["subtokens"]) == (False, None)
    assert (rows["pythonda"]["is_morph"], rows["pythonda"]["is_bpe"], "".join(rows["pythonda"]["subtokens"])) == (True, True, "python")
    assert (rows["zzz"]["is_morph"], rows["zzz"]["is_bpe"], rows["zzz"]["morph"]) == (False, True, None)
    assert strings(spark, stems, affixes, "pythonda", "hybrid", model=model)[-1] == "##da"


def test_stats_and_records(spark, stems, affixes):
    t = K.tokenize(docs(spark, "Kitobda, zzz maktab."), stems, affixes)
    s = K.token_stats(t, stems).first().asDict()
    assert s == {"total_tokens": 3, "morph_found": 2, "morph_not_found": 1, "bpe_used": 0, "punct_tokens": 2, "num_tokens": 0, "morph_accuracy": "66.7%", "bpe_trained": False, "dictionary_size": 4}
    assert K.token_stats(t.limit(0)).first()["morph_accuracy"] == "N/A"
    record = json.loads(t.where("text = 'Kitobda'").select(K.token_record()).first()[0])
    assert record["morph"]["status"] == "found" and "subtokens" not in record
    assert K.method_metrics(t).first()["root_share"] == pytest.approx(2 / 3)
    assert K.quick_tokenize(docs(spark, "Kitobda"), stems, affixes).first()["strings"] == ["Kitob", "+da"]
    assert t.where("text = 'Kitobda'").select(K.token_root(F.col("morph"))).first()[0] == "kitob"


def test_vocabulary(spark, stems, affixes):
    vocab = V.build_vocab(spark, stems)
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    assert sorted(ids.values()) == list(range(5 + len(V.MARKS) + 66 + 4))
    assert ids["<pad>"] == 0 and ids["<mask>"] == 4 and ids["."] == 5 and ids["##lashtir"] == 5 + len(V.MARKS) and ids["Ġyoz"] == max(ids.values())
    tokens = K.token_strings(K.tokenize(docs(spark, "Kitoblar, zzz MAKTABDA.", ""), stems, affixes), "hybrid")
    encoded = V.encode(tokens, vocab)
    assert encoded.first()["ids"] == [ids["Ġkitob"], ids["##lar"], ids[","], 1, ids["Ġmaktab"], ids["##da"], ids["."]]
    assert V.decode(encoded, vocab).first()["text"] == "kitoblar, maktabda."
    assert V.decode(spark.createDataFrame([(1, []), (2, [1, 999999])], "doc_id long, ids array<int>"), vocab).select("text").distinct().collect()[0][0] == ""


def test_folder(spark, stems, tmp_path):
    model = B.train(docs(spark, "kitob kitob maktab"), 30, 1)
    M.save_tokenizer(str(tmp_path / "t"), stems, model, M.Settings(max_depth=7))
    back, again, settings = M.load_tokenizer(spark, str(tmp_path / "t"))
    assert {r[0] for r in back.collect()} == {"kitob", "maktab", "oʻqi", "yoz"}
    assert (again.merges, again.vocab, settings.max_depth, settings.has_bpe) == (model.merges, model.vocab, 7, True)
    assert json.loads((tmp_path / "t" / "vocab.json").read_text(encoding="utf-8"))["<unk>"] == 1
