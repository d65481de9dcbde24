import json

import pytest

from qatlam.operators.bpe import Model
from qatlam.session import file_exists, read_text, write_text
from qatlam.sources import lexicon, models
from qatlam.tokenizer import Tokenizer, create_tokenizer

STEMS = "maktab qishloq ishla o'rtoq tayoq buloq quloq oyoq yurak tilak shahar singil burun o'g'il bag'ir ko'ngil qorin bo'yin og'iz bog' tog' kitob kod funksiya siz fayl yoz kel".split()
# words, the root and, where it is certain, the suffixes
WORDS = {
    "maktablarimizda": ("maktab", ["lar", "imiz", "da"]), "qishlog'imizdan": ("qishloq", ["imiz", "dan"]), "ishlaydigan": ("ishla", ["ydigan"]), "o'rtog'im": ("o'rtoq", None), "tayog'i": ("tayoq", None),
    "yuragimizda": ("yurak", None), "tilagingiz": ("tilak", None), "shahrimizda": ("shahar", None), "singlim": ("singil", None), "burni": ("burun", None), "o'g'lim": ("o'g'il", None), "ko'nglim": ("ko'ngil", None),
    "qorni": ("qorin", None), "bog'i": ("bog'", None), "tog'imiz": ("tog'", None), "kitoblarni": ("kitob", None), "kodda": ("kod", None), "funksiyasi": ("funksiya", None), "sizga": ("siz", None), "keldi": ("kel", ["di"]),
}


@pytest.fixture(scope="module")
def tokenizer(spark):
    return create_tokenizer(spark, STEMS)


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def plain(word):
    return word.replace("ʻ", "'").replace("ʼ", "'")


def test_analyses(spark, tokenizer):
    found = tokenizer.analyze(lexicon.dictionary(spark.createDataFrame([(w,) for w in WORDS], "w string")).withColumnRenamed("stem", "word"))
    got = {plain(r["word"]): r for r in found.collect()}
    assert {w: plain(got[w]["root"]) for w in WORDS} == {w: root for w, (root, _) in WORDS.items()}
    assert all(r["is_found"] for r in got.values())
    assert {w: [s["text"] for s in got[w]["suffixes"]] for w, (_, s) in WORDS.items() if s} == {w: s for w, (_, s) in WORDS.items() if s}


def test_texts(spark, tokenizer):
    docs = texts(spark, "Kitoblarimizga boring!", None, "")
    assert not tokenizer.has_bpe and tokenizer.dictionary_size == len(STEMS)
    strings = {r["doc_id"]: r["strings"] for r in tokenizer.tokenize_to_strings(docs, "hybrid").collect()}
    assert strings.keys() == {0} and strings[0][:4] == ["ĠKitob", "##lar", "##imiz", "##ga"] and strings[0][-1] == "!"
    records = [json.loads(r["record"]) for r in tokenizer.analyze_text(docs).orderBy("pos").collect()]
    assert records[0]["morph"]["root"] == "kitob" and records[0]["morph"]["status"] == "found" and [r["type"] for r in records] == ["word", "word", "punctuation"]
    ids = tokenizer.encode(docs)
    assert tokenizer.decode(ids).first()["text"].startswith("kitoblarimizga")
    assert tokenizer.stats(docs).first()["total_tokens"] == 2


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_saved_and_loaded(spark, tokenizer, tmp_path, scheme):
    """Files and folders by path and by URI; a tokenizer with byte pairs comes back with them."""
    folder = f"{scheme}{tmp_path}/tok"
    made = Tokenizer(spark, STEMS).train_bpe(texts(spark, "salom salom dunyo dunyo kitob kitob"), 60)
    made.save(folder)
    again = Tokenizer.load(spark, folder)
    assert again.has_bpe and again.model.merges == made.model.merges and again.dictionary_size == len(STEMS)
    word = again.tokenize(texts(spark, "salomdunyo")).first()
    assert word["is_bpe"] and "".join(word["subtokens"]) == "salomdunyo"
    assert {r["token"]: r["id"] for r in models.load_vocab(spark, f"{folder}/vocab.json").collect()} == {r["token"]: r["id"] for r in again.vocabulary().collect()}
    assert Model.load(f"{folder}/bpe_model.json").vocab == made.model.vocab
    assert file_exists(f"{folder}/dictionary.txt") and not file_exists(f"{folder}/none")


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_dictionaries(spark, tmp_path, scheme):
    write_text(f"{scheme}{tmp_path}/a/stems.txt", ["# stems\n", "olma\n", "\n", "anor\n"])
    write_text(f"{scheme}{tmp_path}/b.dic", ["2\n", "nok/AB\n", "uzum\n"])
    assert read_text(f"{scheme}{tmp_path}/b.dic").splitlines()[0] == "2"

    def stems(t):
        return {r["stem"] for r in t.stems.collect()}

    assert stems(Tokenizer(spark).load_dictionary("file", f"{scheme}{tmp_path}/a/stems.txt", ["gilos"])) == {"olma", "anor", "gilos"}
    assert stems(create_tokenizer(spark, ["olma"], f"{scheme}{tmp_path}/b.dic")) == {"olma", "nok", "uzum"}
    assert stems(create_tokenizer(spark, ["olma"], f"{scheme}{tmp_path}/none.dic")) == {"olma"}
    with pytest.raises(FileNotFoundError):
        Tokenizer(spark).load_dictionary("file", f"{scheme}{tmp_path}/none.txt")
    with pytest.raises(ConnectionError):
        Tokenizer(spark).load_dictionary("hunspell", f"{scheme}{tmp_path}/none.dic")
    with pytest.raises(ValueError):
        Tokenizer(spark).load_dictionary("web", "x")
    with pytest.raises(ValueError):
        Tokenizer(spark).load_dictionary("file")
