import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qatlam.functions import charsets as C
from qatlam.functions import text as T
from qatlam.functions.udfs import nfc, nfkc, unescape_html


def over(spark, f, *texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(f("t")).collect()]


def test_apostrophes(spark):
    marks = "ʻʼ’‘`'´"
    assert over(spark, T.normalize_apostrophes, *(f"o{a}zbek" for a in marks)) == ["oʻzbek"] * 7
    assert over(spark, T.normalize_apostrophes, *(f"g{a}alaba" for a in marks)) == ["gʻalaba"] * 7
    assert over(spark, T.normalize_apostrophes, "ma'no", "a'b'c", "'x", "x'", "", None) == ["maʼno", "aʼbʼc", "'x", "x'", "", None]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="aog'bʻʼ’‘` x", max_size=12), min_size=1, max_size=20))
def test_apostrophes_come_back(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normalize_apostrophes("t").alias("n"), T.apostrophe_offsets("t").alias("o"))
    for t, n, back in df.select("t", "n", T.restore_apostrophes("n", "o")).collect():
        assert back == t and len(n) == len(t)


def test_offsets_beyond_the_end_are_ignored(spark):
    df = spark.sql("select 'ab' n, array(named_struct('offset', 9, 'ch', 'x'), named_struct('offset', 1, 'ch', 'y')) o")
    assert df.select(T.restore_apostrophes("n", "o")).first()[0] == "ay"


TRANSLIT = {
    "Ер": "Yer", "ЕР": "YER", "Бу ер": "Bu yer", "керак": "kerak", "поезд": "poyezd", "бояемиш": "boyayemish", "съезд": "sʼyezd", "пьеса": "pyesa", "Ўзбекистон": "Oʻzbekiston", "ҒАЛАБА": "GʻALABA",
    "Шаҳар": "Shahar", "ШАҲАР": "SHAHAR", "КУЧ": "KUCH", "Куч": "Kuch", "ЦЕХ": "TSEX", "Ёшлик": "Yoshlik", "маъно": "maʼno", "компьютер": "kompyuter", "salom": "salom", "": "",
}


def test_transliteration(spark):
    assert over(spark, T.cyrillic_to_latin, *TRANSLIT, None) == [*TRANSLIT.values(), None]


CLEAN = {
    "<p>Salom <b>dunyo</b>! &amp; hush kelibsiz!<br/></p>": "Salom dunyo! & hush kelibsiz!",
    "Batafsil https://kun.uz/news/123 yoki www.gov.uz orqali o'qing.": "Batafsil yoki orqali o'qing.",
    "Murojaat uchun: support@idora.uz yoki admin-help@corp.org yozing.": "Murojaat uchun: yoki yozing.",
    "Zo'r yangilik!!!!! Rostdanmi???? Voy-dod..... Qoyil ***": "Zo'r yangilik! Rostdanmi? Voy-dod... Qoyil",
    "Bu qanday bo'ldi!?!?!? Tushunmadim...": "Bu qanday bo'ldi?! Tushunmadim...",
    "<h1>O'zbekiston</h1> <a href='https://daryo.uz'>ko'ring</a>: g'alaba va e'lon!": "O'zbekiston ko'ring: g'alaba va e'lon!",
    "": "",
}


def test_cleaning(spark):
    df = unescape_html(spark.createDataFrame(list(CLEAN.items()), "t string, e string"), "t")
    assert all(r[0] == r[1] for r in df.select(T.clean_text("t"), "e").collect())
    assert over(spark, T.clean_text, None) == [None]


def test_scripts(spark):
    assert over(spark, T.detect_script, "Ўзбекистон Республикаси", "O'zbekiston Республикаси", "O'zbekiston Respublikasi", "123 456", "", None) == ["cyrillic", "mixed", "latin", "other", "empty", "empty"]
    assert over(spark, T.has_cyrillic, "ж", "x", None) == [True, False, False]


def test_words(spark):
    good = ["kitob", "o'quvchi", "o‘quvchi", "achchiq", "a'lo", "o'", "g'", "ch", "G'AFUR"]
    bad = ["", "'", "123", "kitob1", "китоб", "web", "cat", "action", "'salom", "kitob'", "salom''dunyo", "salom dunyo", "salom!", "kitob-daftar", None]
    assert over(spark, T.is_uzbek_word, *good, *bad) == [True] * len(good) + [False] * len(bad)
    assert over(spark, lambda t: T.is_uzbek_word(t, strict=False), "web", "cat", "123", "китоб", "'salom") == [True, True, False, False, False]


def test_spelling(spark):
    assert over(spark, T.fold_spelling, "O ' zbek", "  Bir​  ikki ", "", None) == ["oʻzbek", "bir ikki", "", None]


def test_unicode_forms(spark):
    df = spark.createDataFrame([("ﬁ",), ("abc",), (None,), ("",)], "t string")
    assert sorted(str(r[0]) for r in nfkc(df, "t").collect()) == ["", "None", "abc", "fi"]
    assert nfc(spark.createDataFrame([("é",)], "t string"), "t").first()[0] == "é"


def test_splitting(spark):
    assert over(spark, T.raw_tokens, "3.14 o'zbek_x!", "", None) == [["3", ".", "14", " ", "o'zbek_x", "!"], [], None]
    assert over(spark, lambda t: T.token_type(t), "a", "'", " ", "?!", "7") == ["word", "word", "whitespace", "punctuation", "word"]
    got = over(spark, T.pre_tokens, "'maktab' va 'bog''", "100% kelishdi, 2026-yil.", "a_b")
    assert [[x.replace("ʻ", "'") for x in g] for g in got] == [["'", "maktab", "'", "va", "'", "bog'", "'"], ["100", "%", "kelishdi", ",", "2026", "-", "yil", "."], ["a", "b"]]


@pytest.mark.parametrize("word", ["Salom", "SALOM", "salom", "sAlom", "Oʻzbek", "JavaScript", "A", "1a", "ab Cd", "Ab Cd", ""])
def test_case_predicates(spark, word):
    got = spark.createDataFrame([(word,)], "t string").select(T.is_title("t"), T.is_upper("t"), T.capitalize("t")).first()
    assert tuple(got) == (word.istitle(), word.isupper(), word.capitalize())


def test_fixed_tables_are_whole():
    assert len(C.APOSTROPHES) == len(set(C.APOSTROPHES)) == 20
    assert len(C.SINGLE_FROM) == len(C.SINGLE_TO) + 2
    assert F is not None
