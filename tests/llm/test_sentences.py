import pytest
from hypothesis import given
from hypothesis import strategies as st

from qatlam.llm.sentences import sentence_spans, split_sentences

# texts as the sentences they are made of, joined by what stands between them
TEXTS = [
    ("Bir. Ikki! Uch?", ["Bir.", "Ikki!", "Uch?"]),
    ("Bu prof. Karimov aytdi. Keyin A. S. Olimov ketdi.", ["Bu prof. Karimov aytdi.", "Keyin A. S. Olimov ketdi."]),
    ("Narxi 3.14 mln. soʻm. Sana 26.01.2009-y. edi.", ["Narxi 3.14 mln. soʻm.", "Sana 26.01.2009-y. edi."]),
    ("Olma, nok va h.k. Keyin ketdi.", ["Olma, nok va h.k.", "Keyin ketdi."]),
    ("Sarlavha\n\nMatn shu\nyerda.\n \nYana.", ["Sarlavha", "Matn shu\nyerda.", "Yana."]),
    ("«Kim bor?» — dedi Olim. Jim.", ["«Kim bor?» — dedi Olim.", "Jim."]),
    ("“Kel!” deb soʻradi u. “Ketdim.” Tamom.", ["“Kel!” deb soʻradi u.", "“Ketdim.”", "Tamom."]),
    ("Bu (kim bor?) yaxshi kun. (Butun gap shu.) Yana.", ["Bu (kim bor?) yaxshi kun.", "(Butun gap shu.)", "Yana."]),
    ("Bilmadim... keyin aytaman. Xoʻp… Ketdik.", ["Bilmadim... keyin aytaman.", "Xoʻp…", "Ketdik."]),
    ("1. Birinchi gap.\n\n2) Ikkinchi gap.", ["1. Birinchi gap.", "2) Ikkinchi gap."]),
    ("Ketgan.Keyin M.S.Karim keldi.2009-yil edi.", ["Ketgan.", "Keyin M.S.Karim keldi.2009-yil edi."]),
    ("Koʻring matn5.test va xat@uy.uz manzil. Boʻldi.", ["Koʻring matn5.test va xat@uy.uz manzil.", "Boʻldi."]),
    ("他说：“你好。”今天好！是吗？对……吧。", ["他说：“你好。”", "今天好！", "是吗？", "对……吧。"]),
    ("यह है। वह था? हाँ।", ["यह है।", "वह था?", "हाँ।"]),
    ("သူလာ။ငါသွား။", ["သူလာ။", "ငါသွား။"]),
    ("այս է։ այն է։", ["այս է։", "այն է։"]),
    ("هذا هو. من هذا؟ نعم!", ["هذا هو.", "من هذا؟", "نعم!"]),
    ("Он сказал: см. Иванов и т.д. Потом ушёл. В г. Москва.", ["Он сказал: см. Иванов и т.д.", "Потом ушёл.", "В г. Москва."]),
    ("Yaxshi?! 1249-kun edi. Ha!!!  Yoʻq.", ["Yaxshi?!", "1249-kun edi.", "Ha!!!", "Yoʻq."]),
    ("a\r\n\r\nb", ["a", "b"]),
]


@pytest.mark.parametrize(("text", "sentences"), TEXTS)
def test_texts(text, sentences):
    assert [text[a:b] for a, b in sentence_spans(text)] == sentences


@given(st.text(alphabet="aB.?! \n\"«»()…。-1'’\t\r", max_size=60))
def test_everything_is_in_a_sentence(text):
    spans = sentence_spans(text)
    assert all(a < b and text[a:b] == text[a:b].strip() for a, b in spans)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    covered = "".join(text[a:b] for a, b in spans)
    assert "".join(covered.split()) == "".join(text.split())


def test_table(spark):
    long = "Bu gap juda uzun boʻldi. " * 20_000
    df = spark.createDataFrame([(1, "Bir. Ikki.", 7), (2, None, 7), (3, "", 7), (4, " \n ", 7), (None, "x", 7), (5, long, 7)], "doc_id long, text string, start_char int")
    rows = split_sentences(df).collect()
    assert {(r["start_char"], r["end_char"]) for r in rows if r["doc_id"] == 1} == {(0, 4), (5, 10)}
    assert {r["doc_id"] for r in rows} == {1, 5} and sum(r["doc_id"] == 5 for r in rows) == 20_000
    assert split_sentences(df.limit(0)).count() == 0


def test_brackets_that_never_close():
    def parts(text):
        return [text[a:b] for a, b in sentence_spans(text)]

    assert parts("Yomon kun :( edi. Keyin ketdim. Tamom.") == ["Yomon kun :( edi.", "Keyin ketdim.", "Tamom."]
    assert parts("Bu (kim bor edi. Keyin (ha. rost) ketdim. Tamom.") == ["Bu (kim bor edi.", "Keyin (ha. rost) ketdim.", "Tamom."]
    assert parts("Bu (kim bor? ha. rost) yaxshi. Tamom.") == ["Bu (kim bor? ha. rost) yaxshi.", "Tamom."]


def pieces(text, lang=None):
    return [text[s:e] for s, e in sentence_spans(text, lang)]


def test_every_terminator_of_the_property_ends_a_sentence():
    for c in "܀܁܂؝؞؟߹࠷᪨᪩᭚᭛᰻᰼᱾᱿꘎꘏꛳꛷꡶꡷꣎꣏꤯꧈꧉꫰꫱꯫﹖﹗\U00011047⹓⹔。۔।။։።។":
        assert pieces(f"ab{c} cd{c}") == [f"ab{c}", f"cd{c}"], hex(ord(c))
    assert pieces("Soʻz bor﹒ Yana bor.") == ["Soʻz bor﹒", "Yana bor."]
    assert pieces("စာ၊ စာ။ စာ။") == ["စာ၊ စာ။", "စာ။"]


@pytest.mark.parametrize(
    ("text", "lang", "count"),
    [
        ("Masofa 5 km. Biz yurdik.", "uz", 2), ("He works in the dept. Then he left.", "en", 2), ("The answer is No. We left.", "en", 2),
        ("It is in No. Smith and co.", "EN", 1), ("Bu prof. Karimov edi. Biz bordik.", "uz", 2), ("Bu prof. Karimov edi. Biz bordik.", "en", 2),
        ("The prof. Smith came. We left.", None, 2), ("Он живёт на ул. Ленина и не пишет. Это всё.", "ru", 2), ("Bu ev ve av. Sonra gitti.", "tr", 1), ("Uy va av. Keyin ketdi.", "uz", 2),
    ],
)
def test_abbreviations_are_those_of_the_language(text, lang, count):
    assert len(pieces(text, lang)) == count


@pytest.mark.parametrize("unit", ["Soʻz bordi. ", "a b (c. d) ", "a. b ", "(a ", "\"a. ", "1. ", "... "])
def test_time_grows_with_the_text(unit):
    import time

    def taken(n):
        best = 9e9
        for _ in range(2):
            began = time.process_time()
            sentence_spans(unit * n)
            best = min(best, time.process_time() - began)
        return best

    n = 60_000 // len(unit)
    assert taken(8 * n) < 8 * 2.5 * taken(n) + 0.2


def test_language_column(spark):
    df = spark.createDataFrame([(1, "Uy va av. Keyin ketdi.", None), (2, "Bu ev ve av. Sonra gitti.", "tr"), (3, None, "tr")], "doc_id long, text string, lang string")
    assert {(r["doc_id"], r["start_char"], r["end_char"]) for r in split_sentences(df, lang_col="lang").collect()} == {(1, 0, 9), (1, 10, 22), (2, 0, 25)}
