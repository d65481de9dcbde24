import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from qatlam.llm import visual as V

CASES = {
    "o'zbek": "oʻzbek", "o‘zbek": "oʻzbek", "oʼzbek": "oʻzbek", "maʻno": "maʼno", "ma`no": "maʼno", "bog'": "bogʻ", "G’alaba": "Gʻalaba", "ｋｉｔｏｂ": "kitob", "１９９６": "1996",
    "kіtob": "kitob", "kitоb": "kitob", "сиктaқ": "сиктақ", "ki­tob": "kitob", "ki​tob": "kitob", "ki⁠tob": "kitob", "﻿kitob": "kitob", "1 016": "1 016",
    "　": " ", "é": "é", "й": "й", "ϲop": "cop", "，": ",", "a\r\nb": "a \nb", "οna": "ona", "օna": "ona",
}
ORDINARY = ["kitob", "oʻzbek", "maʼno", "китоб", "ёғ", "tätil", "请东争", "№", "°", "👩‍💻", "❤️", "'", "\"", "'so'".replace("'", ""), "a\tb\nc", "", "αβγ", "3.14", "bogʻ", "COVID-19", "—", "уеоа"]


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert V.is_case(text) and V.ordinary_spelling(text) == CASES[text]


@pytest.mark.parametrize("text", ORDINARY)
def test_ordinary(text):
    assert not V.is_case(text) and V.ordinary_spelling(text) == text


@pytest.mark.parametrize(("text", "plain"), [("ﬁne", "fine"), ("𝐤itob", "kitob"), ("𝓶𝓪𝓴𝓽𝓪𝓫", "maktab"), ("ǆep", "džep"), ("ﻛﺘﺎﺏ", "كتاب"), ("𝟏𝟐", "12")])
def test_compatibility_letters(text, plain):
    assert V.is_case(text) and V.ordinary_spelling(text) == plain


@pytest.mark.parametrize("text", ["և", "น้ำ", "™", "m²", "½", "①", "…", "ㅋㅋ", "ª", "℃"])
def test_letters_and_signs_of_their_own(text):
    assert not V.is_case(text)


def test_mixed_without_look_alikes_is_a_case():
    assert V.is_case("kitжob")


def test_one_form():
    forms = {V.comparison_form(t) for t in ("Kitob", "ＫＩＴＯＢ", "kitоb", "ki​tob", "KITOB")}
    assert forms == {"kitob"}
    assert V.comparison_form("ﬁn") == "fin" and V.comparison_form("Straße") == "strasse" and V.comparison_form("a \n b") == "a b"


@given(st.text(max_size=20))
def test_idempotent(text):
    once = V.ordinary_spelling(text)
    assert V.ordinary_spelling(once) == once
    form = V.comparison_form(text)
    assert V.comparison_form(form) == form or unicodedata.normalize("NFKC", V.comparison_form(form)) == V.comparison_form(form)


@given(st.text(alphabet="abogʻʼ'`кітaо­​  1ａé", max_size=10))
def test_filter_lets_no_case_pass(text):
    import re

    assert re.search(V.SUSPECT, text) or not V.is_case(text)


def test_variants_and_columns(spark):
    df = spark.createDataFrame([(1, "Kitob", "x"), (2, "kitоb", "y"), (3, "kitob", "z"), (4, None, "w"), (5, "", "v")], "id long, text string, form string")
    got = {r["form"]: (r["spellings"], r["records"]) for r in V.spelling_variants(df).collect()}
    assert got == {"kitob": (3, 3), "": (1, 1)}
    rows = {r["id"]: (r["ordinary"], r["form"]) for r in V.normalise(df).collect()}
    assert rows[2] == ("kitob", "kitob") and rows[4] == (None, None) and rows[5] == ("", "")


def test_found(spark):
    words = ["kitob", "maktab", "oʻzbek", "китоб"] * 300
    rows = [("tokens", i, w) for i, w in enumerate(words)] + [("tokens", 9001, "kitоb"), ("tokens", 9001, "kitоb"), ("analyses", 9001, "o'zbek"), ("tokens", 9002, "oÊ»zbek"), ("tokens", 9003, None), ("tokens", None, "kitоb")]
    got = {(r["tbl"], r["row_id"]) for r in V.find_unusual(spark.createDataFrame(rows, "tbl string, row_id long, text string")).collect()}
    assert got == {("tokens", 9001), ("analyses", 9001)}
    assert V.find_unusual(spark.createDataFrame([], "tbl string, row_id long, text string")).count() == 0
