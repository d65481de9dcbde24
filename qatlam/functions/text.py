"""Text normalisation as column expressions: all built-in functions, so they stay in generated code.

Every function maps null to null unless it says otherwise, and takes a column or its name.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from qatlam.functions import charsets as C

ColumnOrName = Column | str
_S, _WS = C.SPACE, C.WIDE_SPACE


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ------------------------------------------------------------------ apostrophes
def unify_apostrophes(text: ColumnOrName) -> Column:
    """Every apostrophe variant as the ASCII one; lengths don't change."""
    return F.translate(_col(text), C.APOSTROPHES, "'" * len(C.APOSTROPHES))


def normalize_apostrophes(text: ColumnOrName) -> Column:
    """ʻ after o and g, ʼ after other ASCII letters before one; others become ASCII. Lengths don't change."""
    plain = unify_apostrophes(text)
    turned = F.regexp_replace(plain, "([oOgG])'", "$1ʻ")
    return F.regexp_replace(turned, "([a-zA-Z])'(?=[a-zA-Z])", "$1ʼ")


def characters(text: ColumnOrName) -> Column:
    """The code points of a text as an array; empty for an empty text."""
    t = _col(text)
    return F.when(F.length(t) > 0, F.split(t, "")).when(t.isNotNull(), F.array().cast("array<string>"))


def apostrophe_offsets(text: ColumnOrName) -> Column:
    """Where each apostrophe of any kind stood and which it was: array<struct<offset int, ch string>>."""
    marked = F.transform(characters(text), lambda c, i: F.struct(i.alias("offset"), c.alias("ch")))
    return F.filter(marked, lambda x: F.instr(F.lit(C.APOSTROPHES), x["ch"]) > 0)


def restore_apostrophes(normalized: ColumnOrName, offsets: ColumnOrName) -> Column:
    """The text with the characters of ``offsets`` put back; offsets beyond the end are ignored."""
    put = F.map_from_entries(F.transform(_col(offsets), lambda x: F.struct(x["offset"], x["ch"])))
    return F.array_join(F.transform(characters(normalized), lambda c, i: F.coalesce(F.try_element_at(put, i), c)), "")


# ------------------------------------------------------------------ spelling
def collapse_space(text: ColumnOrName) -> Column:
    """Runs of white space and invisible characters as one space, none at the ends."""
    return F.trim(F.regexp_replace(_col(text), f"[{_WS}]+", " "))


def fold_spelling(text: ColumnOrName) -> Column:
    """The dictionary spelling of a text that is in NFKC already: apostrophes, small letters, joined strays, single spaces."""
    small = F.lower(normalize_apostrophes(text))
    joined = F.regexp_replace(small, f"([og])[{_S}]+['ʻʼ][{_S}]*", "$1ʻ")
    return collapse_space(joined)


#: Texts outside of this may change under NFC or NFKC.
STABLE_UNDER_NFKC = r"^[\x00-\x7f\x{bb}\x{ab}\x{2bb}\x{2bc}\x{2010}\x{2012}-\x{2016}\x{2018}-\x{201f}\x{2190}\x{400}-\x{52f}]*$"


# ------------------------------------------------------------------ transliteration
_CAPITAL = f"A-Z{C.CYRILLIC_CAPITALS}"
_AMONG, _IOTATED = "", ""  # marks put behind letters while their neighbours are still Cyrillic


def cyrillic_to_latin(text: ColumnOrName) -> Column:
    """Cyrillic letters in the Latin spelling; the text should be in NFC. Others pass.

    What depends on neighbours is marked first, while they are still as written: capitals among
    capitals, and a letter е at the start of a word or after a vowel or sign.
    """
    t = _col(text)
    wide = "ЁЦЧШЩЮЯЕ"
    out = F.regexp_replace(t, f"([{wide}])(?=[{_CAPITAL}])|(?<=[{_CAPITAL}])([{wide}])(?!\\p{{IsLowercase}})", f"$1$2{_AMONG}")
    after = f"[{C.CYRILLIC_VOWELS}{C.IOTATING_SIGNS}]"
    out = F.regexp_replace(out, f"(?<![\\p{{L}}{_AMONG}])([еЕ])|(?<={after}|{after}{_AMONG})([еЕ])", f"$1$2{_IOTATED}")
    for a, b in ((f"Е{_IOTATED}{_AMONG}", "YE"), (f"Е{_IOTATED}", "Ye"), (f"е{_IOTATED}", "ye"), (f"Е{_AMONG}", "E")):
        out = F.replace(out, F.lit(a), F.lit(b))
    for c, (low, title, capitals) in C.DIGRAPHS.items():
        for a, b in ((c.upper() + _AMONG, capitals), (c.upper(), title), (c, low)):
            out = F.replace(out, F.lit(a), F.lit(b))
    for a, b in C.COMMA_LETTERS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.translate(out, "еЕ" + C.SINGLE_FROM, "eE" + C.SINGLE_TO)
    return F.when(t.rlike("[\\u0400-\\u052f]"), out).otherwise(t)


# ------------------------------------------------------------------ cleaning
_URL = rf'(?i)(?:https?://|ftp://|www\.)[^{_S}<>"]+?(?=[.,!?;:]?(?:[{_S}]|\z))'
_EMAIL = r"(?U)\b[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+\b"


def clean_text(text: ColumnOrName) -> Column:
    """Running text without markup, addresses, ornaments and doubled marks; entities must be resolved already."""
    out = _col(text)
    for pattern, by in (
        ("<[^>]+>", " "), (_URL, " "), (_EMAIL, " "), ("[-=~*#^_]{2,}", " "), (r"\.{4,}", "..."), (r"(?<!\.)\.\.(?!\.)", "."),
        (r"(?:!\?|\?!)[!?]+", "?!"), ("([!?,;:—–])\\1+", "$1"), ("\"{2,}|'{2,}", "'"), (f"[{_S}]+([.,!?:;])", "$1"),
    ):
        out = F.regexp_replace(out, pattern, by)
    return collapse_space(out)


# ------------------------------------------------------------------ predicates
def has_cyrillic(text: ColumnOrName) -> Column:
    """Whether any character is Cyrillic; false for null."""
    return F.coalesce(_col(text).rlike("[\\u0400-\\u052f]"), F.lit(False))


def detect_script(text: ColumnOrName) -> Column:
    """``empty`` (also for null), ``cyrillic``, ``latin``, ``mixed`` or ``other``."""
    t = _col(text)
    cyrillic, latin = t.rlike("[\\u0400-\\u052f]"), t.rlike("[a-zA-Z]")
    return (
        F.when(t.isNull() | (t == ""), "empty").when(~cyrillic & ~latin, "other").when(cyrillic & ~latin, "cyrillic").when(latin & ~cyrillic, "latin").otherwise("mixed")
    )


def is_uzbek_word(word: ColumnOrName, strict: bool = True) -> Column:
    """Whether a string is one word of the Latin alphabet; ``strict`` knows no w and no c but in ch. False for null."""
    w = _col(word)
    ok = w.rlike("^[a-zA-Z][a-zA-Z'ʻʼ’‘]*\\z") & ~w.rlike("(^|[^oOgG])['ʻʼ’‘]\\z") & ~w.rlike("['ʻʼ’‘]{2}")
    if strict:
        ok = ok & ~w.rlike("[wW]|[cC](?![hH])")
    return F.coalesce(ok, F.lit(False))


def is_title(text: ColumnOrName) -> Column:
    """Whether capitals stand exactly where cased letters begin, and there is one."""
    t, cased = _col(text), r"\p{Lu}\p{Ll}\p{Lt}"
    return t.rlike(f"[{cased}]") & ~t.rlike(rf"(^|[^{cased}])\p{{Ll}}") & ~t.rlike(rf"[{cased}][\p{{Lu}}\p{{Lt}}]")


def is_upper(text: ColumnOrName) -> Column:
    t = _col(text)
    return t.rlike(r"\p{Lu}") & ~t.rlike(r"[\p{Ll}\p{Lt}]")


def capitalize(text: ColumnOrName) -> Column:
    t = _col(text)
    return F.concat(F.upper(F.substring(t, 1, 1)), F.lower(t.substr(F.lit(2), F.length(t))))


def restore_case(root: ColumnOrName, word: ColumnOrName) -> Column:
    """``root`` with a capital if ``word`` is in title case, in capitals if ``word`` is."""
    return F.when(is_title(word), capitalize(root)).when(is_upper(word), F.upper(_col(root))).otherwise(_col(root))


# ------------------------------------------------------------------ splitting
#: A raw token: a word (digits and underscores are word characters), a run of marks, a run of blanks.
RAW_TOKEN = f"[{C.WORD}'ʻʼ]+|[^{C.WORD}{_S}'ʻʼ]+|[{_S}]+"
#: A pre-token of the byte-pair encoder, and the same with blanks.
PRE_TOKEN = rf"[{C.LETTER}]+(?:'[{C.LETTER}]+)*(?:(?<=[oOgG])')?|\p{{Nd}}+|[^{_S}{C.WORD}]"
PRE_TOKEN_OR_SPACE = PRE_TOKEN + f"|[{_S}]+"


def raw_tokens(text: ColumnOrName) -> Column:
    """The raw tokens of a text in order, as strings."""
    return F.regexp_extract_all(_col(text), F.lit(RAW_TOKEN), F.lit(0))


def token_type(token: ColumnOrName) -> Column:
    """``word``, ``whitespace`` or ``punctuation``. Numbers are words: a digit is a word character."""
    t = _col(token)
    return F.when(t.rlike(f"^[{C.WORD}'ʻʼ]"), "word").when(t.rlike(f"^[{_S}]"), "whitespace").otherwise("punctuation")


def pre_tokens(text: ColumnOrName, with_space: bool = False) -> Column:
    """The pre-tokens of a text, apostrophes normalised. Underscores are dropped."""
    return F.regexp_extract_all(normalize_apostrophes(text), F.lit(PRE_TOKEN_OR_SPACE if with_space else PRE_TOKEN), F.lit(0))


# What plain byte-pair training cuts text into: runs of letters, marks and digits, single punctuation
# characters, and runs of other signs.
_ALNUM = r"\p{IsAlphabetic}\p{M}\p{Nd}\x{200c}\x{200d}"
_PUNCT = r"!-/:-@\[-`{-~\p{P}"
WORD_OR_MARK = f"[{_ALNUM}]+|[{_PUNCT}]|[^{_ALNUM}{_PUNCT}{_S}]+"


def words_and_marks(text: ColumnOrName) -> Column:
    """The words of a text and its punctuation marks one by one; nothing is normalised."""
    return F.regexp_extract_all(_col(text), F.lit(WORD_OR_MARK), F.lit(0))
