"""Problem 2: text that looks the same in different characters.

Two forms are derived from a value, each vectorised over a batch's distinct values:

* its *ordinary spelling*: composed letters, compatibility normalisation (NFKC) of characters that
  stand for letters or differ in width, one alphabet in a word, the two official apostrophes, no
  invisible characters, plain blanks. A value that differs from its ordinary spelling is a case.
  Lone signs, which NFKC would change too, are ordinary, and so are capitals.
* its *comparison form*: the ordinary spelling in compatibility-normalised composed form (NFKC),
  fully case-folded, with runs of blanks collapsed. Equal for everything that looks the same.

Both are maps: no shuffle of texts. Only :func:`spelling_variants` groups, by the form.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qatlam.llm.encoding import SURE, SWAP, Detector, pair_scores, rows_of, suspects
from qatlam.session import materialise

# ------------------------------------------------------------------ fixed values
#: Characters used for an apostrophe. The first two are the official ones.
APOSTROPHES = "ʻʼ’‘`ʹ′ʿ'´ʾ‛‚‵＇ˊˋˈʽ\u0092՚ꞌ"
#: Default-ignorable code points and other characters that show nothing, as ranges.
IGNORABLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E),
    (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
#: Blanks other than space, tab and newline.
BLANKS = "                 　\u0085\r\v\f"
#: Alphabets whose letters can stand for one another, as ranges of letters.
ALPHABETS = {
    "latin": "A-Za-zªºÀ-ÖØ-öø-ʯḀ-ỿⱠ-Ɀ꜠-ꟿꬰ-ꭤKÅ",
    "cyrillic": "Ѐ-ҁҊ-ԯᲀ-᲏Ꙁ-ꚝ",
    "greek": "Ͱ-ͳͶͷͻ-ͽͿΆΈ-Ͽἀ-῿",
    "armenian": "Ա-Ֆՠ-ֈ",
    "georgian": "Ⴀ-ჿᲐ-Ჿ",
}
#: Letters that look like a Latin letter, by alphabet: each pair is the letter and its Latin look.
LIKE_LATIN = {
    "cyrillic": "аa еe ѕs іi їï јj кk оo рp сc уy хx һh ӏl ԛq ԝw "
    "АA ВB ЕE ЅS ІI ЇÏ ЈJ КK МM НH ОO РP СC ТT УY ХX ҺH ӀI ԚQ ԜW ҮY ӒÄ ЁË ӦÖ ёë ӧö ӓä ӑă ѐè",
    "greek": "αa γy ιi κk νv οo ρp υu χx ωw ϲc ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ",
    "armenian": "գq զq հh ոn սu օo ցg յj ՍU ՕO ՏS ԼL ՀH",
}


def _ranges(pairs: tuple[tuple[int, int], ...]) -> str:
    return "".join(f"{chr(a)}-{chr(b)}" if a != b else chr(a) for a, b in pairs)


_IGNORABLE = re.compile(f"[{_ranges(IGNORABLE)}]+")
_BLANK = re.compile(f"[{re.escape(BLANKS)}]")


def _stands_for_letters(c: str) -> bool:
    """Whether a letter or digit is another one, or several, in a form of their own: bold, cursive, joined, contextual.

    Letters that merely decompose, as the Armenian and Thai ones do, are their own, and so are lone signs.
    """
    tag, _, _ = unicodedata.decomposition(c).partition(" ")
    if tag in ("<font>", "<initial>", "<medial>", "<final>", "<isolated>"):
        return unicodedata.category(c)[0] in "LN"
    return tag == "<compat>" and c.isalpha() and unicodedata.name(c, "").startswith("LATIN")


_FORMS = [c for c in map(chr, range(0x110000)) if unicodedata.decomposition(c)[:1] == "<" and _stands_for_letters(c)]
_WIDTH = re.compile("[！-｠｡-ￜ￠-￮" + "".join(_FORMS) + "]")
_JOINED = re.compile("(?<=[←-⯿〰〽㊗㊙️\U0001f000-\U0001faff])(?:‍(?=[←-⯿\U0001f000-\U0001faff])|[︎️])|(?<=[#*0-9])️(?=⃣)")
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*(?:[" + re.escape(APOSTROPHES) + r"](?:[^\W\d_]|[̀-ͯ])+)*")
_APOSTROPHE = re.compile(f"(?<=[^\\W\\d_])(?<![{APOSTROPHES[:2]}])[{re.escape(APOSTROPHES)}](?=[^\\W\\d_])|(?<=[oOgG])[{re.escape(APOSTROPHES)}](?![^\\W\\d_])|(?<=[^\\W\\d_])(?<![{APOSTROPHES[:2]}])[{APOSTROPHES[:2]}]")
_OF = {name: re.compile(f"[{chars}]") for name, chars in ALPHABETS.items()}
_TO_LATIN = {pair[0]: (name, pair[1]) for name, pairs in LIKE_LATIN.items() for pair in pairs.split() if len(pair) == 2}
_FROM_LATIN: dict[str, dict[str, str]] = {name: {} for name in LIKE_LATIN}
for _c, (_name, _latin) in _TO_LATIN.items():
    _FROM_LATIN[_name].setdefault(_latin, _c)


def _alphabet_of(c: str) -> str | None:
    for name, letters in _OF.items():
        if letters.match(c):
            return name
    return None


def _as(c: str, own: str, target: str) -> str | None:
    """The letter of ``target`` that looks like ``c``, a letter of ``own``."""
    latin = c if own == "latin" else _TO_LATIN.get(c, ("", None))[1]
    if latin is None:
        return None
    return latin if target == "latin" else _FROM_LATIN.get(target, {}).get(latin)


def _one_alphabet(word: str) -> str:
    """The word in the one alphabet that can take in most of its letters; what has no look-alike there stays."""
    found = [(c, _alphabet_of(c)) for c in word]
    present = {a for _, a in found if a}
    if len(present) < 2:
        return word

    def strangers(target: str) -> tuple[int, int]:
        left = sum(1 for c, a in found if a and a != target and _as(c, a, target) is None)
        return left, -sum(1 for _, a in found if a == target)

    target = min(sorted(present, key=lambda a: list(ALPHABETS).index(a)), key=strangers)
    return "".join(c if a is None or a == target else (_as(c, a, target) or c) for c, a in found)


def mixes_alphabets(word: str) -> bool:
    present = {a for c in word if (a := _alphabet_of(c))}
    return len(present) > 1


def ordinary_spelling(text: str) -> str:
    """``text`` in ordinary spelling. Idempotent; leaves case, line breaks, lone signs and emoji alone."""
    if text.isascii() and not ("'" in text or "`" in text or "\r" in text or "\v" in text or "\f" in text):
        return text
    if _IGNORABLE.search(text):
        kept = {m.start() for m in _JOINED.finditer(text)}
        text = "".join(c for i, c in enumerate(text) if i in kept or not _IGNORABLE.match(c))
    text = _BLANK.sub(" ", text)
    text = _WIDTH.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    text = unicodedata.normalize("NFC", text)
    if not text.isascii():
        text = _WORD.sub(lambda m: _one_alphabet(m.group()) if not m.group().isascii() else m.group(), text)
    return _APOSTROPHE.sub(lambda m: "ʻ" if text[m.start() - 1] in "oOgG" else "ʼ", text)


def comparison_form(text: str) -> str:
    """The form that all spellings of the same visible text share."""
    form = unicodedata.normalize("NFKC", ordinary_spelling(text))
    form = unicodedata.normalize("NFKC", form.casefold())
    return re.sub(r"\s+", " ", form)


def is_case(text: str) -> bool:
    """Whether ``text`` is not in ordinary spelling."""
    if ordinary_spelling(text) != text:
        return True
    return not text.isascii() and any(mixes_alphabets(m.group()) for m in _WORD.finditer(text))


#: Values with none of this are in ordinary spelling for sure.
SUSPECT = "[^\\x09\\x0a\\x20-\\x7e\\u02bb\\u02bc]|['`]|(?<![oOgG])\\u02bb|(?<![a-zA-Z\\u02bb])\\u02bc|[oOgG]\\u02bc"


def normalise(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``ordinary`` and ``form`` of a text column; columns of these names are replaced. Null stays null."""
    rows = df.drop("ordinary", "form")

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes, values = pd.factorize(batch[text_col], use_na_sentinel=True)
            ordinary = np.array([*(ordinary_spelling(v) for v in values), None], dtype=object)
            form = np.array([*(comparison_form(v) for v in values), None], dtype=object)
            yield batch.assign(ordinary=ordinary[codes], form=form[codes])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", ordinary string, form string"
    return rows.mapInPandas(forms, schema)


def spelling_variants(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(form, spellings, records): how many spellings and records share each comparison form.

    Spellings are counted before the texts meet, so a hot form is one row per spelling and task.
    Null texts have no form and are left out; an empty text is a form of its own.
    """
    by_text = df.where(F.col(text_col).isNotNull()).groupBy(F.col(text_col).alias("text")).agg(F.count(F.lit(1)).alias("n"))
    return normalise(by_text).groupBy("form").agg(F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("records"))


def find_unusual(records: DataFrame) -> DataFrame:
    """(tbl, row_id, text, ordinary) of the records that aren't in ordinary spelling, once per id.

    Text that was decoded with a wrong encoding is no matter of spelling and is left out.
    """
    records = records.where("row_id is not null").select("tbl", "row_id", "text")
    texts = records.select("text")
    held = records.sparkSession.sparkContext.broadcast(pair_scores(texts))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = Detector(held.value)
        for batch in batches:
            flags = np.fromiter((is_case(v) and detector.judge(v).kind not in (SURE, SWAP) for v in batch["text"]), dtype=bool, count=len(batch))
            found = batch[flags]
            yield found.assign(ordinary=pd.Series([ordinary_spelling(v) for v in found["text"]], index=found.index, dtype=object))

    judged = materialise(suspects(records, SUSPECT).mapInPandas(judge, "text string, ordinary string"), "unusual-values")
    return rows_of(records, SUSPECT, judged).select("tbl", "row_id", "text", "ordinary")
