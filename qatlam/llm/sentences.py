"""Problem 8: sentence boundaries across languages and scripts.

Sentence breaking by Unicode's character property Sentence_Break (terminators of every script,
closing marks, spaces, look-ahead to the next letter's case), tailored for running text:

* a blank line always ends a sentence, a single line break never does;
* an abbreviation of the text's language, or an initial, before a full stop suppresses the break;
* a terminator inside a bracket that opened within the sentence doesn't end it;
* a quotation followed by a dash or a small letter continues into the words saying who spoke;
* a number that opens a list entry stays with its entry.

The work is one map over the texts: no shuffle, no state, whole texts.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _with(prop: str) -> set[str]:
    """The characters of a value of Unicode's Sentence_Break property."""
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    return set(regex.findall(rf"\p{{Sentence_Break={prop}}}", every))


# Sets from the property, with tailorings: a Burmese little section stands inside a sentence, and
# ellipses, which the property leaves out, are looked at like full stops.
_TAILORED = {"\u104a"}
HARD = "".join(sorted(_with("STerm") - _TAILORED))
SOFT = "".join(sorted(_with("ATerm"))) + "…"
#: Terminators of scripts without a difference of case, or (U+0589) never used inside a sentence.
ABSOLUTE = frozenset(HARD) - frozenset("!?‼‽⁇⁈⁉")
_CLOSE = _with("Close")
CLOSERS = frozenset(c for c in _CLOSE if unicodedata.category(c) in ("Pe", "Pf"))
OPENERS = "".join(sorted(c for c in _CLOSE if unicodedata.category(c) in ("Ps", "Pi")))
BRACKET_OPEN, BRACKET_CLOSE = "([{（［｛【〔〖", ")]}）］｝】〕〗"
DASHES = "—–―-"

# Abbreviations after which a capital doesn't begin a sentence, by language.
ABBREVIATIONS = {
    "uz": frozenset(
        "sh q tum vil taxm t.f.d f.f.d i.f.d f-m.f.n mas koʻch oʻrt dots prof akad yan masalan ch mln mlrd "
        "ш қ тум вил тахм т.ф.д ф.ф.д и.ф.д мас кўч ўрт дотс доц проф акад млн млрд".split()
    ),
    "ru": frozenset("им стр ул г гг т.к т.е см ср напр обл тыс руб гр тов пл пер рис табл гл проф акад доц млн млрд".split()),
    "kk": frozenset("т.б көш обл проф акад млн млрд".split()),
    "en": frozenset("mr mrs ms dr prof st fig figs vs cf i.e e.g approx jr sr gen col capt lt sgt rev hon dept vol viz".split()),
    "tr": frozenset("örn vb bkz doç yrd av sn sok cad mah dr prof".split()),
}
#: Abbreviations only when written just so.
EXACT_ABBREVIATIONS = {"uz": frozenset(["Oʻ", "Gʻ", "Yu", "Ya", "Yo"]), "ru": frozenset(), "kk": frozenset(), "en": frozenset(["No", "Nos"]), "tr": frozenset()}
# Frequent words by which a text's language is told, and which begin a sentence even
# after an abbreviation when they have a capital.
COMMON_WORDS = {
    "uz": frozenset("va bu bilan uchun ham esa lekin ammo deb bir biz ular ва бу билан учун ҳам эса лекин аммо деб бир биз улар".split()),
    "ru": frozenset("и не на что но в с как он она мы они это".split()),
    "kk": frozenset("және бұл мен да де бір біз олар".split()),
    "en": frozenset("the of and is in that it to he she we they this then there but".split()),
    "tr": frozenset("ve bir bu çok için dedi de biz onlar ama".split()),
}
_STARTERS = {k: frozenset(w.capitalize() for w in words if len(w) > 1) for k, words in COMMON_WORDS.items()}
_LETTERS = re.compile(r"[^\W\d_]+")

_BLANK_LINE = re.compile(r"(?:\r\n|[\n\r\x85 ])[^\S\n\r\x85  ]*(?:\r\n|[\n\r\x85 ])\s*| \s*")
_MARK = re.compile(f"[{re.escape(''.join(c for c in HARD + SOFT if c < chr(0x10000)))}]+")
#: The same with the terminators beyond the basic plane, which a pattern tries one by one: for texts that reach there only.
_ANY_MARK, _BEYOND = re.compile(f"[{re.escape(HARD + SOFT)}]+"), re.compile("[\U00010000-\U0010ffff]")
_WORD_BEFORE = re.compile(r"[^\W\d_][\w.ʻʼ'’‘`´-]{0,11}\Z")
_LIST_NUMBER = re.compile(r"[(\[]?\d{1,4}(?:[.)]\d{1,3}){0,3}\Z")
_SPACE = re.compile(r"\s*")
_LEAD = re.compile(r"[ \"«“—–\-\t\r\n ]*")
_NEXT = re.compile(rf"[\s{re.escape(OPENERS)}\"'*•·{re.escape(DASHES)}]*")


_LANGUAGES_OF: dict[str, frozenset[str]] = {}
for _name, _words in COMMON_WORDS.items():
    for _word in _words:
        _LANGUAGES_OF[_word] = _LANGUAGES_OF.get(_word, frozenset()) | {_name}
_ANY_ABBREVIATION = frozenset().union(*ABBREVIATIONS.values())
_ANY_EXACT = frozenset().union(*EXACT_ABBREVIATIONS.values())


class Language:
    """The languages of a text: those its frequent words show and the one its tag names; all, if there is no such word.

    A text may hold passages in several languages, and its tag may be wrong.
    """

    def __init__(self, text: str = "", tag: str | None = None):
        self.text, self.tag = text, tag
        self._known: frozenset[str] | None = None

    def names(self) -> frozenset[str]:
        """Found when the first candidate for an abbreviation comes, in one pass over the text."""
        if self._known is None:
            shown = frozenset().union(*map(_LANGUAGES_OF.get, _LANGUAGES_OF.keys() & set(_LETTERS.findall(self.text.lower()))))
            tag = (self.tag or "").lower()[:2]
            self._known = (shown | ({tag} & COMMON_WORDS.keys())) if shown else frozenset(COMMON_WORDS)
        return self._known

    def abbreviates(self, word: str, following: str) -> bool:
        """Whether ``word`` before a full stop is an abbreviation that ``following`` goes on after."""
        low = word.lower()
        if low not in _ANY_ABBREVIATION and word not in _ANY_EXACT:
            return False
        return any(following not in _STARTERS[n] for n in self.names() if low in ABBREVIATIONS[n] or word in EXACT_ABBREVIATIONS[n])


def _is_abbreviation(before: str, para: str, next_at: int, language: Language) -> bool:
    """Whether the text before a full stop ends in an abbreviation or an initial."""
    m = _WORD_BEFORE.search(before)
    if m is None:
        return False
    word = m.group()
    if (at := m.start()) and (before[at - 1].isalnum() or before[at - 1] in "@_"):
        return False
    if len(word) == 1:
        return word.isupper() or language.abbreviates(word, _word_at(para, next_at))
    tail = word.rpartition(".")[2]
    if len(tail) == 1 and tail.isupper():  # S.I, and the second of two initials
        return True
    return language.abbreviates(word, _word_at(para, next_at))


def _word_at(para: str, at: int) -> str:
    m = _LETTERS.match(para, at)
    return m.group() if m else ""


def _ends_here(para: str, start: int, mark: re.Match, close_end: int, closed: str, next_at: int, gap: int, dash: bool, language: Language) -> bool:
    """Whether the mark of a paragraph ends the sentence that began at ``start``; something follows it."""
    marks = mark.group()
    nxt = para[next_at : next_at + 1]
    hard = any(c not in SOFT for c in marks)
    if hard:
        if any(c in ABSOLUTE for c in marks):
            return not (closed and dash)
        if not gap and nxt and not closed and (nxt.islower() or nxt.isdigit() or nxt in "=&/"):
            return False  # inside an address
        if closed:
            return not (dash or (nxt.islower() and not "԰" <= nxt <= "֏"))
        return True
    if len(marks) == 1 and marks != "…":  # one full stop
        prev = para[mark.start() - 1 : mark.start()]
        if not gap and not closed:
            if not nxt.isupper() or not (prev.islower() or prev.isdigit() or prev in "ʻʼ’'"):
                return False
        if not closed:
            if not nxt.islower() and _is_abbreviation(para[max(start, mark.start() - 14) : mark.start()], para, next_at, language):
                return False
            if mark.start() - start < 24 and _LIST_NUMBER.fullmatch(para[start : mark.start()].strip()):
                return False
        return not (dash and closed) and not nxt.islower()
    if "……" in marks:  # the double ellipsis of East Asian text stands inside a sentence
        return nxt.isupper()
    return not (dash and closed) and not nxt.islower()


_NESTING = re.compile(f'[{re.escape(BRACKET_OPEN + BRACKET_CLOSE)}"]')


def _closed_brackets(para: str) -> set[int]:
    """The positions of the opening brackets whose partner follows."""
    waiting: list[int] = []
    closed: set[int] = set()
    for k, c in enumerate(para):
        if c in BRACKET_OPEN:
            waiting.append(k)
        elif c in BRACKET_CLOSE and waiting:
            closed.add(waiting.pop())
    return closed


def split_paragraph(para: str, base: int, out: list[tuple[int, int]], language: Language) -> None:
    """Append the (start, end) of the sentences of a text without blank lines, moved by ``base``. In linear time."""
    n = len(para)
    stop = len(para.rstrip())
    start = _SPACE.match(para).end()
    lead = _LEAD.match(para, start).end()  # where the sentence's words begin
    counted, depth, plain_open = start, 0, False  # brackets and straight quotes from start to counted
    bracket_inside = False
    # a bracket that never closes holds nothing together
    closing = _closed_brackets(para) if _NESTING.search(para) else set()
    pos = start
    for mark in (_ANY_MARK if _BEYOND.search(para) else _MARK).finditer(para, start):
        if mark.start() < pos:
            continue
        # brackets and quotes that opened since
        piece = para[counted : mark.start()]
        if _NESTING.search(piece):
            for k, c in enumerate(piece, counted):
                if c in BRACKET_OPEN:
                    if k not in closing:
                        continue
                    if depth == 0:
                        bracket_inside = lead < k
                    depth += 1
                elif c in BRACKET_CLOSE:
                    depth = max(0, depth - 1)
                elif c == '"':
                    plain_open = not plain_open
        counted = mark.start()
        end = mark.end()
        closed = ""
        while end < n:
            c = para[end]
            if c in CLOSERS:
                closed += c
            elif c == '"' and plain_open:
                plain_open = False
                closed += c
            elif c == "'" and (end + 1 == n or not para[end + 1].isalnum()):
                closed += c
            elif c in HARD + SOFT and closed:  # "…?)." and the like
                break
            else:
                break
            end += 1
        inside = depth > 0 and bracket_inside
        for c in closed:
            if c in BRACKET_CLOSE:
                depth = max(0, depth - 1)
        counted = end
        pos = end
        if end >= stop:
            break
        if inside:
            continue  # a bracket within the sentence: it goes on
        gap = _SPACE.match(para, end).end() - end
        look = _NEXT.match(para, end)
        after = look.end()
        dash = para[end + gap : end + gap + 1] in DASHES and para[end + gap : end + gap + 1] != ""
        if not _ends_here(para, start, mark, end, closed, after, gap, dash, language):
            continue
        if depth > 0:
            continue
        out.append((base + start, base + end))
        start = counted = pos = end + gap
        lead = _LEAD.match(para, start).end()
        depth, plain_open, bracket_inside = 0, False, False
    if stop > start:
        out.append((base + start, base + stop))


def sentence_spans(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """The (start, end) code-point offsets of the sentences of a text; none for a null or blank one.

    ``lang`` may be null, wrong or in capitals: it adds its language's abbreviations to those of
    the language that the text's frequent words show.
    """
    out: list[tuple[int, int]] = []
    if not text:
        return out
    language = Language(text, lang)
    at = 0
    for gap in _BLANK_LINE.finditer(text):
        if gap.start() > at:
            split_paragraph(text[at : gap.start()], at, out, language)
        at = gap.end()
    if at < len(text):
        split_paragraph(text[at:], at, out, language)
    return out


def _spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids: list[int] = []
        starts: list[int] = []
        ends: list[int] = []
        for doc, text, lang in zip(batch["id"].tolist(), batch["text"].tolist(), batch["lang"].tolist(), strict=True):
            for s, e in sentence_spans(text, lang):
                ids.append(doc)
                starts.append(s)
                ends.append(e)
        yield pd.DataFrame({"doc_id": pd.Series(ids, dtype="int64"), "start_char": pd.Series(starts, dtype="int32"), "end_char": pd.Series(ends, dtype="int32")})


def split_sentences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """One row (doc_id, start_char, end_char) per sentence.

    Null and blank texts give no rows; a null id is kept out, since its sentences could not be told
    apart; repeated ids are split once each as they come; further columns are ignored. ``lang_col``
    may name a column of language tags, see :func:`sentence_spans`.
    """
    rows = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), (F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")).alias("lang"))
    return rows.mapInPandas(_spans, "doc_id long, start_char int, end_char int")
