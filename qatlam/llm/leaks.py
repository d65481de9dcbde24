"""Problem 7: passages of evaluation texts inside training documents.

1. *Template canonicalisation.* Both sides are canonicalised alike (case, punctuation, apostrophes
   and the Latin or Cyrillic script drop out), and numbers, units and names become typed
   placeholders. Windows are hashed on three levels: as they stand, with placeholders for numbers and
   units, and with those for names too, which show only by a capital that the other side may lack.
2. *Seeds.* A window is five words running, or five of six with one left out in the middle, so that
   one word changed, added or missing there doesn't hide it. A window that many items share is stock
   and seeds nothing, unless the item shares nearly all its words likewise: variants of one template
   and questions about one passage are no stock, however many there are.
3. *Hash join.* One scan of the documents, for any number of items: each batch hashes its windows
   and drops those whose bits aren't in a bitmap of the seeds (of bounded size). What survives is
   written, joined exactly with the table of seeds, and windows that turn up in a large share of all
   documents, far more than others of their item on the same level, are dropped as stock too.
4. *Alignment* of the stretches around joined windows, for surviving pairs only. The stretch must
   cover at least ``min_words`` words of the item, with at most one in ``edit_every`` words changed,
   added or missing beyond a small allowance, and some words that aren't stock as they stand, or be
   nearly the whole item. Where the best alignment fails, the best that passes counts.
5. *Slot consistency.* Slots count as equal when the same value of the item always meets the same
   value of the document, which is what a re-parameterised question looks like; the pair is then
   marked, and a stretch that holds only by its slots doesn't count as copied.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qatlam.operators.lookup import BROADCAST_BYTES
from qatlam.session import materialise
from qatlam.sources.tables import small_enough, spread

# Cyrillic letters and the Latin spelling both scripts are compared in, vowels after
# which an iotated letter is written likewise in both having lost their mark.
_CYRILLIC = dict(
    zip(
        "абвгдежзийклмнопрстуфхыэқҳўғёцчшщюяәіңөүұӯґ",
        "a b v g d e j z i y k l m n o p r s t u f x i e q h o g yo ts ch sh sh yu ya a i n o u u o g".split(),
        strict=True,
    )
)
_DROP = "ъьʻʼ’‘`ʹ′ʿ'´ʾ‛‵＇ˈʽ­​‌‍⁠﻿"
_FOLD = str.maketrans(_CYRILLIC | dict.fromkeys(_DROP, ""))
_DROPPED = re.compile(f"[{_DROP}]")
_HAS_CYRILLIC = re.compile("[Ѐ-ԯ]")


def _ranges(wanted) -> str:
    """The code points with a property as the inside of a character class."""
    out, start = [], None
    for c in range(0x300, sys.maxunicode + 2):
        has = c <= sys.maxunicode and wanted(chr(c))
        if has and start is None:
            start = c
        elif not has and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


_MARKS = _ranges(lambda c: unicodedata.category(c) in ("Mn", "Mc"))
# The blocks of scripts written without blanks between words (Han, Kana, Thai, Lao, Burmese, Khmer).
_UNSPACED = "\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\ua9e0-\ua9ff\uaa60-\uaa7f"
_HAS_UNSPACED = re.compile(f"[{_UNSPACED}]")
#: Only texts with a character of these blocks are looked through for marks, which takes longer.
_MAY_HAVE_MARKS, _HAS_MARK = re.compile("[\u0300-\u036f\u0483-\u0489\u0590-\u1fff\u20d0-\u20ff\u2c80-\u2dff\u3000-\u30ff\ua000-\uffff]|[\U00010000-\U0010ffff]"), re.compile(f"[{_MARKS}]")
_SYLLABLE = re.compile(f"(?![{_MARKS}])[{_UNSPACED}][{_MARKS}]*")
_WORD = re.compile(r"[^\W_]+")
_MARKED_WORD = re.compile(rf"[^\W_](?:[^\W_]|[{_MARKS}])*")
#: Units of measure are told by rule: a prefix and a base, or a word of time, money or number, and a case suffix.
_PREFIXES = "k|m|c|s|d|g|h|n|mk|kilo|milli|santi|detsi|mega|giga|tera|mikro|nano|gekto|"
_BASES = "g|m|l|t|w|v|a|b|hz|pa|j|gramm|gram|metr|meter|litr|liter|tonna|ton|vatt|watt|volt|amper|bayt|byte|gerts|hertz|paskal|joul"
_WORDS = "ga|gektar|foiz|protsent|percent|som|sum|dollar|evro|euro|rubl|usd|eur|uzs|mln|mlrd|ming|million|milliard|billion|yil|oy|hafta|kun|soat|minut|daqiqa|sekund|soniya|year|month|week|day|hour|minute|second"
_UNIT = re.compile(f"(?:(?:{_PREFIXES})(?:{_BASES})|{_WORDS})(?:s|ni|ning|ga|da|dan|lik|dagi|gacha|lar)?")
WINDOW = 5


def canonical_words(text: str) -> list[str]:
    """The words of ``text`` in the spelling both scripts are compared in.

    Signs that a vowel or consonant carries belong to its word; in scripts without blanks between
    words each character with its signs is a word.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    text = text.lower()
    if _HAS_CYRILLIC.search(text):
        text = text.translate(_FOLD)
    elif not text.isascii() or "'" in text or "`" in text:
        text = _DROPPED.sub("", text)
    text = text.replace("ye", "e")
    if text.isascii():
        return _WORD.findall(text)
    if not _MAY_HAVE_MARKS.search(text) and not _HAS_UNSPACED.search(text):
        return _WORD.findall(text)
    if _HAS_UNSPACED.search(text):
        text = _SYLLABLE.sub(lambda m: f" {m.group()} ", text)
    return (_MARKED_WORD if _HAS_MARK.search(text) else _WORD).findall(text)


_NAME = re.compile(r"(?<=[^\W\d_] |[^\W\d_],)\s*([^\W\d_a-zа-яўқғҳё][^\W\d_]*)")
_CAPITAL = re.compile(r"(?<=[^\W\d_] )[A-ZА-ЯЎҚҒҲЁ]")


def names_in(text: str) -> set[str]:
    """The canonical words with a capital that don't open a sentence; none of a text in capitals."""
    if not _CAPITAL.search(text):
        return set()
    found = {m.group(1) for m in _NAME.finditer(text)}
    return set(canonical_words(" ".join(w for w in found if w[1:].islower() or len(w) == 1)))


#: What a word stands for in its template.
PLAIN, NUMBER, UNIT, NAME = range(4)
#: The levels windows are hashed on: words as they stand, placeholders for numbers and units, for names too.
LITERAL, TYPED, NAMED = range(3)
_SLOT_HASHES = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


class Words:
    """The canonical words of a batch of texts, their templates and the hashes of their windows."""

    def __init__(self, texts: list[str]):
        each = [canonical_words(t) for t in texts]
        self.starts = np.concatenate([[0], np.cumsum([len(w) for w in each])]).astype(np.int64)
        flat = np.empty(int(self.starts[-1]), dtype=object)
        flat[:] = [w for words in each for w in words]
        self.words = flat
        codes, distinct = pd.factorize(flat)
        hashes = pd.util.hash_array(distinct, categorize=False) if len(distinct) else np.zeros(0, dtype=np.uint64)
        number = np.fromiter((w[0].isdigit() for w in distinct), dtype=bool, count=len(distinct))
        unit = np.fromiter((_UNIT.fullmatch(w) is not None for w in distinct), dtype=bool, count=len(distinct))
        kinds = np.zeros(len(flat), dtype=np.int8)
        is_number = number[codes]
        after_number = np.concatenate([[False], is_number[:-1]]) if len(flat) else np.zeros(0, dtype=bool)
        after_number[self.starts[:-1][self.starts[:-1] < len(flat)]] = False
        kinds[unit[codes] & after_number] = UNIT
        kinds[is_number] = NUMBER
        for k, (text, words) in enumerate(zip(texts, each, strict=True)):
            if names := names_in(text):
                at = slice(self.starts[k], self.starts[k + 1])
                named = np.fromiter((w in names for w in words), dtype=bool, count=len(words))
                kinds[at][named & (kinds[at] == PLAIN)] = NAME
        self.kinds = kinds
        plain = hashes[codes].astype(np.uint64) if len(flat) else np.zeros(0, dtype=np.uint64)
        typed = np.where((kinds == NUMBER) | (kinds == UNIT), _SLOT_HASHES[kinds], plain)
        self._hashes = [plain, typed, np.where(kinds == NAME, _SLOT_HASHES[NAME], typed)]
        ends = np.repeat(self.starts[1:], np.diff(self.starts))
        self.room = ends - np.arange(len(flat))

    def by_level(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
        """(level, highest levels with the same keys, first words, keys, span) of the windows.

        A level has the windows that its placeholders change, with two words of five at least that
        aren't slots; as they stand, windows of nothing but slots are hashed as well.
        """
        values, names = ((self.kinds == NUMBER) | (self.kinds == UNIT)).astype(np.int8), (self.kinds == NAME).astype(np.int8)
        for span, offsets in {WINDOW: (0, 1, 2, 3, 4), WINDOW + 1: (0, 1, 2, 4, 5)}.items():
            at = np.flatnonzero(self.room >= span)
            if not len(at):
                continue
            n_values, n_names = sum(values[at + o] for o in offsets), sum(names[at + o] for o in offsets)
            upto = np.where(n_names > 0, TYPED, NAMED)
            keep = {LITERAL: slice(None), TYPED: (n_values > 0) & (n_values <= WINDOW - 2), NAMED: (n_names > 0) & (n_values + n_names <= WINDOW - 2)}
            highest = {LITERAL: np.where(n_values > 0, LITERAL, upto), TYPED: upto, NAMED: np.full(len(at), NAMED)}
            for level, hashes in enumerate(self._hashes):
                first = at[keep[level]]
                key = np.zeros(len(first), dtype=np.uint64)
                for o in offsets:
                    key = (key ^ hashes[first + o]) * np.uint64(0x9FB21C651E98DF25)
                    key ^= key >> np.uint64(28)
                yield level, highest[level][keep[level]], first, key.view(np.int64), span

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(first words, keys, span) of the windows of all levels."""
        return ((at, key, span) for _, _, at, key, span in self.by_level())


def _item_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        w = Words(batch["text"].tolist())
        ids = np.repeat(batch["text_id"].to_numpy(), np.diff(w.starts))
        first = np.repeat(w.starts[:-1], np.diff(w.starts))
        length = np.repeat(np.diff(w.starts), np.diff(w.starts))
        for level, upto, at, key, span in w.by_level():
            places = {"item_pos": (at - first[at]).astype("int32"), "item_words": length[at].astype("int32"), "span": np.full(len(at), span, dtype="int32")}
            yield pd.DataFrame({"key": key, "text_id": ids[at], **places, "level": np.full(len(at), level, dtype="int32"), "upto": upto.astype("int32")})


def _item_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        w = Words(batch["text"].tolist())
        cut = [slice(a, b) for a, b in zip(w.starts[:-1], w.starts[1:], strict=True)]
        yield pd.DataFrame({"text_id": batch["text_id"], "item": pd.Series([w.words[c].tolist() for c in cut], index=batch.index, dtype=object), "item_kinds": pd.Series([w.kinds[c].astype("int32").tolist() for c in cut], index=batch.index, dtype=object)})


#: A window that so many distinct items hold is no stock whatever the share; beyond, this share of them makes it stock
#: if it is also ``STOCK_TIMES`` as frequent as the least shared words of its item, which this part of them is counted as.
STOCK_ITEMS, STOCK_ITEMS_SHARE, OWN_PART = 4, 0.01, 0.25
#: Likewise of documents, if it is also so many times as frequent as the median window of its item.
STOCK_DOCUMENTS, STOCK_DOCUMENTS_SHARE, STOCK_TIMES = 50, 0.01, 4
#: Items whose joined windows with one document are held in one row, about.
ITEMS_AT_ONCE = 1000
#: Bits of the bitmap for each seed, and the limits of its size as powers of two. Beyond the upper one
#: more windows survive the bitmap by chance; the join that follows is exact in any case.
BITS_A_SEED, LEAST_BITS, MOST_BITS = 64, 20, 28


def _bitmap(seeds: DataFrame, count: int) -> np.ndarray:
    """The bitmap of the seeds' keys: at most ``2 ** MOST_BITS`` bits, put together by an aggregation."""
    bits = min(MOST_BITS, max(LEAST_BITS, (max(1, count) * BITS_A_SEED - 1).bit_length()))
    mask = (1 << bits) - 1
    at = F.explode(F.array(F.shiftrightunsigned("key", 64 - bits), F.col("key").bitwiseAND(F.lit(mask)))).alias("at")
    words = seeds.select(at).groupBy(F.shiftrightunsigned("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toPandas()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def _in_bitmap(keys: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    bits = int(len(bitmap) * 64).bit_length() - 1
    k = keys.view(np.uint64)
    hit = np.ones(len(k), dtype=bool)
    for at in (k >> np.uint64(64 - bits), k & np.uint64((1 << bits) - 1)):
        hit &= (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
    return hit


# ------------------------------------------------------------------ alignment
#: Words a passage may have gained or lost in all before and after a joined window.
SLACK = 12


def _groups(hits: list[tuple[int, int]], item_words: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """The stretches (first word, end, hits) of a document that hits allow the item to reach, one for each group of near hits."""
    out: list[tuple[int, int, list[tuple[int, int]]]] = []
    last = 0
    for pos, i in sorted(hits):
        lo, hi = pos - i - SLACK, pos - i + item_words + SLACK
        if out and pos - last <= item_words:
            out[-1] = (min(out[-1][0], lo), max(out[-1][1], hi), [*out[-1][2], (pos, i)])
        else:
            out.append((lo, hi, [(pos, i)]))
        last = pos
    return out


#: The cost of one changed, added or missing word, where an agreeing word earns one, and how far
#: an alignment may fall below its best before it is broken off: three changes in a row end a stretch.
EDIT_COST, BREAK_OFF = 2, 6


def align(
    doc: list[int], item: list[int], equal: set[tuple[int, int]] = frozenset(), stock: frozenset[int] = frozenset(), band: tuple[int, int] | None = None,
    enough: Callable[[int, int, int, int, int], bool] | None = None, edit_cost: int = EDIT_COST,
) -> tuple[int, int, int, int, int]:
    """The best local alignment: (agreeing words, edits, words of the item covered, slots and words not stock among the agreeing).

    ``stock`` are places in the item; ``band`` bounds the place in the document less that in the item.
    With ``enough`` it is the best of those that are, zeros if none is.
    """
    width = len(item) + 1
    zero = (0, 0, 0, 0, 0, 0, 0)  # score, agreeing, edits, covered, slots, not stock, best score on the way
    best, prev = zero, [zero] * width
    low, high = band if band else (-width, len(doc))
    break_off = BREAK_OFF * edit_cost // EDIT_COST
    for i, d in enumerate(doc):
        cur = [zero] * width
        left = zero
        for j in range(max(1, i - high + 1), min(width, i - low + 2)):
            it = item[j - 1]
            if d == it or (equal and (d, it) in equal):
                p = prev[j - 1]
                s = p[0] + 1
                left = (s, p[1] + 1, p[2], p[3] + 1, p[4] + (d != it), p[5] + (j - 1 not in stock), s if s > p[6] else p[6])
                if left > best and (enough is None or enough(*left[1:6])):
                    best = left
            else:
                a, b = prev[j - 1], prev[j]
                if a[0] >= b[0] and a[0] >= left[0]:
                    p, covers = a, 1
                elif b[0] >= left[0]:
                    p, covers = b, 0
                else:
                    p, covers = left, 1
                s = p[0] - edit_cost
                left = (s, p[1], p[2] + 1, p[3] + covers, p[4], p[5], p[6]) if s > 0 and s >= p[6] - break_off else zero
            cur[j] = left
        prev = cur
    return best[1], best[2], best[3], best[4], best[5]


def _consistent_slots(doc: list[str], doc_kinds: list[int], item: list[str], item_kinds: list[int], hits: list[tuple[int, int]]) -> set[tuple[str, str]]:
    """Pairs (document's value, item's value) of slots that joined windows put side by side, one value to one value."""
    pairs: dict[str, set[str]] = {}
    back: dict[str, set[str]] = {}
    for pos, i in hits:
        for k in range(WINDOW):
            a, b = pos + k, i + k
            if 0 <= a < len(doc) and b < len(item) and doc_kinds[a] == item_kinds[b] != PLAIN:
                pairs.setdefault(item[b], set()).add(doc[a])
                back.setdefault(doc[a], set()).add(item[b])
    return {(mine, his) for his, found in pairs.items() for mine in found if len(found) == 1 and len(back[mine]) == 1 and mine != his}


def judge(doc: list[str], doc_kinds: list[int], item: list[str], item_kinds: list[int], hits: list[tuple[int, int]], stock: frozenset[int], min_words: int, edit_every: int) -> tuple[int, int, bool] | None:
    """(agreeing words, edits, re-parameterised) if the stretch of a document holds the item, else nothing.

    A word of a script without blanks is a character, of which it takes twice as many.
    """
    unspaced = sum(1 for w in item if _HAS_UNSPACED.match(w))
    if 2 * unspaced > len(item):
        min_words *= 2
    number: dict[str, int] = {}
    theirs = [number.setdefault(w, len(number)) for w in item]
    mine = [number.setdefault(w, len(number)) for w in doc]
    equal = {(number[a], number[b]) for a, b in _consistent_slots(doc, doc_kinds, item, item_kinds, hits)}
    shifts = [pos - i for pos, i in hits]
    low, high = min(shifts) - SLACK, max(shifts) + SLACK
    least = min_words - max(1, min_words // edit_every)

    def holds(agreeing: int, edits: int, covered: int, slots: int, own: int, allowed: int = 0) -> bool:
        if agreeing < least or covered < min_words or edits * edit_every > covered + allowed:
            return False
        return own >= min(WINDOW, least) or agreeing >= len(item) - len(item) // edit_every

    got = align(mine, theirs, equal, stock, (low, high))
    if not holds(*got, allowed=edit_every):
        known = set(theirs) | {a for a, _ in equal}
        if sum(1 for w in mine if w in known) < least:
            return None
        # A denser part beside it may spoil the best alignment, or a word beyond its last edit be missing from it.
        turned = mine[::-1], theirs[::-1], equal, frozenset(len(item) - 1 - p for p in stock), (len(doc) - len(item) - high, len(doc) - len(item) - low)
        tried = (align(*side, holds, cost) for cost in (EDIT_COST, edit_every) for side in ((mine, theirs, equal, stock, (low, high)), turned))
        got = next((x for x in tried if x[0]), None)
        if got is None:
            return None
    agreeing, edits, _, slots, _ = got
    return agreeing, edits, bool(slots) and agreeing - slots < least


# ------------------------------------------------------------------ the tables
#: Characters of text whose words a worker holds at once.
CHARS_AT_ONCE = 8_000_000


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches in pieces of so much text, whole texts each: long texts would make a batch of many large."""
    for batch in batches:
        for _, piece in batch.groupby(batch["text"].str.len().cumsum() // CHARS_AT_ONCE, sort=False):
            yield piece


def _probe(documents: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(row, doc_id, text, hits) of the documents with a window that may be a seed."""
    held = documents.sparkSession.sparkContext.broadcast(bitmap)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _pieces(batches):
            w = Words(batch["text"].tolist())
            found_at, found_key = [], []
            for at, key, _ in w.windows():
                hit = _in_bitmap(key, held.value)
                found_at.append(at[hit])
                found_key.append(key[hit])
            at, key = np.concatenate([*found_at, np.zeros(0, dtype=np.int64)]), np.concatenate([*found_key, np.zeros(0, dtype=np.int64)])
            doc = np.searchsorted(w.starts, at, side="right") - 1
            order = np.argsort(doc, kind="stable")
            doc, at, key = doc[order], at[order], key[order]
            docs, first = np.unique(doc, return_index=True)
            hits = [list(zip((a - w.starts[d]).tolist(), k.tolist(), strict=True)) for d, a, k in zip(docs, np.split(at, first[1:]), np.split(key, first[1:]), strict=True)] if len(docs) else []
            out = batch.iloc[docs]
            yield out.assign(hits=pd.Series([[{"pos": p, "key": k} for p, k in h] for h in hits], index=out.index, dtype=object))

    return documents.mapInPandas(probe, "row long, doc_id long, text string, hits array<struct<pos:int,key:long>>")


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The words of each stretch that a document's joined windows mark, cut out of its text once."""
    for batch in _pieces(batches):
        w = Words(batch["text"].tolist())
        rows = []
        for k, (doc_id, joined) in enumerate(zip(batch["doc_id"].tolist(), batch["joined"].tolist(), strict=True)):
            start, end = int(w.starts[k]), int(w.starts[k + 1])
            by_item: dict[int, list[tuple[int, int]]] = {}
            length: dict[int, int] = {}
            for x in joined:
                by_item.setdefault(x["text_id"], []).append((x["pos"], x["item_pos"]))
                length[x["text_id"]] = x["item_words"]
            for text_id, hits in by_item.items():
                for lo, hi, near in _groups(hits, length[text_id]):
                    a, b = start + max(0, lo), min(end, start + hi)
                    rows.append((doc_id, text_id, w.words[a:b].tolist(), w.kinds[a:b].astype("int32").tolist(), [{"pos": p - (a - start), "item_pos": i} for p, i in near]))
        yield pd.DataFrame(rows, columns=["doc_id", "text_id", "words", "kinds", "near"]).astype({"doc_id": "int64", "text_id": "int64", "words": object, "kinds": object, "near": object})


def _usual_shares(counted: DataFrame) -> DataFrame:
    """(text_id, on, usual): by item and level how many items share each of its least shared words, ``OWN_PART`` of all.

    A word is shared by as many items as the most common window over it.
    """
    places = counted.where(F.col("span") == WINDOW).select("text_id", "items", F.explode(F.sequence("level", "upto")).alias("on"), F.explode(F.sequence("item_pos", F.col("item_pos") + WINDOW - 1)).alias("place"))
    return places.groupBy("text_id", "on", "place").agg(F.max("items").alias("items")).groupBy("text_id", "on").agg(F.percentile_approx("items", OWN_PART).alias("usual"))


def _usual_documents(counted: DataFrame) -> DataFrame:
    """(text_id, on, usual): by item and level the median number of documents of the windows that documents hold."""
    return counted.select("text_id", "documents", F.explode(F.sequence("level", "upto")).alias("on")).groupBy("text_id", "on").agg(F.percentile_approx("documents", 0.5).alias("usual"))


def _stock(counted: DataFrame, count: str, limit: int, usual: DataFrame) -> DataFrame:
    """(key, text_id) of the windows counted over ``limit`` and far over the usual count of their item, on each level they belong to."""
    many = counted.where(F.col(count) > limit).select("key", "text_id", count, F.explode(F.sequence("level", "upto")).alias("on"))
    far = F.col(count) > STOCK_TIMES * F.coalesce("usual", F.lit(0))
    return many.join(usual, ["text_id", "on"], "left").groupBy("key", "text_id").agg(F.min(far).alias("stock")).where("stock").select("key", "text_id")


def find_leaks(documents: DataFrame, items: DataFrame, min_words: int = 12, edit_every: int = 6) -> DataFrame:
    """(doc_id, item_id, agreeing, edits, reparameterised) for each item found in a document.

    Documents and items without id or text are left out. An item shorter than ``min_words`` can't
    leak by this rule. Repeated ids of documents give one row; of repeated items, each text counts.
    """
    named = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text", F.xxhash64("text").alias("text_id")).distinct()
    texts = materialise(named.select("text_id", "text").distinct(), "item-texts")
    windows = materialise(spread(texts).mapInPandas(_item_windows, "key long, text_id long, item_pos int, item_words int, span int, level int, upto int").distinct(), "item-windows")
    n_texts = texts.count()
    most = max(STOCK_ITEMS, int(STOCK_ITEMS_SHARE * n_texts))
    shares = windows.groupBy("key").agg(F.count_distinct("text_id").alias("items"))
    crowded = windows.join(shares.where(F.col("items") > most), "key", "left_semi").select("text_id").distinct()
    counted = materialise(windows.join(crowded, "text_id", "left_semi").join(shares, "key"), "item-windows-shared")
    seeds = materialise(windows.join(_stock(counted, "items", most, _usual_shares(counted)), ["key", "text_id"], "left_anti"), "item-seeds")
    docs = documents.where("doc_id is not null and text is not null").select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = materialise(_probe(spread(docs), _bitmap(seeds, seeds.count())), "hit-documents")

    # windows of documents joined with seeds, and what is stock among the documents
    each = held.select("row", F.explode("hits").alias("hit")).select("row", "hit.pos", "hit.key")
    by_key = each.join(F.broadcast(seeds.select("key").distinct()) if small_enough(seeds, BROADCAST_BYTES) else seeds.select("key").distinct(), "key", "left_semi").select("key", "row").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("documents"))
    often = materialise(by_key, "window-documents")
    all_documents = documents.where("doc_id is not null").count()
    limit = max(STOCK_DOCUMENTS, int(STOCK_DOCUMENTS_SHARE * all_documents))
    met = seeds.join(often, "key")
    used = materialise(seeds.join(_stock(met, "documents", limit, _usual_documents(met)), ["key", "text_id"], "left_anti"), "item-seeds-used")
    stock = windows.where((F.col("span") == WINDOW) & (F.col("level") == LITERAL)).join(used.select("key", "text_id").distinct(), ["key", "text_id"], "left_anti").groupBy("text_id").agg(F.collect_set("item_pos").alias("stock"))

    side = used.select("key", "text_id", "item_pos", "item_words")
    joined = each.join(F.broadcast(side) if small_enough(side, BROADCAST_BYTES) else side, "key").groupBy("row", F.pmod("text_id", F.lit(1 + n_texts // ITEMS_AT_ONCE)).alias("part")).agg(F.collect_set(F.struct("text_id", "pos", "item_pos", "item_words")).alias("joined"))
    stretches = held.select("row", "doc_id", "text").dropDuplicates(["row"]).join(joined, "row").select("doc_id", "text", "joined")
    cut = stretches.mapInPandas(_stretches, "doc_id long, text_id long, words array<string>, kinds array<int>, near array<struct<pos:int,item_pos:int>>")
    of_items = texts.mapInPandas(_item_words, "text_id long, item array<string>, item_kinds array<int>").join(stock, "text_id", "left")
    pairs = cut.join(F.broadcast(of_items) if small_enough(texts, BROADCAST_BYTES // 8) else of_items, "text_id")

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for x in batch.itertuples(index=False):
                places = frozenset(p + k for p in (x.stock if x.stock is not None else ()) for k in range(WINDOW))
                got = judge(list(x.words), list(x.kinds), list(x.item), list(x.item_kinds), [(h["pos"], h["item_pos"]) for h in x.near], places, min_words, edit_every)
                if got:
                    rows.append((x.doc_id, x.text_id, *got))
            yield pd.DataFrame(rows, columns=["doc_id", "text_id", "agreeing", "edits", "reparameterised"]).astype({"doc_id": "int64", "text_id": "int64", "agreeing": "int32", "edits": "int32", "reparameterised": "bool"})

    found = spread_pairs(pairs).mapInPandas(aligned, "doc_id long, text_id long, agreeing int, edits int, reparameterised boolean")
    by_text = found.groupBy("doc_id", "text_id").agg(F.max("agreeing").alias("agreeing"), F.min("edits").alias("edits"), F.min("reparameterised").alias("reparameterised"))
    ids = named.select("item_id", "text_id")
    out = by_text.join(F.broadcast(ids) if small_enough(ids, BROADCAST_BYTES) else ids, "text_id")
    return out.groupBy("doc_id", "item_id").agg(F.max("agreeing").alias("agreeing"), F.min("edits").alias("edits"), F.min("reparameterised").alias("reparameterised"))


def spread_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs over as many tasks as a shuffle has: a stretch is few bytes but much work, and one document may hold many items."""
    n = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs.sparkSession.sparkContext.defaultParallelism)
    return pairs.repartition(n, F.xxhash64("doc_id", "text_id", "near"))
