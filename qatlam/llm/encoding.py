"""Problem 5: text that was decoded with the wrong character encoding.

Three steps, none of which shuffles the texts:

1. *Pair statistics.* One pass over every row counts adjacent character pairs (by character class,
   so that the table is bounded by ``CLASSES ** 2`` whatever the data) and turns them into smoothed
   pointwise mutual information. The smoothing is relative to the corpus size, so the scores behave
   alike at every size, and a character that is rare in the corpus doesn't score high just because
   it always meets the same neighbour (as the bytes of a garbled letter do).
2. *Improbable runs.* In each value the pairs' improbabilities are scanned for maximum-scoring
   segments (Ruzzo and Tompa's linear-time algorithm).
3. *Inverse mappings.* Only inside those runs, the inverse of each known confusion is tried, up to
   three times in a row; it is accepted if the run becomes that much more probable. A swap of
   one-byte alphabets leaves no structure, so exact word counts have a say in it: what is more
   common than the word it would stand for is no garbled word, and a swap the pairs leave open is
   taken if it makes a far more common word.

A value that holds U+FFFD, a C1 control or a question mark amid its letters was decoded wrongly
too, though the text may be lost.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qatlam.operators.lookup import BROADCAST_BYTES
from qatlam.session import materialise
from qatlam.sources.tables import small_enough, spread_by

# ------------------------------------------------------------------ classes
_SINGLE = 0x530  # code points below have a class each, folded to small letters
_BLOCK = 0x80  # from there to _WIDE, a class for each block of so many
_WIDE = 0xA000
_FIRST_BLOCK = _SINGLE
_FIRST_WIDE = _FIRST_BLOCK + (_WIDE - _SINGLE) // _BLOCK + 1
#: Classes in all; the pair table has at most the square of it.
CLASSES = _FIRST_WIDE + 0x110000 // 0x1000 + 2

_table: np.ndarray | None = None


def class_table() -> np.ndarray:
    """The class of every code point."""
    global _table
    if _table is None:
        cp = np.arange(0x110000, dtype=np.int64)
        t = np.where(cp < _WIDE, _FIRST_BLOCK + (cp - _SINGLE) // _BLOCK, _FIRST_WIDE + cp // 0x1000)
        for c in range(_SINGLE):
            low = chr(c).lower()
            t[c] = ord(low) if len(low) == 1 and ord(low) < _SINGLE else c
        t[ord("0") : ord("9") + 1] = ord("0")
        t[0xFF61:0xFFA0] = CLASSES - 1  # half-width katakana, apart from the full-width letters of their block
        _table = t.astype(np.int32)
    return _table


def classes_of(text: str) -> np.ndarray:
    return class_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


# ------------------------------------------------------------------ pair statistics
_FLUSH = 1 << 20


def _count_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(CLASSES * CLASSES, dtype=np.int64)
    pairs: list[np.ndarray] = []
    weights: list[np.ndarray] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if held:
            # whole numbers below 2**53: exact in floating point
            found, where = np.unique(np.concatenate(pairs), return_inverse=True)
            total[found] += np.bincount(where, weights=np.concatenate(weights)).astype(np.int64)
        pairs.clear()
        weights.clear()
        held = 0

    for batch in batches:
        counts = batch["text"].value_counts()
        values = counts.index.tolist()
        if not values:
            continue
        cls = classes_of("\0" + "\0".join(values) + "\0").astype(np.int64)
        lengths = np.fromiter((len(v) for v in values), dtype=np.int64, count=len(values)) + 1
        w = np.repeat(counts.to_numpy(dtype=np.float64), lengths)
        p = cls[:-1] * CLASSES + cls[1:]
        pairs.append(p[: len(w)] if len(p) > len(w) else p)
        weights.append(w[: len(p)])
        held += len(p)
        if held >= _FLUSH:
            flush()
    flush()
    at = np.flatnonzero(total)
    yield pd.DataFrame({"a": (at // CLASSES).astype("int32"), "b": (at % CLASSES).astype("int32"), "n": total[at]})


def pair_counts(texts: DataFrame) -> DataFrame:
    """How often each pair of character classes occurs; at most ``CLASSES ** 2`` rows. Null texts are left out."""
    rows = texts.select(F.col(texts.columns[0]).alias("text")).where("text is not null and text != ''")
    return rows.mapInPandas(_count_pairs, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


#: Shares of the corpus that every class and every pair is taken to have in addition.
CLASS_PRIOR, PAIR_PRIOR = 4e-3, 1e-7


def pair_scores(texts: DataFrame) -> np.ndarray:
    """The smoothed mutual information of each pair of classes, as a matrix of float32 (bounded, see ``CLASSES``)."""
    found = pair_counts(texts).toPandas()
    n = np.zeros((CLASSES, CLASSES), dtype=np.float64)
    n[found["a"], found["b"]] = found["n"]
    size = max(1.0, n.sum())
    left, right = n.sum(axis=1) / size + CLASS_PRIOR, n.sum(axis=0) / size + CLASS_PRIOR
    n /= size
    n += PAIR_PRIOR
    n /= left[:, None]
    n /= right[None, :]
    return np.log(n, out=n).astype(np.float32)


# ------------------------------------------------------------------ improbable runs
def maximal_segments(weights: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (start, end, sum): Ruzzo and Tompa (1999), in linear time."""
    segments: list[list[float]] = []  # start, end, sum before, sum through
    run = 0.0
    for i, w in enumerate(weights):
        before = run
        run += w
        if w <= 0:
            continue
        new = [i, i + 1, before, run]
        while True:
            j = len(segments) - 1
            while j >= 0 and segments[j][2] >= new[2]:
                j -= 1
            if j < 0 or segments[j][3] >= new[3]:
                segments.append(new)
                break
            new = [segments[j][0], new[1], segments[j][2], new[3]]
            del segments[j:]
    return [(int(s), int(e), b - a) for s, e, a, b in segments]


# ------------------------------------------------------------------ inverse mappings
def _reverse_map(codec: str) -> dict[int, int]:
    """Code point to byte for a one-byte encoding; bytes it doesn't define stand for themselves, as lenient decoders have it."""
    out: dict[int, int] = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(ord(c), b)
    for b in range(128, 160):  # C1 controls come from decoders that fall back to Latin-1
        out.setdefault(b, b)
    return out


# The encodings that text of these languages is commonly mistaken for, by the bytes
# a letter takes in them, and those that hold Cyrillic or accented Latin letters in one byte.
_BYTE_CODECS = (
    "cp1252 latin-1 cp1251 koi8-r koi8-u cp866 mac_cyrillic mac_roman cp437 cp850 cp1254 cp1250 cp852 iso8859-5 iso8859-9 iso8859-2 iso8859-15 iso8859-7 cp1253 cp1255 cp1256 cp1257 cp1258 "
    "cp855 cp857 cp858 cp1125 cp775 cp874 mac_turkish mac_latin2 mac_greek iso8859-4 iso8859-10 iso8859-13 iso8859-16 ptcp154 kz1048 koi8-t"
).split()
_WIDE_CODECS = "gb18030 big5 cp932 cp949 euc_jp".split()
_CYRILLIC_CODECS = "cp1251 koi8-r koi8-u cp866 iso8859-5 mac_cyrillic cp855 cp1125 ptcp154 kz1048 koi8-t".split()
_LATIN_CODECS = "cp1252 cp1254 cp437 cp850 cp857 mac_roman mac_turkish".split()
_MAPS = {c: _reverse_map(c) for c in _BYTE_CODECS}


def _to_bytes(text: str, codec: str) -> bytes | None:
    table = _MAPS[codec]
    try:
        return bytes([table[ord(c)] for c in text])
    except KeyError:
        return None


def _inverse_utf8(text: str) -> list[str]:
    out: list[str] = []
    for codec in _BYTE_CODECS:
        raw = _to_bytes(text, codec)
        if raw is None:
            continue
        try:
            got = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if got != text and got not in out:
            out.append(got)
    if any("\u2e80" <= c for c in text):
        for codec in _WIDE_CODECS:
            try:
                got = text.encode(codec).decode("utf-8")
            except UnicodeError:
                continue
            if got != text and got not in out:
                out.append(got)
    return out


def _inverse_pairs(text: str) -> list[str]:
    """Bytes that were read two by two, in this or the other order."""
    out: list[str] = []
    if all(0x2000 < ord(c) < 0x10000 for c in text):
        for codec, other in (("utf-16-le", "utf-16-be"), ("utf-16-be", "utf-16-le")):
            try:
                raw = text.encode(codec)
            except UnicodeEncodeError:
                continue
            for right in ("utf-8", other):
                try:
                    got = raw.decode(right)
                except UnicodeDecodeError:
                    continue
                if any(map(str.isalpha, got)) and all(c < "\u0530" or c in "‘’“”–—" for c in got) and got not in out:
                    out.append(got)
    return out


def _inverse_halves(text: str) -> str | None:
    """Text whose two-byte characters were read byte by byte, which leaves controls between the letters."""
    for codec in ("latin-1", "cp1252", "cp1251", "koi8-r", "cp866"):
        raw = _to_bytes(text, codec)
        if raw is None:
            continue
        for right in ("utf-16-le", "utf-16-be"):
            try:
                got = raw.decode(right)
            except UnicodeDecodeError:
                continue
            if _plausible(got) and all(c < "\u0530" for c in got):
                return got
    return None


def _inverse_single(text: str) -> list[str]:
    """What the bytes of one-byte text read as in the other alphabets it may have been written in."""
    out: list[str] = []
    seen = {text}
    right = _CYRILLIC_CODECS + _LATIN_CODECS
    for wrong in _BYTE_CODECS:
        raw = _to_bytes(text, wrong)
        if raw is None or raw in seen:
            continue
        seen.add(raw)
        for codec in right:
            try:
                got = raw.decode(codec)
            except UnicodeDecodeError:
                continue
            if got not in seen:
                seen.add(got)
                out.append(got)
    return out


_CONTROL = re.compile("[\x00-\x08\x0e-\x1a]")
_LOST = re.compile("[\x00-\x08\x0e-\x1a\x80-\x9f\ufffd]|(?<=[^\\W\\d_])\\?+(?=[^\\W\\d_])")
#: Parts of drawn tables. In a garbled corpus they meet so often that no run of them is improbable.
_DRAWN = re.compile("[\u2500-\u259f]{2}")
_NOT_ASCII = re.compile("[^\x00-\x7f]+")
_LETTERS = re.compile(r"[^\W\d_ʻʼ]")

#: Below this score a pair counts as improbable; a segment needs so much improbability in all.
THETA, SEGMENT = 0.0, 1.0
#: What each mapping to valid UTF-8 or UTF-16, or each character it saves, counts for in
#: improbability. Chance hardly makes valid UTF, so a run may even become a little less probable by it: the bytes of a common garbled
#: letter meet so often that they look at home. Not so if the run is a word of one alphabet as it
#: stands, or if the mapping leads to a script that is far from alphabets and punctuation.
UTF_BONUS, UTF_STRANGE = 1.5, 2.0

#: A swap that isn't sure by itself is taken if it makes a word so many times as common as the run.
COMMON_TIMES = 4
#: A garbled form isn't more common than what it stands for, unless it occurs no more often than this.
RARE_RUN = 4
#: Letters that a word needs for its commonness to tell.
COMMON_LETTERS = 4

#: How sure a verdict is: an inverse mapping to Unicode or lost characters; a swap of alphabets
#: by the pairs alone; a swap that needs the words' counts.
SURE, SWAP, OPEN = "sure", "swap", "open"


class Verdict(NamedTuple):
    kind: str | None  # None: not garbled
    restored: str | None = None
    candidates: tuple[str, ...] = ()  # for OPEN: the words it may be, the most probable first


class Detector:
    """Judges single values against the corpus scores."""

    def __init__(self, scores: np.ndarray):
        self.scores = scores
        self._kept: dict[str, Verdict] = {}

    def improbability(self, text: str) -> list[float]:
        cls = classes_of(text)
        return (THETA - self.scores[cls[:-1], cls[1:]]).tolist()

    def cost(self, text: str) -> float:
        return float(sum(w for w in self.improbability(text) if w > 0))

    def runs(self, text: str) -> list[tuple[int, int]]:
        """The improbable runs of ``text``, widened to whole stretches of non-ASCII characters they touch."""
        weights = self.improbability("\0" + text + "\0")
        stretches = [m.span() for m in _NOT_ASCII.finditer(text)]
        spans: list[tuple[int, int]] = []
        for s, e, total in maximal_segments(weights):
            if total < SEGMENT:
                continue
            # pair i joins text[i-1] and text[i]
            lo, hi = max(0, s - 1), min(len(text), e)
            touched = [(a, b) for a, b in stretches if a < hi and b > lo]
            if not touched:
                continue
            spans.append((min(lo, touched[0][0]), max(hi, touched[-1][1])))
        spans += [(a, b) for a, b in stretches if _DRAWN.search(text, a, b)]
        merged: list[tuple[int, int]] = []
        for lo, hi in sorted(spans):
            if merged and lo <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
            else:
                merged.append((lo, hi))
        return merged

    def _trim(self, text: str, lo: int, hi: int) -> tuple[int, int]:
        """The run without its outer ASCII: that is the same in every encoding."""
        while lo < hi and text[lo] < "\x80":
            lo += 1
        while hi > lo and text[hi - 1] < "\x80":
            hi -= 1
        return lo, hi

    def _restore(self, run: str, left: str, right: str) -> Verdict:
        old = self.cost(left + run + right)
        best, best_cost = None, old
        seen, level = {run}, [run]
        reached = [run]
        one_alphabet = all("\u0400" <= c <= "\u052f" for c in run)
        for depth in range(3):
            level = [got for text in level for got in _inverse_utf8(text) + (_inverse_pairs(text) if depth == 0 else []) if not (got in seen or seen.add(got))]
            reached += level
            for got in level:
                if not _plausible(got) or _mixed(got, left, right):
                    continue
                strange = one_alphabet or any("\u052f" < c < "\u1e00" or c > "\u2300" for c in got)
                now = self.cost(left + got + right) + (UTF_STRANGE if strange else -UTF_BONUS * max(depth + 1, len(run) - len(got)))
                if now < best_cost:
                    best, best_cost = got, now
        if best is not None:
            return Verdict(SURE, best)
        best_cost = old
        kind = None
        whole = not (left.isalpha() or right.isalpha())
        unsure: list[tuple[float, str]] = []
        for text in reached:
            # a swap below a mapping to valid UTF-8 rests on that structure too
            for got in _inverse_single(text):
                if _plausible(got) and ((now := self.cost(left + got + right)) < old or _DRAWN.search(run)):
                    if _accent_is_sure(run, got, left, right, old, now):
                        if now < best_cost:
                            best, best_cost, kind = got, now, SURE
                    elif _swap_is_sure(run, got, left, right, old, now):
                        if now < best_cost or best is None:
                            best, best_cost, kind = got, now, SURE if text is not run else SWAP
                    elif whole and len(got) >= COMMON_LETTERS and _CYRILLIC_WORD.fullmatch(got) and _same_case(got):
                        unsure.append((now, got))
        if best is not None:
            return Verdict(kind, best)
        return Verdict(OPEN, None, tuple(got for _, got in sorted(unsure))) if unsure else Verdict(None)

    def judge(self, text: str) -> Verdict:
        """Whether ``text`` was decoded wrongly, and the right text if it can still be had."""
        kept = self._kept.get(text)
        if kept is None:
            kept = self._judge(text)
            if len(self._kept) > 200_000:
                self._kept.clear()
            self._kept[text] = kept
        return kept

    def _judge(self, text: str) -> Verdict:
        lost = _LOST.search(text) is not None
        if _CONTROL.search(text) and (got := _inverse_halves(text)):
            return Verdict(SURE, got)
        out, at, kinds = [], 0, set()
        candidates: list[str] = []
        for lo, hi in self.runs(text):
            lo, hi = self._trim(text, lo, hi)
            got = self._restore(text[lo:hi], text[lo - 1] if lo else "\0", text[hi] if hi < len(text) else "\0") if hi > lo else Verdict(None)
            out.append(text[at:lo])
            out.append(text[lo:hi] if got.restored is None else got.restored)
            kinds.add(got.kind)
            candidates += [text[:lo] + c + text[hi:] for c in got.candidates]
            at = hi
        out.append(text[at:])
        whole = "".join(out)
        for kind in (SURE, SWAP):
            if kind in kinds:
                kind = SURE if lost else kind
                return Verdict(kind, None if _LOST.search(whole) else whole)
        if lost:
            return Verdict(SURE)
        return Verdict(OPEN, None, tuple(candidates)) if candidates else Verdict(None)


def _plausible(text: str) -> bool:
    """Whether a decoded run can be text: no lost characters, controls or private characters."""
    return not any((c < " " and c not in "\t\n") or "\x7f" <= c <= "\x9f" or "\ue000" <= c <= "\uf8ff" or c == "\ufffd" for c in text)


#: A swap of one-byte alphabets leaves no structure behind, so it must pay well: in improbability
#: taken away, in all and for each pair, and in what is left for each pair. Swaps to capitals and
#: short words need more, for abbreviations and foreign words look much the same; signs amid the
#: letters need less.
SWAP_GAIN, SWAP_PAIR, SWAP_LEFT, SWAP_SHORT_PAIR, SWAP_CAPITALS_PAIR, SWAP_SIGNS_LEFT = 6.0, 1.0, 0.9, 1.45, 1.8, 1.6
_CYRILLIC_WORD = re.compile("[\u0400-\u052f]+")


def _same_case(text: str) -> bool:
    return text.islower() or text.isupper() or (text[:1].isupper() and text[1:].islower())


def _swap_is_sure(run: str, got: str, left: str, right: str, old: float, now: float) -> bool:
    letters = _LETTERS.findall(got)
    if len(letters) < 2 or len(letters) + sum(c in " .,-'ʻʼ" for c in got) < len(got):
        return False
    if _mixed(got, left, right):
        return False
    if not _same_case(got):
        return False
    pairs = len(got) + 1
    if _DRAWN.search(run) and len(set(got)) > 2 and now / pairs <= SWAP_LEFT and all(c in letters for c in got):
        return True
    gain = (old - now) / pairs
    cyrillic = all("\u0400" <= c <= "\u052f" for c in run)
    if old - now < SWAP_GAIN or gain < SWAP_PAIR:
        return False
    if cyrillic:
        if now / pairs > SWAP_LEFT:
            return False
        if len(got) < 4 or (len(got) < 5 and gain < SWAP_SHORT_PAIR):
            return False
        if got.isupper() and (len(got) < 6 or gain < SWAP_CAPITALS_PAIR):
            return False
        return True
    if any(not c.isalpha() and c.isprintable() and c != "\xa0" for c in run):  # signs amid letters, not mere blanks
        return now / pairs <= SWAP_SIGNS_LEFT
    return gain >= SWAP_SHORT_PAIR and now / pairs <= 1.3 * SWAP_LEFT


#: What one or two accented letters amid Latin ones must take away in improbability.
ACCENT_GAIN = 1.0
# Letters of other alphabets that look like Latin ones, so that they may be meant to.
_LOOKALIKES = set("аеѕіјкорсухһԛԝАВЕЅІЈКМНОРСТУХҺԚԜ" "αγικνορυχωΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "гզհոսօցյՍՕՏԼՀ")


def _accent_is_sure(run: str, got: str, left: str, right: str, old: float, now: float) -> bool:
    """Whether a short run inside a Latin word is its accented letters, read in another alphabet or as signs."""
    if len(run) > 2 or len(got) != len(run) or old - now < ACCENT_GAIN or not (_ascii_letter(left) or _ascii_letter(right)):
        return False
    if any(unicodedata.category(c) not in ("Lu", "Ll", "So", "Sm", "Sc", "No") for c in run):
        return False  # apostrophes, joiners and accents of their own
    if any(c in _LOOKALIKES or c < "\u0250" and c.isalpha() and c not in "ÞÐÝþðý" for c in run):
        return False
    return all("\xc0" <= c < "\u0180" and c.isalpha() for c in got)


def _ascii_letter(c: str) -> bool:
    return c.isascii() and c.isalpha()


def _mixed(got: str, left: str, right: str) -> bool:
    """Whether Cyrillic and Latin letters would meet in a word that was neither before."""
    return any("\u0400" <= c <= "\u052f" for c in got) and any(c.isalpha() and c < "\u0370" for c in got + left + right)


#: Values with none of these characters can't be garbled.
SUSPECT = "[^\\x09-\\x0d\\x1b-\\x7f\\u02bb\\u02bc]|\\p{L}\\?+\\p{L}"
_SCHEMA = "kind string, restored string, candidates array<string>"


def detect(df: DataFrame, scores: np.ndarray, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text was or may have been decoded wrongly, with ``restored``, ``kind`` and ``candidates``.

    ``kind`` is sure, swap or open, see :class:`Verdict`; ``restored`` is null where the text is
    lost or open. Columns of ``df`` are kept, but for those of these names, which are replaced.
    Null and empty texts are not garbled. Each batch judges its distinct values once.
    """
    held = df.sparkSession.sparkContext.broadcast(scores)
    rows = df.where(F.col(text_col).rlike(SUSPECT)).drop("restored", "kind", "candidates")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = Detector(held.value)
        for batch in batches:
            codes, values = pd.factorize(batch[text_col])
            verdicts = [detector.judge(v) for v in values]
            flag = np.fromiter((v.kind is not None for v in verdicts), dtype=bool, count=len(verdicts))[codes]
            kept = [verdicts[k] for k in codes[flag]]
            yield batch[flag].assign(**{c: pd.Series([getattr(v, c) for v in kept], index=batch.index[flag], dtype=object) for c in Verdict._fields})

    return rows.mapInPandas(judge, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", " + _SCHEMA)


def text_records(tokens: DataFrame, analyses: DataFrame) -> DataFrame:
    """The two text columns under one roof: (tbl, row_id, text)."""
    return tokens.select(F.lit("tokens").alias("tbl"), F.col("token_id").cast("long").alias("row_id"), F.col("text")).unionAll(
        analyses.select(F.lit("analyses").alias("tbl"), F.col("analysis_id").cast("long").alias("row_id"), F.col("original").alias("text"))
    )


def decide_swaps(judged: DataFrame, texts: DataFrame) -> DataFrame:
    """(text, restored) of the distinct texts of kind swap or open whose words' counts speak for a swap.

    Exact counts of the values of ``texts``, in small letters, by their own group-by: a garbled
    form isn't more common than the word it stands for (unless both are rare), and an open one must
    be far less common. Only distinct texts meet in these joins.
    """
    undecided = judged.where("kind != 'sure'").select("text", "kind", F.when(F.col("kind") == "swap", F.array("restored")).otherwise(F.col("candidates")).alias("words")).distinct()
    each = undecided.select("text", "kind", F.posexplode("words").alias("nth", "word")).withColumn("own_key", F.lower("text")).withColumn("word_key", F.lower("word"))
    wanted = each.select(F.explode(F.array("own_key", "word_key")).alias("key")).distinct()
    counts = texts.where(F.col("text").rlike(SUSPECT)).groupBy(F.lower("text").alias("key")).agg(F.count(F.lit(1)).alias("n")).join(wanted, "key", "left_semi")
    counts = materialise(counts, "word-counts")
    own, there = counts.select(F.col("key").alias("own_key"), F.col("n").alias("own")), counts.select(F.col("key").alias("word_key"), F.col("n").alias("there"))
    found = each.join(own, "own_key", "left").join(there, "word_key", "left").fillna(0, ["own", "there"])
    swap = (F.col("kind") == "swap") & (F.col("own") <= F.greatest(F.lit(RARE_RUN), F.col("there")))
    open_ = (F.col("kind") == "open") & (F.col("there") > COMMON_TIMES * F.col("own"))
    return found.where(swap | open_).groupBy("text").agg(F.min_by("word", "nth").alias("restored"))


def suspects(records: DataFrame, pattern: str) -> DataFrame:
    """The distinct texts that match ``pattern``, over all tasks: what is judged value by value is judged once."""
    return spread_by(records.where(F.col("text").rlike(pattern)).select("text").distinct(), "text")


def rows_of(records: DataFrame, pattern: str, judged: DataFrame) -> DataFrame:
    """The records whose text is in a written table of judged texts, with its columns, once per id."""
    side = F.broadcast(judged) if small_enough(judged, BROADCAST_BYTES) else judged
    return records.where(F.col("text").rlike(pattern)).join(side, "text").dropDuplicates(["tbl", "row_id"])


def find_garbled(records: DataFrame) -> DataFrame:
    """(tbl, row_id, text, restored) of every garbled record, once per id. Rows without an id are left out."""
    records = records.where("row_id is not null").select("tbl", "row_id", "text")
    texts = records.select("text")
    judged = materialise(detect(suspects(records, SUSPECT), pair_scores(texts)), "judged-values")
    garbled = judged.where("kind = 'sure'").select("text", "restored").unionByName(decide_swaps(judged, texts).select("text", "restored"))
    return rows_of(records, SUSPECT, materialise(garbled, "garbled-values")).select("tbl", "row_id", "text", "restored")
