"""Byte-pair encoding: counts, merges, segmentation, ids.

Counting is distributed. The merges are then found greedily, one at a time, always the most
frequent pair, ties by the left and then the right symbol. Up to ``DRIVER_WORDS`` distinct words
this runs on the driver over the counted words with incremental pair counts; beyond, each merge is
a pair count over the distributed words, whose lineage is cut in the shared folder.
"""

from __future__ import annotations

import heapq
import json
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qatlam.functions import text as T
from qatlam.session import file_exists, materialise, read_text, write_text
from qatlam.sources.tables import spread

# The special tokens and their ids.
SPECIALS = {"<pad>": 0, "<unk>": 1, "<bos>": 2, "<eos>": 3}
PAD, UNK, BOS, EOS = range(4)
#: Distinct words up to which merges are found on the driver, and merges between cuts of lineage beyond.
DRIVER_WORDS, CUT_EVERY = 2_000_000, 8


@dataclass
class Model:
    """Merges in order and ids by token."""

    vocab_size: int = 8000
    merges: list[tuple[str, str]] = field(default_factory=list)
    vocab: dict[str, int] = field(default_factory=lambda: dict(SPECIALS))
    special_tokens: dict[str, int] = field(default_factory=lambda: dict(SPECIALS))

    def __post_init__(self) -> None:
        if self.vocab_size < len(self.special_tokens):
            raise ValueError(f"a vocabulary of {self.vocab_size} can't hold the special tokens")

    def __len__(self) -> int:
        return len(self.vocab)

    def __contains__(self, token: str) -> bool:
        return token in self.vocab

    def __getitem__(self, item: str | int) -> int | str:
        if isinstance(item, int):
            for token, i in self.vocab.items():
                if i == item:
                    return token
            raise KeyError(item)
        return self.vocab[item]

    def add(self, token: str) -> None:
        if token not in self.vocab:
            self.vocab[token] = len(self.vocab)

    @property
    def ranks(self) -> dict[tuple[str, str], int]:
        return {pair: i for i, pair in enumerate(self.merges)}

    def merge_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, a, b, a + b) for i, (a, b) in enumerate(self.merges)], "rank int, left string, right string, merged string")

    def vocab_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.vocab.items()), "token string, id int")

    def save(self, path: str) -> None:
        """As JSON: version, model_type, vocab_size, special_tokens, vocab, merges."""
        kept = {"version": "1.0", "model_type": "bpe", "vocab_size": self.vocab_size, "special_tokens": self.special_tokens, "vocab": self.vocab, "merges": self.merges}
        write_text(path, [json.dumps(kept, ensure_ascii=False, indent=2)])

    @classmethod
    def load(cls, path: str) -> Model:
        if not file_exists(path):
            raise FileNotFoundError(f"no model file at {path}")
        try:
            data = json.loads(read_text(path))
        except ValueError as e:
            raise ValueError(f"{path} isn't JSON: {e}") from e
        if not isinstance(data, dict) or not {"vocab", "merges"} <= data.keys():
            raise ValueError(f"{path} has no vocab and merges")
        vocab = {str(k): int(v) for k, v in data["vocab"].items()}
        return cls(int(data.get("vocab_size", len(vocab))), [(a, b) for a, b in data["merges"]], vocab, data.get("special_tokens") or dict(SPECIALS))


# ------------------------------------------------------------------ counts
def word_counts(texts: DataFrame, text: str = "text", lowercase: bool = False, plain: bool = False) -> DataFrame:
    """(word, n) over the pre-tokens of all texts, or over words and single marks; null and empty texts count nothing."""
    t = F.lower(text) if lowercase else F.col(text)
    cut = T.words_and_marks(t) if plain else T.pre_tokens(t)
    return spread(texts.where(F.length(text) > 0).select(text)).select(F.explode(cut).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def base_characters(counts: DataFrame) -> DataFrame:
    """(ch): the distinct characters of the words, and the space, in code point order."""
    chars = counts.select(F.explode(T.characters("word")).alias("ch"))
    return chars.unionAll(counts.sparkSession.createDataFrame([(" ",)], "ch string")).distinct().orderBy("ch")


def _adjacent(pieces: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: F.struct(F.element_at(pieces, i).alias("left"), F.element_at(pieces, i + 1).alias("right")))


def pair_counts(split: DataFrame) -> DataFrame:
    """(left, right, n): how often pieces stand side by side in words (pieces, n)."""
    pairs = split.where(F.size("pieces") > 1).select("n", F.explode(_adjacent(F.col("pieces"))).alias("p"))
    return pairs.groupBy("p.left", "p.right").agg(F.sum("n").alias("n"))


def split_words(counts: DataFrame) -> DataFrame:
    return counts.select(T.characters("word").alias("pieces"), "n")


def best_pair(pairs: DataFrame, min_frequency: int = 1) -> DataFrame:
    return pairs.where(F.col("n") >= min_frequency).orderBy(F.desc("n"), "left", "right").limit(1)


def merge_pieces(pieces: Column, left: str, right: str) -> Column:
    """Every occurrence of the pair joined, from left to right."""
    a, b, joined = F.lit(left), F.lit(right), F.lit(left + right)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(False).alias("open"))

    def step(acc: Column, p: Column) -> Column:
        close = acc["open"] & (p == b)
        # a left piece waits, as the last one, for its right one; a joined piece waits for nothing
        done = F.when(close, F.concat(F.slice(acc["done"], 1, F.size(acc["done"]) - 1), F.array(joined))).otherwise(F.concat(acc["done"], F.array(p)))
        return F.struct(done.alias("done"), (~close & (p == a)).alias("open"))

    return F.aggregate(pieces, start, step, lambda acc: acc["done"])


# ------------------------------------------------------------------ training
def _merge(pieces: list[str], a: str, b: str) -> list[str]:
    out: list[str] = []
    waiting = False  # the last piece is a left one that may still be joined
    for p in pieces:
        if waiting and p == b:
            out[-1] = a + b
            waiting = False
        else:
            out.append(p)
            waiting = p == a
    return out


class _Greedy:
    """The pieces of all counted words as linked places, so that a merge changes its places' neighbours only.

    A pair's places are looked up lazily: a place that holds another pair by now is passed over. The
    most frequent pair is at the top of a heap, where outdated counts are passed over likewise.
    """

    def __init__(self, counts: Iterable[tuple[str, int]]):
        self.piece: list[str | None] = []
        self.weight: list[int] = []
        self.before: list[int] = []
        self.after: list[int] = []
        self.pairs: Counter[tuple[str, str]] = Counter()
        self.places: dict[tuple[str, str], list[int]] = defaultdict(list)
        for word, n in counts:
            first, last = len(self.piece), len(self.piece) + len(word) - 1
            for at, ch in enumerate(word, first):
                self.piece.append(ch)
                self.weight.append(n)
                self.before.append(at - 1 if at > first else -1)
                self.after.append(at + 1 if at < last else -1)
            for at, pair in enumerate(zip(word, word[1:], strict=False), first):
                self.pairs[pair] += n
                self.places[pair].append(at)
        self.heap = [(-n, *pair) for pair, n in self.pairs.items()]
        heapq.heapify(self.heap)

    def best(self) -> tuple[tuple[str, str], int] | None:
        while self.heap:
            n, a, b = self.heap[0]
            if n and self.pairs[a, b] == -n:
                return (a, b), -n
            heapq.heappop(self.heap)
        return None

    def join(self, pair: tuple[str, str]) -> None:
        left, right = pair
        joined = left + right
        touched: set[tuple[str, str]] = set()

        def count(p: tuple[str, str], n: int) -> None:
            self.pairs[p] += n
            touched.add(p)

        for at in sorted(self.places.pop(pair)):
            other = self.after[at]
            if self.piece[at] != left or other < 0 or self.piece[other] != right:
                continue
            n, prev, following = self.weight[at], self.before[at], self.after[other]
            count(pair, -n)
            if prev >= 0:
                count((self.piece[prev], left), -n)
                count((self.piece[prev], joined), n)
                self.places[self.piece[prev], joined].append(prev)
            if following >= 0:
                count((right, self.piece[following]), -n)
                count((joined, self.piece[following]), n)
                self.places[joined, self.piece[following]].append(at)
                self.before[following] = at
            self.piece[at], self.piece[other] = joined, None
            self.after[at] = following
        for p in touched:
            if self.pairs[p] > 0:
                heapq.heappush(self.heap, (-self.pairs[p], *p))
            else:
                del self.pairs[p]
                self.places.pop(p, None)


def train(texts: DataFrame, vocab_size: int = 8000, min_frequency: int = 2, text: str = "text", lowercase: bool = False, specials: list[str] | None = None, plain: bool = False, driver_words: int = DRIVER_WORDS) -> Model:
    """The model of a corpus. A corpus without words gives a model of the special tokens alone, one without a row is refused.

    With ``plain``, words and single marks are what pieces stay within, in place of pre-tokens.
    """
    if min_frequency < 1:
        raise ValueError(f"min_frequency must be positive, not {min_frequency}")
    names = {s: i for i, s in enumerate(specials)} if specials else dict(SPECIALS)
    model = Model(vocab_size, [], dict(names), dict(names))
    counts = materialise(word_counts(texts, text, lowercase, plain), "word-counts")
    if counts.isEmpty():
        if texts.isEmpty():
            raise ValueError("the training corpus is empty")
        return model
    for row in base_characters(counts).collect():  # at most the characters of Unicode
        if len(model) < vocab_size:
            model.add(row["ch"])
    if counts.count() <= driver_words:
        greedy = _Greedy((r["word"], r["n"]) for r in counts.orderBy("word").toLocalIterator())
        while len(model) < vocab_size and (top := greedy.best()) and top[1] >= min_frequency:
            model.merges.append(top[0])
            model.add("".join(top[0]))
            greedy.join(top[0])
        return model
    split = split_words(counts)
    while len(model) < vocab_size:
        found = best_pair(pair_counts(split), min_frequency).collect()
        if not found:
            break
        a, b = found[0]["left"], found[0]["right"]
        model.merges.append((a, b))
        model.add(a + b)
        # one reference to the pieces: the optimizer nests steps, and each further one would double them
        split = split.withColumn("pieces", merge_pieces(F.col("pieces"), a, b))
        if len(model.merges) % CUT_EVERY == 0:
            split = materialise(split, "split-words")
    return model


# ------------------------------------------------------------------ segmentation
def segment(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """The pieces of a word: the pair that was learned first is merged first, everywhere, until none is left."""
    pieces = list(word)
    while len(pieces) > 1:
        rank, pair = min((ranks.get(p, len(ranks)), p) for p in zip(pieces, pieces[1:], strict=False))
        if rank == len(ranks):
            break
        pieces = _merge(pieces, *pair)
    return pieces


def segment_column(df: DataFrame, column: str, model: Model, out: str = "pieces") -> DataFrame:
    """``df`` with the pieces of a string column, in Arrow batches. Meant for distinct words; null stays null.

    The model is broadcast: its size is bounded by ``vocab_size``.
    """
    held = df.sparkSession.sparkContext.broadcast(model.ranks)

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        ranks = held.value
        return s.map(lambda w: segment(w, ranks), na_action="ignore")

    return df.withColumn(out, cut(column))


#: Words whose pieces or ids a worker keeps at hand.
KEPT_WORDS = 500_000


def _remembered(make: Callable[[str], object]) -> Callable[[str], object]:
    """``make`` with its results kept: few words are most of a text."""
    kept: dict[str, object] = {}

    def get(word: str) -> object:
        found = kept.get(word)
        if found is None:
            if len(kept) >= KEPT_WORDS:
                kept.clear()
            found = kept[word] = make(word)
        return found

    return get


def tokenize(texts: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", with_space: bool = False) -> DataFrame:
    """(doc_id, pos, word, pieces) of every pre-token. One map: nothing is shuffled, a word is cut once by each worker."""
    held = texts.sparkSession.sparkContext.broadcast(model.ranks)  # its size is bounded by ``vocab_size``

    @F.pandas_udf("array<array<string>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ranks = held.value
        pieces = _remembered(lambda w: segment(w, ranks))
        for words in batches:
            yield words.map(lambda ws: [pieces(w) for w in ws])

    docs = spread(texts.where(F.col(text).isNotNull()).select(doc_id, text)).select(doc_id, T.pre_tokens(text, with_space).alias("word"))
    zipped = docs.select(doc_id, F.posexplode(F.arrays_zip("word", cut("word").alias("pieces"))).alias("pos", "x"))
    return zipped.select(doc_id, "pos", F.col("x").getField("word").alias("word"), F.col("x").getField("pieces").alias("pieces"))


def encode(texts: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", add_bos: bool = False, add_eos: bool = False) -> DataFrame:
    """(doc_id, ids) of every text; an empty or null text has only what is added around it; unknown pieces are 1.

    Blanks go character by character. One map, like :func:`tokenize`.
    """
    held = texts.sparkSession.sparkContext.broadcast((model.ranks, model.vocab))

    @F.pandas_udf("array<int>")
    def ids_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ranks, vocab = held.value
        ids = _remembered(lambda w: [vocab.get(p, UNK) for p in (w if w.isspace() else segment(w, ranks))])
        for words in batches:
            yield words.map(lambda ws: [i for w in ws for i in ids(w)])

    docs = spread(texts.select(doc_id, F.col(text).alias("__t")))
    around = ids_of(F.coalesce(T.pre_tokens("__t", True), F.array().cast("array<string>")))
    if add_bos:
        around = F.concat(F.array(F.lit(BOS)), around)
    if add_eos:
        around = F.concat(around, F.array(F.lit(EOS)))
    return docs.select(doc_id, around.alias("ids"))


def pad_batch(encoded: DataFrame, batch: str | None = None, max_length: int | None = None, pad: int = PAD, ids: str = "ids") -> DataFrame:
    """``encoded`` with its ids cut to ``max_length`` and padded to the longest of their batch (of all, without ``batch``)."""
    cut = encoded if max_length is None else encoded.withColumn(ids, F.slice(ids, 1, max_length))
    if batch is None:
        longest = cut.agg(F.coalesce(F.max(F.size(ids)), F.lit(0)).alias("__m"))
        sized = cut.crossJoin(F.broadcast(longest))
    else:
        longest = cut.groupBy(batch).agg(F.max(F.size(ids)).alias("__m"))
        sized = cut.join(longest, batch)
    return sized.withColumn(ids, F.concat(F.col(ids), F.array_repeat(F.lit(pad), F.col("__m") - F.size(ids)))).drop("__m")


def decode(encoded: DataFrame, vocab: DataFrame, doc_id: str = "doc_id", ids: str = "ids", skip_special: bool = True) -> DataFrame:
    """(doc_id, text): the tokens of the ids (token, id) put together; unknown ids read as <unk>. One row a row, in one map.

    Null ids read as an empty text. A vocabulary is as large as its parameter says, so it is broadcast.
    """
    names = {r["id"]: r["token"] for r in vocab.select("token", "id").collect()}
    if skip_special:
        names |= dict.fromkeys(SPECIALS.values(), "")
    held = encoded.sparkSession.sparkContext.broadcast(names)

    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = held.value
        for series in batches:
            yield series.map(lambda xs: "".join([names.get(i, "<unk>") for i in xs]))

    return encoded.select(doc_id, read(F.coalesce(ids, F.array().cast("array<int>"))).alias("text"))


def numbered_characters(counts: DataFrame) -> DataFrame:
    """(token, id): the special tokens and then the characters in code point order, numbered on."""
    spark = counts.sparkSession
    specials = spark.createDataFrame([(0, t, i) for t, i in SPECIALS.items()], "section int, token string, at int")
    chars = base_characters(counts).select(F.lit(1).alias("section"), F.col("ch").alias("token"), F.lit(0).alias("at"))
    order = Window.orderBy("section", "at", "token")
    return specials.unionAll(chars).select("token", (F.row_number().over(order) - 1).alias("id"))
