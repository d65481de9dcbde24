"""Suffix, prefix and membership lookups as equi-joins.

A join on "ends with" or "starts with" would be planned as a nested loop. The words' own suffixes
or prefixes up to the longest key are generated instead and joined on equality, which hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qatlam.sources.tables import small_enough

#: A key table estimated below this in memory is broadcast; a larger one is shuffled.
BROADCAST_BYTES = 96 << 20


def _side(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if small_enough(keys, BROADCAST_BYTES) else keys


def find_suffixes(words: DataFrame, suffixes: DataFrame, longest: int, word: str = "word", suffix: str = "suffix") -> DataFrame:
    """``words`` with each row of ``suffixes`` that ends the word, one row a match; no key is longer than ``longest``.

    Words that are null, or end in no suffix, give no row. Order by length, longest first.
    """
    lengths = F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length(word))))
    ends = words.where(F.length(word) > 0).withColumn("__n", lengths).withColumn(suffix, F.expr(f"right(`{word}`, `__n`)")).drop("__n")
    return ends.join(_side(suffixes), suffix)


def find_prefixes(words: DataFrame, stems: DataFrame, longest: int | None = None, word: str = "word", stem: str = "stem") -> DataFrame:
    """``words`` with each stem that begins the word, one row a match; no stem is longer than ``longest`` (found if not given)."""
    most = F.least(F.lit(longest_key(stems, stem) if longest is None else longest), F.length(word))
    begins = words.where((F.length(word) > 0) & (most > 0)).withColumn("__n", F.explode(F.sequence(F.lit(1), most))).withColumn(stem, F.expr(f"left(`{word}`, `__n`)")).drop("__n")
    return begins.join(_side(stems), stem)


def longest_key(keys: DataFrame, key: str) -> int:
    """The length of the longest key, 0 without any: one aggregate, so that no word is cut into more pieces than can match."""
    return keys.agg(F.coalesce(F.max(F.length(key)), F.lit(0))).first()[0]


def longest_prefix(words: DataFrame, stems: DataFrame, word: str = "word", stem: str = "stem") -> DataFrame:
    """(word, stem): the longest stem that begins each distinct word; null where none does."""
    distinct = words.select(word).where(F.col(word).isNotNull()).distinct()
    best = find_prefixes(distinct, stems.select(stem).distinct(), None, word, stem).groupBy(word).agg(F.max_by(stem, F.length(stem)).alias(stem))
    return distinct.join(best, word, "left")


def words_with_prefix(stems: DataFrame, prefix: str, limit: int = 100, stem: str = "stem") -> DataFrame:
    """The first ``limit`` stems, in code point order, that begin with ``prefix``; none if the limit isn't positive."""
    return stems.select(stem).where(F.col(stem).startswith(prefix)).distinct().orderBy(stem).limit(max(0, limit))


def starts_with(stems: DataFrame, prefix: str, stem: str = "stem") -> bool:
    """Whether any stem begins with ``prefix``; for an empty one, whether there is a stem."""
    return not stems.where(F.col(stem).startswith(prefix)).limit(1).isEmpty()


def membership(words: DataFrame, stems: DataFrame, word: str = "word", stem: str = "stem") -> DataFrame:
    """``words`` with ``found``; repeated words stay, a null word is not found."""
    known = stems.select(F.col(stem).alias(word), F.lit(True).alias("__in")).distinct()
    return words.drop("found").join(_side(known), word, "left").withColumn("found", F.col("__in").isNotNull()).drop("__in")


def known_words(words: DataFrame, stems: DataFrame, word: str = "word", stem: str = "stem") -> DataFrame:
    return words.join(_side(stems.select(F.col(stem).alias(word)).distinct()), word, "left_semi")


def unknown_words(words: DataFrame, stems: DataFrame, word: str = "word", stem: str = "stem") -> DataFrame:
    return words.join(_side(stems.select(F.col(stem).alias(word)).distinct()), word, "left_anti")


def insert_keys(index: DataFrame, items: DataFrame, key: str = "key", payload: str = "payload") -> DataFrame:
    """An index (key, payloads) with items (key, payload) added: payloads of a key add up in order of the payload's text."""
    old = index.select(key, F.explode_outer("payloads").alias(payload))
    return old.unionByName(items.select(key, payload)).groupBy(key).agg(F.sort_array(F.collect_list(payload)).alias("payloads"))


def get_payloads(keys: DataFrame, index: DataFrame, key: str = "key") -> DataFrame:
    """``keys`` with their payloads, null for a key that isn't there."""
    return keys.join(_side(index.select(key, "payloads")), key, "left")


def iterate_suffixes(suffixes: DataFrame, suffix: str = "suffix") -> DataFrame:
    """The distinct keys in the order of their reversed strings."""
    return suffixes.select(suffix).distinct().orderBy(F.reverse(suffix))


def suffixes_and_completions(words: DataFrame, keys: DataFrame, longest: int, word: str = "word", key: str = "key") -> DataFrame:
    """(word, match, kind): keys that end the word, and what completes the word to a key.

    The word itself, if it is a key, counts only when no longer key begins with it. Completions are
    found by joining the keys' proper prefixes with the words. Distinct words, distinct matches.
    """
    distinct = words.select(word).where(F.length(word) > 0).distinct()
    named = keys.select(F.col(key).alias("__key")).where(F.length("__key") > 0).distinct()
    begins = named.where("length(__key) > 1").withColumn("__n", F.explode(F.sequence(F.lit(1), F.length("__key") - 1))).select(F.expr("left(__key, __n)").alias(word), F.expr("substring(__key, __n + 1)").alias("match"))
    completed = distinct.join(begins, word).select(word, "match", F.lit("completion").alias("kind"))
    ends = find_suffixes(distinct, named, longest, word, "__key").select(word, F.col("__key").alias("match"))
    whole = ends.where(F.col(word) == F.col("match")).join(completed.select(word).distinct(), word, "left_anti")
    parts = ends.where(F.col(word) != F.col("match"))
    suffix_rows = parts.unionAll(whole).select(word, "match", F.lit("suffix").alias("kind"))
    # a completion that is a suffix already is listed once
    return suffix_rows.unionAll(completed.join(suffix_rows.select(word, "match"), [word, "match"], "left_anti")).distinct()


def payload_order(matches: DataFrame, word: str = "word") -> DataFrame:
    """Matches with ``rank`` in the order they are tried: longest first, then ``trie_ord``."""
    return matches.withColumn("rank", F.row_number().over(Window.partitionBy(word).orderBy("trie_ord")))
