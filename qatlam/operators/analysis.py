"""Morphological analysis of words: recursive suffix stripping as one linear plan.

The search tree of a word is spread out level by level within its row, by a fold whose rounds add the
children of the states that the round before added; then each state becomes a row (what remains of
the word, and the path of the affixes stripped so far). There is no join and no shuffle in it.
A depth-first search visits states in the order of their paths, for an array sorts before its
extensions; so "the first hits" of the search are the first by path.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qatlam.operators.lookup import BROADCAST_BYTES, _side
from qatlam.sources import lexicon
from qatlam.sources.tables import small_enough, spread_by

#: An affix table is made part of the plan; a larger one is refused.
MAX_VARIANTS = 2_000
MAX_DEPTH, MIN_ROOT, UNKNOWN_DEPTH = 15, 2, 5

# Suffixes that need a stem in k or q, and those that can't follow one.
AFTER_K_OR_Q = ("qa", "qan", "qach", "ka", "kan", "kach")
NOT_AFTER_K_OR_Q = ("ga", "gan", "gach")


class Affixes:
    """The affix variants as a constant array, in the order in which they are tried (ordinals from 1)."""

    def __init__(self, table: DataFrame, order: str = "trie_ord", by: str = "ord"):
        rows = lexicon.affix_variants(table, by).orderBy(order).limit(MAX_VARIANTS + 1).collect()
        if len(rows) > MAX_VARIANTS:
            raise ValueError(f"more than {MAX_VARIANTS} affix variants")
        self.count = len(rows)

        entries = [
            {
                "ord": i, "text": r["variant"], "n": len(r["variant"]), "affix_id": r["affix_id"], "meaning_uz": r["meaning_uz"], "meaning_en": r["meaning_en"], "affix_type": r["affix_type"],
                "category": r["category"], "follows": r["follows"], "priority": r["priority"] or 0, "k_or_q": 1 if r["variant"] in AFTER_K_OR_Q else -1 if r["variant"] in NOT_AFTER_K_OR_Q else 0,
            }
            for i, r in enumerate(rows, 1)
        ]
        # a literal to the optimizer, and two nodes until then, in each of the many places it stands
        self.array = F.from_json(F.lit(json.dumps(entries)), self.SCHEMA)

    SCHEMA = (
        "array<struct<ord:int,text:string,n:int,affix_id:string,meaning_uz:string,meaning_en:string,affix_type:string,"
        "category:string,follows:array<string>,priority:int,k_or_q:int>>"
    )

    def at(self, ordinal: Column) -> Column:
        return F.get(self.array, ordinal - 1)


def default_affixes(spark: SparkSession, use_trie: bool = True) -> Affixes:
    return Affixes(lexicon.affixes(spark), "trie_ord" if use_trie else "lin_ord")


def allomorph_fits(stem: Column, k_or_q: Column) -> Column:
    """Whether a suffix with this demand can follow the stem."""
    hard = F.endswith(stem, F.lit("k")) | F.endswith(stem, F.lit("q"))
    return (k_or_q == 0) | ((k_or_q == 1) & hard) | ((k_or_q == -1) & ~hard)


def check_allomorphs(stem: Column, suffix: Column) -> Column:
    demand = F.when(suffix.isin(*AFTER_K_OR_Q), 1).when(suffix.isin(*NOT_AFTER_K_OR_Q), -1).otherwise(0)
    return allomorph_fits(stem, demand)


def check_order(right_follows: Column, category: Column) -> Column:
    """Whether a suffix of this category can stand before one that follows these categories."""
    return right_follows.isNull() | F.array_contains(right_follows, category)


def strip_states(words: DataFrame, affixes: Affixes, depth: int, min_root: int = MIN_ROOT, loose_depth: int = 0) -> DataFrame:
    """(word, rem, path, strict) of every state that stripping reaches in at most ``depth`` steps. ``words`` are distinct.

    A strict state came by suffixes that fit their stems. Down to ``loose_depth`` suffixes needn't.
    The levels are rounds of one fold over the word's states, so the plan stays as small at any depth.
    """
    levels = max(depth, loose_depth)
    start = F.array(F.struct(F.col("word").alias("rem"), F.array().cast("array<int>").alias("path"), F.lit(None).cast("array<string>").alias("follows"), F.lit(True).alias("strict")))

    def children(s: Column, level: Column) -> Column:
        left = F.length(s["rem"])

        def strict(v: Column) -> Column:
            return s["strict"] & allomorph_fits(F.substring(s["rem"], F.lit(1), left - v["n"]), v["k_or_q"])

        def fits(v: Column) -> Column:
            ok = (left - v["n"] >= min_root) & F.endswith(s["rem"], v["text"]) & check_order(s["follows"], v["category"])
            return ok & ((level < loose_depth) | strict(v))

        def child(v: Column) -> Column:
            return F.struct(F.substring(s["rem"], F.lit(1), left - v["n"]).alias("rem"), F.concat(s["path"], F.array(v["ord"])).alias("path"), v["follows"].alias("follows"), strict(v).alias("strict"))

        return F.transform(F.filter(affixes.array, fits), child)

    def round_(acc: Column, level: Column) -> Column:
        last = F.filter(acc, lambda s: (F.size(s["path"]) == level) & (F.length(s["rem"]) > min_root) & (s["strict"] | (level < loose_depth)))
        return F.concat(acc, F.flatten(F.transform(last, lambda s: children(s, level))))

    states = F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), start, round_) if levels > 0 else start
    return words.select("word", F.explode(states).alias("s")).select("word", "s.rem", "s.path", "s.strict")


def _confidence(root: Column, path: Column, affixes: Affixes, found: bool) -> Column:
    """The score, its additions in the order in which suffixes were stripped."""
    length = F.least(F.lit(0.3), F.length(root) * F.lit(0.05))
    n = F.size(path)
    base = (F.lit(0.5) + length if found else length) + F.when(n == 0, F.lit(0.2)).when(n <= 2, F.lit(0.15)).when(n <= 4, F.lit(0.1)).otherwise(F.lit(0.0))
    return F.aggregate(path, base, lambda acc, o: acc + affixes.at(o)["priority"] * F.lit(0.001))


def _suffixes(path: Column, affixes: Affixes) -> Column:
    """The stripped suffixes from left to right."""

    def plain(o: Column) -> Column:
        v = affixes.at(o)
        return F.struct(v["text"].alias("text"), v["affix_id"].alias("affix_id"), v["meaning_uz"].alias("meaning_uz"), v["meaning_en"].alias("meaning_en"), v["affix_type"].alias("affix_type"), v["category"].alias("category"))

    return F.transform(F.reverse(path), plain)


def stem_candidates(rem: Column, path: Column) -> Column:
    """What the remaining string may stand for, in order of preference: itself, and after a suffix its restored forms."""
    changes = F.create_map(*(F.lit(x) for pair in lexicon.SOUND_CHANGES.items() for x in pair))
    stripped = F.size(path) > 0
    short = F.length(rem)
    options = F.array(
        F.struct(F.lit(0).alias("form"), rem.alias("stem")),
        F.struct(F.lit(1).alias("form"), F.when(stripped, F.try_element_at(changes, rem)).alias("stem")),
        F.struct(F.lit(2).alias("form"), F.when(stripped & (F.endswith(rem, F.lit("gʻ")) | F.endswith(rem, F.lit("g'"))), F.concat(F.substring(rem, F.lit(1), short - 2), F.lit("q"))).alias("stem")),
        F.struct(F.lit(3).alias("form"), F.when(stripped & F.endswith(rem, F.lit("g")), F.concat(F.substring(rem, F.lit(1), short - 1), F.lit("k"))).alias("stem")),
    )
    return F.filter(options, lambda x: x["stem"].isNotNull())


#: Forms beyond those of stems: a remainder that is a root unknown to the dictionary, and the bare word.
_UNKNOWN, _BARE = 8, 9


def _search(words: DataFrame, stems: DataFrame | None, affixes: Affixes, max_results: int, max_depth: int, min_root: int, bare: bool) -> DataFrame:
    """(word, rank, root, path, is_found, confidence): known roots, else unknown ones, else, if asked for, the bare word.

    All three come from one pass over the states. The distinct words are spread over all tasks, and
    what follows needs no other shuffle if the dictionary is small enough to broadcast.
    """
    distinct = spread_by(words.select("word").where("word is not null").distinct(), "word")
    states = strip_states(distinct, affixes, max_depth if stems is not None else 0, min_root, UNKNOWN_DEPTH)
    depth = F.size("path")
    rest = [
        F.struct(F.lit(_UNKNOWN).alias("form"), F.when((depth > 0) & (depth <= UNKNOWN_DEPTH), F.col("rem")).alias("stem")),
        F.struct(F.lit(_BARE).alias("form"), F.when((depth == 0) & F.lit(bare), F.col("rem")).alias("stem")),
    ]
    options = F.filter(F.array(*rest), lambda x: x["stem"].isNotNull())
    if stems is not None:
        options = F.concat(F.when(F.col("strict"), stem_candidates(F.col("rem"), F.col("path"))).otherwise(F.filter(F.array(*rest), lambda x: F.lit(False))), options)
    rows = states.withColumn("x", F.explode(options)).select("word", "path", "x.form", "x.stem")
    known = F.col("form") < _UNKNOWN
    if stems is not None:
        # rows that need no stem carry a key of their own, so that they don't meet in one task
        side = _side(stems.select(F.col("stem").alias("__key"), F.lit(True).alias("__in")).distinct())
        rows = rows.withColumn("__key", F.when(known, F.col("stem")).otherwise(F.concat(F.lit("\x00"), F.col("word")))).join(side, "__key", "left").where(~known | F.col("__in")).drop("__key", "__in")
        if not small_enough(stems, BROADCAST_BYTES):
            rows = rows.repartition("word")
    rows = rows.withColumn("is_found", known)
    first_form = Window.partitionBy("word", "is_found", "path").orderBy("form")
    rows = rows.withColumn("nth", F.row_number().over(first_form)).where(~known | (F.col("nth") == 1)).withColumnRenamed("stem", "root")
    leftmost = affixes.at(F.element_at("path", -1))["k_or_q"]
    rows = rows.where(~known | (depth == 0) | allomorph_fits(F.col("root"), F.when(depth > 0, leftmost).otherwise(0)))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("word", "is_found").orderBy("path"))).where(~known | (F.col("nth") <= 2 * max_results))
    rows = rows.withColumn("best", F.max("is_found").over(Window.partitionBy("word"))).where("is_found = best")
    score = F.when(known, _confidence(F.col("root"), F.col("path"), affixes, True)).when(F.col("form") == _BARE, F.lit(0.0)).otherwise(_confidence(F.col("root"), F.col("path"), affixes, False))
    rows = rows.withColumn("confidence", score)
    by_confidence = Window.partitionBy("word").orderBy(F.desc("confidence"), "path")
    return rows.withColumn("rank", F.row_number().over(by_confidence)).where(F.col("rank") <= max_results).select("word", "rank", "root", "path", "is_found", "confidence")


def _shown(found: DataFrame, affixes: Affixes, *more: str) -> DataFrame:
    return found.select("word", *more, "root", _suffixes(F.col("path"), affixes).alias("suffixes"), "is_found", F.lit(False).alias("is_compound"), "confidence")


def unknown_analyses(words: DataFrame, affixes: Affixes, max_results: int = 5, min_root: int = MIN_ROOT) -> DataFrame:
    """Analyses with any remainder for a root, at most five suffixes deep."""
    return _shown(_search(words, None, affixes, max_results, 0, min_root, False), affixes, "rank")


def analyze_all(words: DataFrame, stems: DataFrame, affixes: Affixes, max_results: int = 5, max_depth: int = MAX_DEPTH, min_root: int = MIN_ROOT) -> DataFrame:
    """All analyses of the distinct words (column ``word``, in dictionary spelling), best first.

    (word, rank, root, suffixes, is_found, is_compound, confidence). Words without any analysis give
    no row; null words are left out.
    """
    return _shown(_search(words, stems, affixes, max_results, max_depth, min_root, False), affixes, "rank")


def analyze(words: DataFrame, stems: DataFrame, affixes: Affixes, max_depth: int = MAX_DEPTH, min_root: int = MIN_ROOT) -> DataFrame:
    """The analysis of each distinct word: the better of the first two, or the word itself with confidence 0."""
    return _shown(_search(words, stems, affixes, 1, max_depth, min_root, True), affixes)


def suffix_chain(suffixes: Column) -> Column:
    """The suffixes with their meanings, as one string."""
    return F.array_join(F.transform(suffixes, lambda s: F.concat(F.lit("+"), s["text"], F.lit("("), s["meaning_uz"], F.lit(")"))), " -> ")


def analysis_record() -> Column:
    """An analysis as a nested record: original, root, status, is_compound, confidence, suffixes, suffix_chain."""
    renamed = F.transform("suffixes", lambda s: F.struct(s["text"].alias("text"), s["affix_id"].alias("id"), s["meaning_uz"].alias("meaning_uz"), s["meaning_en"].alias("meaning_en"), s["affix_type"].alias("type"), s["category"].alias("category")))
    return F.struct(
        F.col("word").alias("original"), "root", F.when(F.col("is_found"), "found").otherwise("unknown").alias("status"), "is_compound",
        F.round("confidence", 3).alias("confidence"), renamed.alias("suffixes"), suffix_chain(F.col("suffixes")).alias("suffix_chain"),
    )
