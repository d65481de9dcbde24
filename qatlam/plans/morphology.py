"""Queries over word analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qatlam.operators import analysis as A
from qatlam.plans import fragments as S
from qatlam.plans.lexical import new_file, stems, words
from qatlam.sources.tables import table
from qatlam.tokenizer import Tokenizer


def _ids(suffixes: str = "suffixes") -> Column:
    return F.array_join(F.transform(suffixes, lambda s: s["affix_id"]), " ")


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumn("affixes", _ids()).withColumn("chain", A.suffix_chain(F.col("suffixes"))).drop("suffixes", "is_compound")


def analyze_best(spark: SparkSession, d: str) -> DataFrame:
    return _plain(A.analyze(words(spark, d), stems(spark, d), A.default_affixes(spark)))


def analyze_best_linear(spark: SparkSession, d: str) -> DataFrame:
    """The same with candidates in the order of a linear scan."""
    return _plain(A.analyze(words(spark, d), stems(spark, d), A.default_affixes(spark, use_trie=False)))


def analyze_topk(spark: SparkSession, d: str) -> DataFrame:
    return _plain(A.analyze_all(words(spark, d), stems(spark, d), A.default_affixes(spark), max_results=5))


def oov_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Analyses without any dictionary: every remainder may be a root."""
    return _plain(A.unknown_analyses(words(spark, d), A.default_affixes(spark), max_results=5)).drop("is_found")


def analysis_records(spark: SparkSession, d: str) -> DataFrame:
    """The best analysis as a nested record, its parts read back."""
    best = A.analyze(words(spark, d), stems(spark, d), A.default_affixes(spark)).withColumn("r", A.analysis_record())
    return best.select("word", "r.status", "r.confidence", "r.suffix_chain", F.size("r.suffixes").alias("n_suffixes"))


def strip_depths(spark: SparkSession, d: str) -> DataFrame:
    """How many states the search reaches at each depth, for each word."""
    states = A.strip_states(words(spark, d), A.default_affixes(spark), A.MAX_DEPTH)
    return states.groupBy("word", F.size("path").alias("depth")).agg(F.count(F.lit(1)).alias("states"))


def tokenizer_folder(spark: SparkSession, d: str) -> DataFrame:
    """A tokenizer saved and loaded again: the best analysis that what was loaded gives each word."""
    path = new_file(spark, "tokenizer")
    Tokenizer(spark, table(spark, d, "stems")).save(path)
    return _plain(Tokenizer.load(spark, path).analyze(words(spark, d)))


QUERIES = {q.__name__: q for q in (analyze_best, tokenizer_folder, analyze_best_linear, analyze_topk, oov_analysis, analysis_records, strip_depths)}

_CHAIN = "array_to_string(list_transform(list_reverse(path), lambda o: '+' || texts[o] || '(' || meanings[o] || ')'), ' -> ')"
_IDS_OF = "array_to_string(list_transform(list_reverse(path), lambda o: ids[o]), ' ')"


def _with(order: str, k: int) -> str:
    return f"WITH RECURSIVE {S.variants()}, {S.STEMS}, {S.WORDS}, {S.analysis(order, k)}, names AS ({S.IDS.format(order=order)})"


def _best(order: str) -> str:
    return f"""{_with(order, 1)} SELECT w.word, coalesce(root, w.word) AS root, coalesce(found, FALSE) AS is_found, coalesce(confidence, 0) AS confidence,
        coalesce({_IDS_OF}, '') AS affixes, coalesce({_CHAIN}, '') AS chain FROM words w LEFT JOIN analyses_found a ON w.word = a.word, names"""


SQL = {
    "analyze_best": _best("trie_ord"),
    "tokenizer_folder": _best("trie_ord"),
    "analyze_best_linear": _best("lin_ord"),
    "analyze_topk": f"{_with('trie_ord', 5)} SELECT word, rank::INTEGER AS rank, root, found AS is_found, confidence, {_IDS_OF} AS affixes, {_CHAIN} AS chain FROM analyses_found, names",
    "oov_analysis": f"""WITH RECURSIVE {S.variants()}, stem_list AS (SELECT '' AS stem WHERE FALSE), {S.WORDS}, {S.analysis('trie_ord', 5)}, names AS ({S.IDS.format(order='trie_ord')})
        SELECT word, rank::INTEGER AS rank, root, confidence, {_IDS_OF} AS affixes, {_CHAIN} AS chain FROM analyses_found, names""",
    "analysis_records": f"""{_with('trie_ord', 1)} SELECT w.word, CASE WHEN found THEN 'found' ELSE 'unknown' END AS status, round(coalesce(confidence, 0), 3) AS confidence,
        coalesce({_CHAIN}, '') AS suffix_chain, coalesce(len(path), 0)::INTEGER AS n_suffixes FROM words w LEFT JOIN analyses_found a ON w.word = a.word, names""",
    "strip_depths": f"{_with('trie_ord', 1)} SELECT word, len(path)::INTEGER AS depth, count(*) AS states FROM state GROUP BY ALL",
}
