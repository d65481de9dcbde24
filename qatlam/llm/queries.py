"""The queries of the training-data operators, each over its whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qatlam.llm import encoding, frequency, heavy_hitters, leaks, packing, sentences, visual
from qatlam.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _terms(spark: SparkSession, d: str) -> DataFrame:
    occ = frequency.occurrences(table(spark, d, "tokens"), table(spark, d, "analyses"), table(spark, d, "morph_tokens"))
    return frequency.marked_frequencies(occ, table(spark, d, "runs"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).where("mark is not null").select("field", "term", "mark")


def p1_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).select("field", "term", "occurrences", "records", "mark")


def _records(spark: SparkSession, d: str) -> DataFrame:
    return encoding.text_records(table(spark, d, "tokens"), table(spark, d, "analyses"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return visual.find_unusual(_records(spark, d)).select("tbl", "row_id")


def p2_variants(spark: SparkSession, d: str) -> DataFrame:
    """Each comparison form with its number of spellings and rows."""
    return visual.spelling_variants(_records(spark, d)).select("form", "spellings", "records")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = heavy_hitters.value_rows(table(spark, d, "tokens"), table(spark, d, "analyses"))
    return heavy_hitters.frequent_values(rows, percent=1).select("field", "item")


def p4_top(spark: SparkSession, d: str) -> DataFrame:
    rows = heavy_hitters.value_rows(table(spark, d, "tokens"), table(spark, d, "analyses"))
    return heavy_hitters.top_values(rows, k=100)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.find_garbled(_records(spark, d)).select("tbl", "row_id")


def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.find_garbled(_records(spark, d)).select("tbl", "row_id", "text", "restored")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_specs"))


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p6_waste(spark: SparkSession, d: str) -> DataFrame:
    return packing.waste(_packed(spark, d), table(spark, d, "pack_specs"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).where("not reparameterised").select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """By item, its task and split, and the documents it leaked into."""
    found = leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    by_item = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if("reparameterised").alias("reparameterised"), F.max("agreeing").alias("longest"))
    items = table(spark, d, "eval_items").select(F.col("item_id").cast("long").alias("item_id"), "task", "split").distinct()
    return items.join(by_item, "item_id", "left").select("item_id", "task", "split", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("reparameterised", F.lit(0)).alias("reparameterised"), F.coalesce("longest", F.lit(0)).alias("longest"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(table(spark, d, "documents"), lang_col="lang")


def p8_per_document(spark: SparkSession, d: str) -> DataFrame:
    """By document, its sentences and the characters in them."""
    found = sentences.split_sentences(table(spark, d, "documents"), lang_col="lang")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.col("end_char") - F.col("start_char")).alias("chars"))


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (p1_found, p1_frequencies, p2_found, p2_variants, p4_found, p4_top, p5_found, p5_restored, p6_packed, p6_waste, p7_found, p7_leaks, p8_found, p8_per_document)
}

_OCCURRENCES = """
occ AS (
  SELECT DISTINCT 'root' AS field, root AS term, run_id, analysis_id AS id, 0 AS part FROM analyses
  UNION ALL
  SELECT DISTINCT 'subtoken', u.term, run_id, token_id, u.part FROM (
    SELECT run_id, token_id, unnest(subtokens) AS term, generate_subscripts(subtokens, 1) AS part FROM tokens WHERE subtokens IS NOT NULL) u
  UNION ALL
  SELECT DISTINCT 'affix_id', affix_id, run_id, analysis_id, suffix_pos FROM morph_tokens),
freq AS (
  SELECT field, term, count(*) AS occurrences, count(DISTINCT run_id) AS records FROM occ
  WHERE term IS NOT NULL AND term <> '' GROUP BY field, term),
marked AS (
  SELECT *, CASE WHEN records <= 2 THEN 'rare'
                 WHEN records * 100 > 30 * (SELECT count(DISTINCT run_id) FROM runs) THEN 'common' END AS mark FROM freq)
"""

_VALUES = """
v AS (SELECT DISTINCT 'text' AS field, token_id AS id, text AS item FROM tokens WHERE text IS NOT NULL AND token_id IS NOT NULL
      UNION ALL
      SELECT DISTINCT 'root', analysis_id, root FROM analyses WHERE root IS NOT NULL AND analysis_id IS NOT NULL),
c AS (SELECT field, item, count(*) AS ids FROM v GROUP BY field, item)
"""

SQL: dict[str, str] = {
    "p1_found": f"WITH {_OCCURRENCES} SELECT field, term, mark FROM marked WHERE mark IS NOT NULL",
    "p1_frequencies": f"WITH {_OCCURRENCES} SELECT field, term, occurrences, records, mark FROM marked",
    "p4_found": f"WITH {_VALUES}, n AS (SELECT field, count(*) AS n FROM v GROUP BY field) SELECT c.field, item FROM c JOIN n ON c.field = n.field WHERE ids * 100 >= n.n",
    "p4_top": f"""WITH {_VALUES} SELECT field, item, ids, rank::INTEGER AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY field ORDER BY ids DESC, item) AS rank FROM c) WHERE rank <= 100""",
}
