"""Problem 3's queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qatlam.operators.balance import fragment_replicate_join, key_summary
from qatlam.session import materialise
from qatlam.sources.tables import table


def _by_root(spark: SparkSession, d: str) -> DataFrame:
    return key_summary(table(spark, d, "analyses"), "root", "analysis_id", "run_id", "confidence", "loaded_at")


def _by_type(spark: SparkSession, d: str) -> DataFrame:
    return key_summary(table(spark, d, "tokens"), "token_type", "token_id", "run_id", None, "loaded_at")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    roots, types = key_summary(table(spark, d, "analyses"), "root", "analysis_id"), key_summary(table(spark, d, "tokens"), "token_type", "token_id")
    both = roots.select(F.lit("root").alias("field"), F.col("root").alias("item"), "ids").unionAll(types.select(F.lit("token_type").alias("field"), F.col("token_type").alias("item"), "ids"))
    both = materialise(both, "key-counts")  # a row for each value, read twice
    # an id has one value, so the values' ids add up to the ids; the two sums are one row for each field
    totals = both.groupBy("field").agg(F.sum("ids").alias("all_ids"))
    return both.join(F.broadcast(totals), "field").where("ids * 20 >= all_ids").select("field", "item")


def p3_roots(spark: SparkSession, d: str) -> DataFrame:
    return _by_root(spark, d)


def p3_token_types(spark: SparkSession, d: str) -> DataFrame:
    return _by_type(spark, d)


def p3_known_roots(spark: SparkSession, d: str) -> DataFrame:
    """By source of the run, how many analyses have a root that is in the dictionary."""
    analyses = table(spark, d, "analyses").where("analysis_id is not null").select("analysis_id", "run_id", "root").distinct()
    stems = table(spark, d, "stems").where("stem is not null").select(F.col("stem").alias("root")).distinct()
    known = fragment_replicate_join(analyses, stems, "root", F.col("analysis_id"))
    return known.groupBy("run_id").agg(F.count(F.lit(1)).alias("known"), F.count_distinct("root").alias("roots"))


QUERIES = {q.__name__: q for q in (p3_found, p3_roots, p3_token_types, p3_known_roots)}

_ROOTS = """r AS (SELECT analysis_id, run_id, root, confidence, max(loaded_at) AS loaded_at FROM analyses
  WHERE root IS NOT NULL AND analysis_id IS NOT NULL GROUP BY ALL)"""
_TYPES = """t AS (SELECT token_id, run_id, token_type, max(loaded_at) AS loaded_at FROM tokens
  WHERE token_type IS NOT NULL AND token_id IS NOT NULL GROUP BY ALL)"""

SQL = {
    "p3_found": f"""WITH {_ROOTS}, {_TYPES},
        c AS (SELECT 'root' AS field, root AS item, count(DISTINCT analysis_id) AS n, (SELECT count(DISTINCT analysis_id) FROM r) AS total FROM r GROUP BY root
              UNION ALL SELECT 'token_type', token_type, count(DISTINCT token_id), (SELECT count(DISTINCT token_id) FROM t) FROM t GROUP BY token_type)
        SELECT field, item FROM c WHERE n * 20 >= total""",
    "p3_roots": f"""WITH {_ROOTS} SELECT root, count(DISTINCT analysis_id) AS ids, count(DISTINCT run_id) AS records,
        round(sum(confidence::DECIMAL(18,6))::DOUBLE / nullif(count(confidence), 0), 6) AS mean_confidence, max(loaded_at) AS latest_loaded_at FROM r GROUP BY root""",
    "p3_token_types": f"""WITH {_TYPES} SELECT token_type, count(DISTINCT token_id) AS ids, count(DISTINCT run_id) AS records,
        max(loaded_at) AS latest_loaded_at FROM t GROUP BY token_type""",
    "p3_known_roots": """SELECT run_id, count(*) AS known, count(DISTINCT root) AS roots FROM (
        SELECT DISTINCT analysis_id, run_id, root FROM analyses WHERE analysis_id IS NOT NULL AND root IN (SELECT stem FROM stems)) GROUP BY run_id""",
}
