"""Problem 1: how often every distinct term occurs, and in how many records.

Heavy-light aggregation. A sketch over all rows names the terms that may be heavy; the choice only
steers the work, for both kinds are then counted exactly:

* *heavy* terms (a few for each partition of a shuffle) are broadcast and become slot numbers. Their
  rows shuffle as fixed-width numbers spread over all tasks, since a repeated row must be told by
  its id, and end in each task's counters by slot: at most a row for each slot and task meets in the
  last exchange. The terms themselves, which may be long, stay where they are.
* *light* terms shuffle once, by term. None of them holds more than a small share of the rows, and
  that one exchange serves taking out repeats, counting records and counting terms.

The two count tables are then put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms counted by slot at least, slots for each partition of a shuffle, and the sketch's counters for each slot: a
#: term that alone would make a task twice as long as the others gets a slot, whatever the size of the cluster.
LEAST_SLOTS, SLOTS_A_PARTITION, COUNTERS_A_SLOT = 512, 4, 16
#: A longer term goes by its digest, so that the broadcast side has a bounded size.
KEY_CHARS = 64


def occurrences(tokens: DataFrame, analyses: DataFrame, morph_tokens: DataFrame) -> DataFrame:
    """The terms of the three fields as (field, term, record, id, part); null and empty terms are left out."""
    roots = analyses.select(F.lit("root").alias("field"), F.col("root").alias("term"), F.col("run_id").alias("record"), F.col("analysis_id").alias("id"), F.lit(0).alias("part"))
    subtokens = tokens.where("subtokens is not null").select(F.lit("subtoken").alias("field"), F.col("run_id").alias("record"), F.col("token_id").alias("id"), F.posexplode("subtokens").alias("part", "term")).select("field", "term", "record", "id", "part")
    affixes = morph_tokens.select(F.lit("affix_id").alias("field"), F.col("affix_id").alias("term"), F.col("run_id").alias("record"), F.col("analysis_id").alias("id"), F.col("suffix_pos").alias("part"))
    return roots.unionAll(subtokens).unionAll(affixes).where("term is not null and term != ''")


def _slots(occ: DataFrame) -> int:
    return max(LEAST_SLOTS, SLOTS_A_PARTITION * int(occ.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _key() -> Column:
    """A term with its field, in a bounded number of characters."""
    short = F.when(F.length("term") <= KEY_CHARS, F.concat(F.lit("="), "term")).otherwise(F.concat(F.lit("#"), F.sha2("term", 256)))
    return F.concat_ws("\x01", F.col("field"), short)


def heavy_terms(occ: DataFrame) -> DataFrame:
    """(slot, key, field, term) of the terms that may be heavy, see :func:`_key`: rows of bounded number and length.

    ``term`` is null for a term that goes by its digest.
    """
    spark, slots = occ.sparkSession, _slots(occ)
    found = occ.select(_key().alias("key")).agg(F.expr(f"approx_top_k(key, {slots}, {COUNTERS_A_SLOT * slots})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    least = max(2, found["n"] // (4 * slots))
    keys = [x["item"] for x in (found["top"] or []) if x["count"] >= least]
    parts = [(i, k, *k.split("\x01", 1)) for i, k in enumerate(keys)]
    return spark.createDataFrame([(i, k, f, t[1:] if t[0] == "=" else None) for i, k, f, t in parts], "slot int, key string, field string, term string")


def term_frequencies(occ: DataFrame) -> DataFrame:
    """(field, term, occurrences, records): exact counts, each (id, part) counted once.

    A null record counts as an occurrence but as no record. Repeated rows count once. An empty
    input gives an empty table. Further columns are ignored.
    """
    occ = occ.select("field", "term", "record", "id", "part", _key().alias("key"))
    heavy = heavy_terms(occ)
    named = F.broadcast(heavy.select("slot", "key"))
    heavy_rows = occ.join(named, "key").select("slot", "record", "id", "part").distinct()
    counters = heavy_rows.groupBy("slot", "record").agg(F.count(F.lit(1)).alias("n")).groupBy("slot").agg(F.sum("n").alias("occurrences"), F.count("record").alias("records"))
    texts = heavy.select("slot", "field", "term")
    if long := [x["key"] for x in heavy.where("term is null").collect()]:
        # the text of a long heavy term is looked up: the first of each task and slot
        found = occ.where((F.length("term") > KEY_CHARS) & F.col("key").isin(long)).join(named, "key").groupBy("slot").agg(F.first("field").alias("field"), F.first("term").alias("term"))
        texts = texts.where("term is not null").unionAll(found.select("slot", "field", "term"))
    heavy_counts = counters.join(texts, "slot").select("field", "term", "occurrences", "records")
    light_rows = occ.join(named, "key", "left_anti").select("field", "term", "record", "id", "part").repartition("field", "term").distinct()
    light_counts = (
        light_rows.groupBy("field", "term", "record").agg(F.count(F.lit(1)).alias("n")).groupBy("field", "term").agg(F.sum("n").alias("occurrences"), F.count("record").alias("records"))
    )
    return heavy_counts.unionAll(light_counts)


#: Records a term needs to be more than rare, and the share of all records beyond which it is common.
RARE_RECORDS, COMMON_PERCENT = 2, 30


def mark(records: Column, all_records: Column) -> Column:
    """``rare``, ``common`` or null for a term in so many of all records."""
    return F.when(records <= RARE_RECORDS, "rare").when(records * 100 > all_records * COMMON_PERCENT, "common")


def marked_frequencies(occ: DataFrame, runs: DataFrame) -> DataFrame:
    """:func:`term_frequencies` with the mark against the number of distinct run ids."""
    total = runs.agg(F.count_distinct("run_id").alias("all_records"))
    return term_frequencies(occ).crossJoin(F.broadcast(total)).withColumn("mark", mark(F.col("records"), F.col("all_records"))).drop("all_records")
