"""Problem 4: the most frequent values of a column too large to count value by value.

Exact prefix refinement. Hashes of the values are counted by prefix: a prefix's count is an upper
bound for every value behind it, so prefixes below the bound a value must reach are dropped and the
rest are lengthened, until each prefix left has a single value behind it (told by the least and the
greatest hash there). What remains is counted exactly.

Memory is bounded in every round by the number of prefixes, never by that of the values: at most
``2 ** FIRST_BITS`` groups in the first round, and then at most (rows / bound) prefixes are kept,
each split ``2 ** STEP_BITS`` ways at most. Every round is a scan with one aggregation whose counts
are a written table; only figures by field come to the driver. A field whose rows / bound exceeds
``HELD`` isn't refined further: on a flat column no prefix can be dropped, and all values behind
those it has are counted, in a shuffle that may spill.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qatlam.operators.lookup import BROADCAST_BYTES
from qatlam.session import materialise
from qatlam.sources.tables import small_enough

FIRST_BITS, STEP_BITS, MOST_BITS = 12, 12, 60
#: Prefixes of a field that a further round may keep, so that they can be broadcast: beyond, a join by shuffle with
#: the prefixes would cost as much as counting the values behind them.
HELD = 1 << 20


def _prefixed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("hash", F.xxhash64("value"))


def _within(rows: DataFrame, kept: DataFrame | None) -> DataFrame:
    """The rows (field, id, value) whose value begins with a prefix kept for its field: (field, bits, prefix)."""
    if kept is None:
        return rows
    # a row for each field; there are few fields
    lengths = F.broadcast(kept.select("field", "bits").distinct())
    prefix = F.call_function("shiftrightunsigned", F.col("hash"), F.lit(64) - F.col("bits"))
    cut = _prefixed(rows).join(lengths, "field").withColumn("prefix", prefix)
    side = kept.select("field", "prefix")
    return cut.join(F.broadcast(side) if small_enough(side, BROADCAST_BYTES) else side, ["field", "prefix"], "left_semi").select("field", "id", "value")


def _exact(rows: DataFrame) -> DataFrame:
    return rows.distinct().groupBy("field", "value").agg(F.count(F.lit(1)).alias("ids"))


def _ranked(counts: DataFrame) -> DataFrame:
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("ids"), "value")))


def _limits(rows: DataFrame, bounds: dict[str, int]) -> DataFrame:
    return F.broadcast(rows.sparkSession.createDataFrame(list(bounds.items()), "field string, bound long"))


def _surviving(rows: DataFrame, bounds: dict[str, int], k: int = 0) -> tuple[DataFrame, dict[str, int]]:
    """The rows whose value may still reach its field's bound, after all rounds of prefixes, and the bounds.

    With ``k``, bounds begin at 1 and are raised: the ``k`` heaviest prefixes of a round hold ``k``
    values at least (if there are so many prefixes), and the k-th of their exact counts is a lower
    bound for the k-th of all.
    """
    bounds = dict(bounds)
    kept: DataFrame | None = None  # prefixes of the fields being refined
    done: list[DataFrame] = []  # and of those that are not any more
    for bits in range(FIRST_BITS, MOST_BITS + 1, STEP_BITS):
        hashed = _prefixed(_within(rows, kept))
        counted = hashed.groupBy("field", F.shiftrightunsigned("hash", 64 - bits).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        counted = materialise(counted.withColumn("bits", F.lit(bits)), "prefix-counts")
        if k:
            by_weight = Window.partitionBy("field").orderBy(F.desc("n"), "prefix")
            heaviest = counted.withColumn("rank", F.row_number().over(by_weight)).where(F.col("rank") <= k).select("field", "bits", "prefix")
            for x in _ranked(_exact(_within(rows, heaviest))).where(F.col("rank") == k).collect():
                bounds[x["field"]] = max(bounds.get(x["field"], 1), x["ids"])
        for x in counted.select("field").distinct().collect():
            bounds.setdefault(x["field"], 1)
        reached = counted.join(_limits(rows, bounds), "field").where("n >= bound")
        figures = reached.groupBy("field").agg(F.sum("n").alias("rows"), F.count_if(F.col("low") < F.col("high")).alias("open")).collect()
        # each prefix kept holds at least the bound, so no round keeps more than rows / bound
        on = [x["field"] for x in figures if x["open"] and x["rows"] // bounds.get(x["field"], 1) <= HELD] if bits + STEP_BITS <= MOST_BITS else []
        slim = reached.select("field", "bits", "prefix")
        done.append(slim.where(~F.col("field").isin(on)))
        kept = slim.where(F.col("field").isin(on))
        if not on:
            break
    final = done[0]
    for x in done[1:]:
        final = final.unionAll(x)
    return _within(rows, final), bounds


def distinct_ids(rows: DataFrame) -> dict[str, int]:
    """By field, the number of distinct ids whose value isn't null."""
    counted = rows.where("value is not null").select("field", "id").distinct().groupBy("field").agg(F.count(F.lit(1)).alias("n"))
    return {x["field"]: x["n"] for x in counted.collect()}


def frequent_values(rows: DataFrame, percent: int) -> DataFrame:
    """(field, item, ids): the values held by at least ``percent`` per cent of a field's distinct ids.

    ``rows`` has (field, id, value); there are few fields. Null values and null ids don't count,
    repeated rows count once, an empty text is a value like any other. Counts are exact. Prefix
    counts include the repeats, so they still bound the number of ids from above.
    """
    rows = rows.where("field is not null and value is not null and id is not null").select("field", "id", "value")
    totals = distinct_ids(rows)
    bounds = {f: max(1, -(-n * percent // 100)) for f, n in totals.items()}
    exact = _exact(_surviving(rows, bounds)[0])
    return exact.join(_limits(rows, bounds), "field").where("ids >= bound").select("field", F.col("value").alias("item"), "ids")


def top_values(rows: DataFrame, k: int) -> DataFrame:
    """(field, item, ids, rank): the ``k`` most frequent values of each field, ties in order of the value.

    The bound that drops prefixes comes from exact counts of at least ``k`` values behind the
    heaviest prefixes, so the result is exact. With fewer values than ``k``, all are given.
    """
    rows = rows.where("field is not null and value is not null and id is not null").select("field", "id", "value")
    kept, bounds = _surviving(rows, {}, k)
    ranked = _ranked(_exact(kept).join(_limits(rows, bounds), "field").where("ids >= bound"))
    return ranked.where(F.col("rank") <= k).select("field", F.col("value").alias("item"), "ids", "rank")


def value_rows(tokens: DataFrame, analyses: DataFrame) -> DataFrame:
    """The two columns as (field, id, value)."""
    return tokens.select(F.lit("text").alias("field"), F.col("token_id").alias("id"), F.col("text").alias("value")).unionAll(
        analyses.select(F.lit("root").alias("field"), F.col("analysis_id").alias("id"), F.col("root").alias("value"))
    )
