"""Problem 3: per-key results when a few keys hold most rows.

Fragment-replicate by estimated load. Loads come from two tables whose size follows the cluster,
not the data: the row counts of so many hash buckets of the key for each bin, and a sketch of the
keys that alone exceed a good part of a bin's share. Long keys go by their digest.
The driver packs buckets and hot keys into as many bins as there are tasks, largest first; a hot
key is cut into shards in proportion to its load, and each shard goes to a bin of its own choice.
A row finds its bin by its key, and within a hot key by its id. The matching side of a join is
replicated to the shards of hot keys only; everything else of it goes to one bin.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hash buckets of keys whose loads are counted, in all and for each bin; hot keys named for each bin at most (more
#: can't have half of a bin's share each), and the sketch's counters for each of them.
LEAST_BUCKETS, BUCKETS_A_BIN, HOT_A_BIN, COUNTERS_A_HOT_KEY = 4096, 16, 2, 8
#: A longer key goes by its digest, so that the table of hot keys has a bounded size.
KEY_CHARS = 64


def short_key(key: Column) -> Column:
    """A key in a bounded number of characters, one to one."""
    return F.when(F.length(key) <= KEY_CHARS, F.concat(F.lit("="), key)).otherwise(F.concat(F.lit("#"), F.sha2(key, 256)))


def pack_bins(buckets: dict[int, int], hot: dict[str, int], bins: int) -> tuple[dict[int, int], dict[str, list[int]]]:
    """Bins of each bucket and of each hot key's shards, largest load first into the emptiest bin.

    ``buckets`` are loads without the hot keys. A key's shards number its load over a bin's share,
    rounded up, and never more than the bins.
    """
    share = max(1.0, (sum(buckets.values()) + sum(hot.values())) / bins)
    shards = {k: min(bins, int(-(-n // share))) for k, n in hot.items()}
    loads = [(n / shards[k], 0, k, i) for k, n in hot.items() for i in range(shards[k])] + [(n, 1, b, 0) for b, n in buckets.items()]
    heap = [(0.0, i) for i in range(bins)]
    of_bucket: dict[int, int] = {}
    of_hot: dict[str, list[int]] = {k: [] for k in hot}
    for load, kind, name, _ in sorted(loads, key=lambda x: (-x[0], x[1], str(x[2]), x[3])):
        filled, i = heapq.heappop(heap)
        if kind:
            of_bucket[name] = i
        else:
            of_hot[name].append(i)
        heapq.heappush(heap, (filled + load, i))
    return of_bucket, of_hot


class Balance:
    """A plan of bins for one key column of one table."""

    def __init__(self, df: DataFrame, key: Column, bins: int | None = None):
        spark = df.sparkSession
        self.bins = bins or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.count = max(LEAST_BUCKETS, BUCKETS_A_BIN * self.bins)
        rows = df.select(short_key(key.cast("string")).alias("key")).where("key is not null")
        loads = {x["bucket"]: x["n"] for x in rows.groupBy(self.bucket(F.col("key")).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect()}
        total = sum(loads.values())
        hot: dict[str, int] = {}
        # only a bucket above half of a bin's share can hold a hot key: if there is none, no sketch is needed
        if loads and max(loads.values()) * 2 * self.bins > total:
            most = HOT_A_BIN * self.bins
            named = rows.agg(F.expr(f"approx_top_k(key, {most}, {min(1_000_000, max(4096, COUNTERS_A_HOT_KEY * most))})").alias("top")).first()["top"]
            hot = {x["item"]: x["count"] for x in named or [] if x["count"] * 2 * self.bins > total}
            if hot:
                for x in spark.createDataFrame([(k,) for k in hot], "key string").select("key", self.bucket(F.col("key")).alias("bucket")).collect():
                    loads[x["bucket"]] = max(0, loads.get(x["bucket"], 0) - hot[x["key"]])
        of_bucket, self.hot = pack_bins(loads, hot, self.bins)
        self.buckets = spark.createDataFrame(sorted(of_bucket.items()), "`__bucket` int, `__bin` int")
        self.shards = spark.createDataFrame(sorted(self.hot.items()), "`__key` string, `__bins` array<int>")

    def bucket(self, short: Column) -> Column:
        return F.pmod(F.xxhash64(short), F.lit(self.count)).cast("int")

    def _place(self, df: DataFrame, key: Column) -> DataFrame:
        """``df`` with ``__bins`` (null unless its key is hot) and ``__bin`` of the bucket."""
        keyed = df.withColumn("__key", short_key(key.cast("string"))).withColumn("__bucket", self.bucket(F.col("__key")))
        # so many rows for each bin bound these two sides
        return keyed.join(F.broadcast(self.buckets), "__bucket", "left").join(F.broadcast(self.shards), "__key", "left")

    def fragment(self, df: DataFrame, key: Column, spread: Column) -> DataFrame:
        """``df`` with its ``__bin``, moved to the task of that number; ``spread`` picks the shard within a hot key."""
        shard = F.get(F.col("__bins"), F.pmod(F.xxhash64(spread), F.size("__bins")).cast("int"))
        placed = self._place(df, key).withColumn("__bin", F.coalesce(shard, F.col("__bin"), F.pmod(F.xxhash64(spread), F.lit(self.bins)).cast("int")))
        return placed.drop("__bins", "__bucket", "__key").repartitionById(self.bins, F.col("__bin"))

    def replicate(self, df: DataFrame, key: Column) -> DataFrame:
        """``df`` with its ``__bin``, once for each shard of a hot key, moved likewise. Keys unknown to the plan match nothing and go."""
        placed = self._place(df, key).withColumn("__bin", F.explode(F.coalesce(F.array_distinct("__bins"), F.array("__bin"))))
        return placed.where("`__bin` is not null").drop("__bins", "__bucket", "__key").repartitionById(self.bins, F.col("__bin"))


def fragment_replicate_join(left: DataFrame, right: DataFrame, key: str, spread: Column, how: str = "inner", bins: int | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``key``, hot keys of ``left`` in shards.

    ``how`` is inner, left, left_semi or left_anti: rows of the right side are replicated, so joins
    that would keep them unmatched are refused. A null key matches nothing. Columns of the right
    side, but for the key, must not clash with the left's.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a replicated side can't be kept: {how}")
    plan = Balance(left, F.col(key), bins)
    a, b = plan.fragment(left, F.col(key), spread), plan.replicate(right, F.col(key))
    return a.join(b, ["__bin", key], how).drop("__bin")


def key_summary(df: DataFrame, key: str, row_id: str, record: str | None = None, number: str | None = None, latest: str | None = None, bins: int | None = None) -> DataFrame:
    """(key, ids, records, mean_<number>, latest_<latest>) for every value of ``key``; what isn't named is neither moved nor given.

    Repeated ids count once, with their latest ``latest``. Null keys and null ids are left out; a
    null record is none; means are over the non-null numbers of distinct ids (null if there are
    none), in decimals, so that they don't depend on the order of rows.

    The rows move once, into balanced bins. There ids are made distinct and counted by record; what
    the shards of a hot key still share, its records, is merged by key and record.
    """
    wanted = [F.col(key).alias("k"), F.col(row_id).alias("i")]
    same, once_over = ["k", "i"], []
    counts, sums = [F.count(F.lit(1)).alias("n")], [F.sum("n").alias("n")]
    if record:
        wanted.append(F.col(record).alias("r"))
        same.append("r")
    if number:
        wanted.append(F.col(number).cast("decimal(18,6)").alias("v"))
        same.append("v")
        counts += [F.sum("v").alias("s"), F.count("v").alias("c")]
        sums += [F.sum("s").alias("s"), F.sum("c").alias("c")]
    if latest:
        wanted.append(F.col(latest).alias("t"))
        once_over.append(F.max("t").alias("t"))
        counts.append(F.max("t").alias("t"))
        sums.append(F.max("t").alias("t"))
    rows = df.where(F.col(key).isNotNull() & F.col(row_id).isNotNull()).select(*wanted)
    placed = Balance(rows, F.col("k"), bins).fragment(rows, F.col("k"), F.col("i")).groupBy("__bin", *same)
    once = placed.agg(*once_over) if once_over else placed.agg(F.lit(1).alias("one")).drop("one")
    by = ["k", "r"] if record else ["k"]
    out = once.groupBy("__bin", *by).agg(*counts).groupBy(*by).agg(*sums)
    if record:
        out = out.groupBy("k").agg(F.count("r").alias("records"), *sums)
    columns = [F.col("k").alias(key), F.col("n").alias("ids")]
    if record:
        columns.append(F.col("records"))
    if number:
        columns.append(F.round(F.col("s").cast("double") / F.when(F.col("c") > 0, F.col("c")), 6).alias(f"mean_{number}"))
    if latest:
        columns.append(F.col("t").alias(f"latest_{latest}"))
    return out.select(*columns)
