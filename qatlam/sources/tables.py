"""The parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Bytes in memory that a byte of a compressed file may become, in a hash table of strings and structs.
IN_MEMORY = 6


def small_enough(df: DataFrame, limit_bytes: int) -> bool:
    """Whether ``df`` is taken to stay under ``limit_bytes`` in memory: the optimizer's estimate, times ``IN_MEMORY`` as it rests on file sizes."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return IN_MEMORY * int(str(stats.sizeInBytes())) <= limit_bytes


def spread(df: DataFrame) -> DataFrame:
    """A scan that costs more to compute on than to move, over all cores: moved only if it has fewer partitions than there are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def spread_by(df: DataFrame, key: str) -> DataFrame:
    """Few bytes that cost much to compute on, over as many tasks as a shuffle has, by a key that later steps group by.

    Adaptive execution would put small partitions together by their bytes; a number given by hand stays.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n, key)
