"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int = 8, app: str = "qatlam") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir``, else, on one machine only, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="qatlam-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = "file://" + own
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_written: list[str] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables this process wrote to the shared folder; to be called once their results were read. Returns how many."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_written)
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


# ------------------------------------------------------------------ single files
def _file_system(path: str):
    spark = SparkSession.active()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def file_exists(path: str) -> bool:
    """Whether there is a file or folder at a local path, or at a URI of any file system that Spark knows."""
    if "://" not in path:
        return Path(path).exists()
    at, fs = _file_system(path)
    return fs.exists(at)


def write_text(path: str, parts: Iterable[str]) -> None:
    """One text file at a local path or a URI, folders made as needed. For models and dictionaries, whose size is bounded."""
    if "://" not in path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        with Path(path).open("w", encoding="utf-8") as f:
            f.writelines(parts)
        return
    at, fs = _file_system(path)
    out = fs.create(at, True)
    try:
        waiting: list[str] = []
        for part in parts:
            waiting.append(part)
            if len(waiting) >= 10_000:
                out.write(bytearray("".join(waiting).encode()))
                waiting.clear()
        out.write(bytearray("".join(waiting).encode()))
    finally:
        out.close()


def read_text(path: str) -> str:
    if "://" not in path:
        return Path(path).read_text(encoding="utf-8")
    return SparkSession.active().read.text(path, wholetext=True).first()[0]
