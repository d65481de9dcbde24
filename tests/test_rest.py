import shutil
from pathlib import Path

import pytest

import __spark_entry__
from qatlam.plans import catalogue
from qatlam.session import materialise, release, shared_folder
from qatlam.streaming import rowwise as R
from tests.conftest import same


def test_stream(spark, data, tmp_path):
    schema = spark.read.parquet(f"{data}/documents.parquet").schema
    (tmp_path / "in").mkdir()
    shutil.copy(f"{data}/documents.parquet", tmp_path / "in" / "d.parquet")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = R.token_stream(stream, "doc_id").writeStream.format("memory").queryName("tokens_seen").start()
    counted = R.windowed_token_counts(stream, "loaded_at", "30 days", "400 days").writeStream.format("memory").queryName("counted").outputMode("complete").start()
    cleaned = R.clean_stream(stream).writeStream.format("memory").queryName("cleaned_seen").start()
    for q in (query, counted, cleaned):
        q.processAllAvailable()
        q.stop()
    batch = R.token_stream(spark.read.parquet(f"{data}/documents.parquet"), "doc_id").count()
    assert spark.table("tokens_seen").count() == batch
    late = spark.read.parquet(f"{data}/documents.parquet").where("loaded_at is not null")
    assert spark.sql("select sum(n) from counted").first()[0] == R.token_stream(late, "doc_id").count()
    assert spark.table("cleaned_seen").count() == spark.read.parquet(f"{data}/documents.parquet").count()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, data, duck, name):
    df = catalogue.queries()[name](spark, data)
    if sql := catalogue.oracle_sql().get(name):
        same(df, duck.sql(sql))
    else:
        assert df.count() > 0


def test_written_tables(spark):
    df = materialise(spark.range(5).toDF("n"), "five")
    folder = Path(shared_folder(spark).removeprefix("file://"))
    assert df.count() == 5 and any(p.name.startswith("five-") for p in folder.iterdir())
    assert release(spark) >= 1 and not any(p.name.startswith("five-") for p in folder.iterdir())


def test_entry():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
