"""The posting-shaped views, and what queries land of them, where size matters."""

from glob import glob

import pytest
from pyspark.sql import functions as F

from vacantia.checks import queries as Q
from vacantia.checks import views as W


def _tables(spark, folder, n_docs=30):
    docs = spark.range(n_docs).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    docs.repartition(4).write.parquet(f"{folder}/documents.parquet")
    names = F.concat(F.lit("n"), F.col("id").cast("string"))
    for table, key, name, n in (
        ("supplier", "s_suppkey", "s_name", 4),
        ("part", "p_partkey", "p_name", 3),
        ("orders", "o_orderkey", "o_orderdate", 11),
    ):
        value = F.lit(W.NOW).cast("timestamp") if table == "orders" else names
        rows = spark.range(n).select(F.col("id").alias(key), value.alias(name))
        rows.write.parquet(f"{folder}/{table}.parquet")
    return str(folder)


def test_documents_may_be_the_side_that_is_broadcast(spark, tmp_path):
    sf = _tables(spark, tmp_path)
    small = F.broadcast(W.table(spark, sf, "documents"))
    rows = W.postings(spark, sf, documents=small).select("seq", "job_id").collect()
    usual = W.postings(spark, sf).select("seq", "job_id").collect()
    assert sorted(rows) == sorted(usual) and len(rows) == 30


@pytest.fixture
def work(monkeypatch, tmp_path):
    monkeypatch.setattr(Q, "new_work_dir", lambda spark, label: f"{tmp_path}/work/{label}")
    return f"{tmp_path}/work"


def test_scanned_documents_share_files(spark, tmp_path, work):
    sf = _tables(spark, tmp_path, 300)
    n = Q.payload_scan(spark, sf).count()
    files = glob(f"{work}/landed/**/part-*", recursive=True)
    assert n == 6 * 3 + 1 + 43 and 0 < len(files) < n / 2


def test_backlog_arrives_in_as_many_files_as_tasks(spark, tmp_path, work, monkeypatch):
    sf = _tables(spark, tmp_path, 300)
    landed, write = [], Q.written

    class Run:
        def awaitTermination(self):
            landed.append(len(glob(f"{work}/drain/arriving/part-*")))

    monkeypatch.setattr(Q, "stream_run", lambda *args, **knobs: Run())
    monkeypatch.setattr(Q, "written", lambda df, path: write(df.repartition(4), path))
    monkeypatch.setattr(Q, "_seeded_store", lambda spark, rows: Q._new_store(spark))
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a file is a task
    try:
        Q.stream_backlog(spark, sf)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert landed == [4 * n for n in range(1, 9)]
