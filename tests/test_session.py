import pytest

from vacantia import session


class Named:
    """Stands in for a session with or without a shared folder."""

    def __init__(self, value, master="local[4]"):
        self.conf = {"spark.master": master} | ({"spark.checkpoint.dir": value} if value else {})


def test_shared_folder_is_the_clusters():
    assert session.shared_dir(Named("hdfs://nn/ckpt/")) == "hdfs://nn/ckpt"
    own = session.shared_dir(Named(None))
    assert own and session.shared_dir(Named(None)) == own
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,512]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_dir(Named(None, master))
        assert session.shared_dir(Named("/shared", master)) == "/shared"
    first, second = (session.new_work_dir(Named("/shared"), "x") for _ in range(2))
    assert first.startswith("/shared/vacantia/x-") and first != second


def test_written_tables_read_back(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "id % 2 AS k", "struct(id AS a, 'x' AS b) AS s")
    plain = session.written(df, str(tmp_path / "plain"))
    parts = session.written(df, str(tmp_path / "parts"), partition_by="k")
    assert sorted(plain.collect()) == sorted(df.collect())
    assert sorted(parts.select(*df.columns).collect()) == sorted(df.collect())
