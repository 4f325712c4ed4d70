"""Session settings, and tables written to the shared folder to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Per-group limits are applied before the shuffle whatever their size.
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000000000",
    # Texts are long: smaller batches bound a Python worker's memory.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def build_session(
    app_name: str = "vacantia", master: str | None = None, **conf: object
) -> SparkSession:
    """A session with UTC and adaptive execution on; cluster settings come from spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Timestamps without a zone mean UTC throughout."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="vacantia-")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; one of the machine's own only for a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", None) or ""):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = _own_dir()
    return named.rstrip("/")


def new_work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared one; nothing else writes there."""
    return f"{shared_dir(spark)}/vacantia/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet and read it back: computed once, lineage cut, columns prunable.

    The files are in shared storage, so a lost executor costs a re-read and not a recomputation.
    """
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
