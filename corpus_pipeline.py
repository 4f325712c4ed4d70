"""From documents to packed sequences: language, quality, near-duplicates, personal data, packing.

Each stage works on all that its predecessor kept. ``run`` writes every stage as Parquet to the shared
folder and reads it back for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vacantia.llm.common import new_work_dir, prepared, written
from vacantia.llm.language_id import stage_language
from vacantia.llm.near_dedup import stage_near_dedup
from vacantia.llm.packing import stage_packing
from vacantia.llm.pii import stage_pii
from vacantia.llm.quality import stage_quality


def _with_settings(stage):
    def prepared_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(prepared(spark), docs, sf_dir)

    return prepared_stage


STAGES = [
    ("language ID", _with_settings(stage_language)),
    ("quality rules", _with_settings(stage_quality)),
    ("MinHash near-dedup", _with_settings(stage_near_dedup)),
    ("PII", _with_settings(stage_pii)),
    ("best-fit packing", _with_settings(stage_packing)),
]

#: Trained profiles, sketches and tokens are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), new_work_dir(spark, "stage"))
    return docs
