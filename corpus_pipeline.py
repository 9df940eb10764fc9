"""From raw documents to a training mix: five stages, each one operator of ``boughs.llm``.

Every stage reads what the stage before wrote, takes ``(spark, docs, sf_dir)`` and returns a DataFrame. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from boughs.llm.decontaminate import drop_contaminated  # noqa: E402
from boughs.llm.line_dedup import drop_boilerplate  # noqa: E402
from boughs.llm.mixing import mix_sources, text_size  # noqa: E402
from boughs.llm.quality import bucket_weights, clean_ids, quality_rules  # noqa: E402
from boughs.llm.simhash import drop_near_copies  # noqa: E402
from boughs.session import new_path  # noqa: E402


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    weights = bucket_weights(docs, clean_ids(_table(spark, sf_dir, "labels")))
    return quality_rules(docs, weights).filter("__quality.kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; ``n_chars`` follows the text."""
    out = drop_boilerplate(docs, "source")
    out = out.withColumn("n_chars", F.when(F.col("__cut.n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes from each document."""
    sized = docs.select("doc_id", F.array("source").alias("sources"), text_size(F.col("text")).alias("size"))
    return mix_sources(sized).select("doc_id", F.col("sources")[0].alias("source"), "size", "source_size", "target", "taken")


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("simhash_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
]

#: the first and third stage use 64-bit hashes that DuckDB lacks; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
