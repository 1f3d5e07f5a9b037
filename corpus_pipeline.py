"""Documents through toxicity, near-dedup, repeated passages, secrets and packing; each stage is a table for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphweft.llm import packing, secrets, setsketch, suffixes, toxicity
from graphweft.llm.shared import table, written

STAGES = [
    ("toxicity", toxicity.stage),
    ("minhash_near_dedup", setsketch.stage),
    ("suffix_array_dedup", suffixes.stage),
    ("secret_scans", secrets.stage),
    ("packing", packing.stage),
]

#: Trees, register sketches and packing have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
