"""The corpus pipeline: quality filter, near-duplicate removal, secret removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is
written as Parquet in the shared folder and read again as the next stage's docs.
All but the last return the columns of documents.  Stages call graintide.llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graintide.llm.common import keep, table
from graintide.llm.mil_quality import quality_stage
from graintide.llm.order_minhash import near_duplicate_stage
from graintide.llm.packing import packing_stage
from graintide.llm.secrets import secret_stage

STAGES = [
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("secret_scan", secret_stage),
    ("best_fit_packing", packing_stage),
]

#: A trained classifier and tokenized packing aren't SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else keep(docs, name), sf_dir)
    return docs
