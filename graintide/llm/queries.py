"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graintide.llm.bin_slack import op12_minimum_bin_slack
from graintide.llm.edit_counts import op7_edit_aware_token_counts
from graintide.llm.mil_quality import op8_quality_classifier
from graintide.llm.one_perm import op9_one_permutation_fingerprints
from graintide.llm.order_minhash import op5_order_minhash_near_dedup
from graintide.llm.packing import op10_best_fit_packing
from graintide.llm.periodic_runs import op11_periodic_runs
from graintide.llm.piece_bpe import op3_sentencepiece
from graintide.llm.progressive_jpeg import op6_progressive_jpeg
from graintide.llm.secrets import op2_secret_scan
from graintide.llm.sharding import op1_sharding
from graintide.llm.spelling import op13_spelling_variants
from graintide.llm.warc import SQL as WARC_SQL
from graintide.llm.warc import op4_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_sharding, op2_secret_scan, op3_sentencepiece, op4_warc, op5_order_minhash_near_dedup, op6_progressive_jpeg, op7_edit_aware_token_counts, op8_quality_classifier, op9_one_permutation_fingerprints, op10_best_fit_packing, op11_periodic_runs, op12_minimum_bin_slack, op13_spelling_variants)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": WARC_SQL}
