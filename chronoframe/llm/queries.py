"""Registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from chronoframe.llm import (alignment, bpe, centroids, cotraining, exact_dedup, interpolation, jaccard_join, packing,
                             repetition, substring_dedup, suffix_dedup, toxicity, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_cotraining": cotraining.op2_cotraining,
    "op3_concat_cut": packing.op3_concat_cut,
    "op4_repetition": repetition.op4_repetition,
    "op5_deleted_interpolation": interpolation.op5_deleted_interpolation,
    "op6_prefix_bpe": bpe.op6_prefix_bpe,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_warc": warc.op9_warc,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op11_alignment": alignment.op11_alignment,
    "op12_suffix_dedup": suffix_dedup.op12_suffix_dedup,
    "op13_centroids": centroids.op13_centroids,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op8_substring_dedup": substring_dedup.ORACLE,
    "op10_jaccard_join": jaccard_join.ORACLE,
    "op12_suffix_dedup": suffix_dedup.ORACLE,
    "op13_centroids": centroids.ORACLE,
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
