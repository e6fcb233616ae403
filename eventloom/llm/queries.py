"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import covertree, licenses, linededup, merkle, packing, pseudolm, quality, simhash, tokencounts, unigram

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_top_k": covertree.op1_top_k,
    "op2_line_dedup": linededup.op2_line_dedup,
    "op3_token_counts": tokencounts.op3_token_counts,
    "op4_pseudo_likelihood": pseudolm.op4_pseudo_likelihood,
    "op5_packing": packing.op5_packing,
    "op6_quality": quality.op6_quality,
    "op7_licenses": licenses.op7_licenses,
    "op8_sentencepiece": unigram.op8_sentencepiece,
    "op9_simhash": simhash.op9_simhash,
    "op10_merkle": merkle.op10_merkle,
}
ORACLES: dict[str, str] = {
    "op1_top_k": covertree.OP1_SQL,
    "op2_line_dedup": linededup.OP2_SQL,
    "op7_licenses": licenses.OP7_SQL,
}
