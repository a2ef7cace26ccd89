"""Registered queries of this package and their DuckDB SQL (where SQL can express them)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, conv_repair, decontam, hard_negatives, html_text, mixing, ngram_join, quality, secrets, sharding, stream_dedup, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": secrets.op1_secrets,
    "op2_warc": warc.op2_warc,
    "op3_quality": quality.op3_quality,
    "op4_sharding": sharding.op4_sharding,
    "op5_decontamination": decontam.op5_decontamination,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_html_text": html_text.op7_html_text,
    "op8_ann": ann.op8_ann,
    "op9_ngram_join": ngram_join.op9_ngram_join,
    "op10_mixing": mixing.op10_mixing,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_conv_repair": conv_repair.op12_conv_repair,
    "op13_stream_dedup": stream_dedup.op13_stream_dedup,
}

ORACLES: dict[str, str] = {
    "op2_warc": warc.ORACLE_OP2,
    "op5_decontamination": decontam.ORACLE_OP5,
    "op9_ngram_join": ngram_join.ORACLE_OP9,
    "op11_hard_negatives": hard_negatives.ORACLE_OP11,
    "op13_stream_dedup": stream_dedup.ORACLE_OP13,
}
