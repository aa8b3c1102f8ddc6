"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from jobweave.llm import bpe_lexicon, chat_windows, ctw, host_rules, html_extract, line_dedup, periodic_runs, resident_codes, setsketch, suffix_runs
from jobweave.llm import templates, toxicity, warc_zip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": corpus_pipeline.run,
    "op1_lm_scoring": ctw.query,
    "op2_html_extraction": html_extract.query,
    "op3_benchmark_decontamination": templates.query,
    "op4_bpe_encoding": bpe_lexicon.query,
    "op5_quality_rules": host_rules.query,
    "op6_line_dedup": line_dedup.query,
    "op7_chat_formatting": chat_windows.query,
    "op8_toxicity": toxicity.query,
    "op9_warc": warc_zip.query,
    "op10_minhash_near_dedup": setsketch.query,
    "op11_suffix_dedup": suffix_runs.query,
    "op12_vector_codes": resident_codes.query,
    "op13_periodic_runs": periodic_runs.query,
}
SQL: dict[str, str] = {
    "op3_benchmark_decontamination": templates.SQL.strip(),
    "op5_quality_rules": host_rules.SQL.strip(),
    "op6_line_dedup": line_dedup.SQL.strip(),
    "op9_warc": warc_zip.SQL.strip(),
    "op10_minhash_near_dedup": setsketch.SQL.strip(),
    "op12_vector_codes": resident_codes.SQL,
}
