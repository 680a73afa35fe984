"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linecue.llm import chat_format, decontaminate, hard_negatives, language_model, licenses, minhash, quality_classifier, quality_rules, runs, sentencepieces, token_files, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op3_sentencepiece": sentencepieces.op3_sentencepiece,
    "op2_chat_format": chat_format.op2_chat_format,
    "op4_quality_classifier": quality_classifier.op4_quality_classifier,
    "op5_license_scan": licenses.op5_license_scan,
    "op7_minhash": minhash.op7_minhash,
    "op6_token_files": token_files.op6_token_files,
    "op8_warc": warc.op8_warc,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_language_model": language_model.op11_language_model,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_periodic_runs": runs.op13_periodic_runs,
}
ORACLES: dict[str, str] = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op2_chat_format": chat_format.ORACLE,
    "op8_warc": warc.ORACLE,
    "op9_decontaminate": decontaminate.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "op13_periodic_runs": runs.ORACLE,
}
