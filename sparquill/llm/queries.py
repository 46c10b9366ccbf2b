"""The training-data queries by name, and their SQL where SQL can express them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparquill.llm import bpe, chat, html_extract, license_scan, line_dedup, minhash_dedup, mixing, nn_descent, quality, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality.query,
    "op2_nn_descent": nn_descent.query,
    "op3_license_scan": license_scan.query,
    "op3_license_paragraphs": license_scan.paragraphs_query,
    "op4_bpe": bpe.query,
    "op5_minhash_dedup": minhash_dedup.query,
    "op6_line_dedup": line_dedup.query,
    "op7_url_filter": url_filter.query,
    "op8_chat_format": chat.query,
    "op9_html_extraction": html_extract.query,
    "op10_source_mixing": mixing.query,
}
ORACLES: dict[str, str] = {
    "op1_quality_rules": quality.ORACLE_SQL,
    "op3_license_scan": license_scan.ORACLE_SQL,
    "op6_line_dedup": line_dedup.ORACLE_SQL,
    "op7_url_filter": url_filter.ORACLE_SQL,
    "op8_chat_format": chat.ORACLE_SQL,
    "op10_source_mixing": mixing.ORACLE_SQL,
}
