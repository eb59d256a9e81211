"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tallyfold.llm import bpe, decontaminate, exact_dedup, fill_in_middle, filter_audit, html_text, line_dedup, near_dedup, personal_data, quality, substring_dedup, token_count, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": warc.query,
    "op2_token_count": token_count.query,
    "op3_byte_bpe": bpe.query,
    "op4_substring_dedup": substring_dedup.query,
    "op5_quality": quality.query,
    "op6_decontaminate": decontaminate.query,
    "op7_near_dedup": near_dedup.query,
    "op8_exact_dedup": exact_dedup.query,
    "op9_line_dedup": line_dedup.query,
    "op10_html_text": html_text.query,
    "op11_fill_in_middle": fill_in_middle.query,
    "op12_personal_data": personal_data.query,
    "op13_filter_audit": filter_audit.query,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {
    "op1_warc": warc.SQL,
    "op4_substring_dedup": substring_dedup.SQL,
    "op6_decontaminate": decontaminate.SQL,
    "op7_near_dedup": near_dedup.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
    "op11_fill_in_middle": fill_in_middle.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
