"""The queries and SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import chat_format, url_redirects, warc_archive
from tidemark.llm.benchmark_windows import op9_benchmark_windows
from tidemark.llm.chat_format import op3_chat_format
from tidemark.llm.pii_votes import op7_pii_votes
from tidemark.llm.quality_llr import op1_quality_llr
from tidemark.llm.secret_scan import op6_secret_scan
from tidemark.llm.simhash_dedup import op10_simhash_near_dedup
from tidemark.llm.source_mix import op8_source_mix
from tidemark.llm.suffix_tree_lm import op5_suffix_tree_lm
from tidemark.llm.url_redirects import op4_url_redirects
from tidemark.llm.warc_archive import op2_warc_salvage


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_quality_llr, op2_warc_salvage, op3_chat_format, op4_url_redirects, op5_suffix_tree_lm, op6_secret_scan, op7_pii_votes, op8_source_mix, op9_benchmark_windows, op10_simhash_near_dedup)
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_salvage": warc_archive.SQL, "op3_chat_format": chat_format.SQL, "op4_url_redirects": url_redirects.SQL}
