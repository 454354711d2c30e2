"""Registered queries of the corpus operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hazardlens.llm.ann import op3_nearest
from hazardlens.llm.bpe import op8_bpe
from hazardlens.llm.chat import op1_chat_windows
from hazardlens.llm.decontam import op6_decontamination
from hazardlens.llm.hardneg import op13_hard_negatives
from hazardlens.llm.knnjoin import op12_knn_join
from hazardlens.llm.langid import op10_language_id
from hazardlens.llm.linededup import op5_line_dedup
from hazardlens.llm.neardup import op4_near_duplicates
from hazardlens.llm.oracle import ORACLE_SQL
from hazardlens.llm.repair import op11_structure_repair
from hazardlens.llm.secrets import op9_secret_scan
from hazardlens.llm.tokenfiles import op7_token_files
from hazardlens.llm.urlfilter import op2_url_filter

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_windows, op2_url_filter, op3_nearest, op4_near_duplicates, op5_line_dedup,
        op6_decontamination, op7_token_files, op8_bpe, op9_secret_scan, op10_language_id,
        op11_structure_repair, op12_knn_join, op13_hard_negatives,
    )
}
