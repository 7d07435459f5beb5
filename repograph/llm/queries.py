"""The queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from repograph.llm.bpe import op6_bpe_pairs
from repograph.llm.chat_format import OP9_SQL, op9_chat_format
from repograph.llm.decontaminate import OP2_SQL, op2_decontaminate
from repograph.llm.language_crf import op5_language_crf
from repograph.llm.license_scan import op3_license_scan
from repograph.llm.line_dedup import op1_line_dedup
from repograph.llm.reshard import op7_reshard_flow
from repograph.llm.secrets import op4_secret_scan
from repograph.llm.simhash_dedup import op8_simhash_gray
from repograph.llm.topk_search import OP10_SQL, op10_topk_pivots

_QUERIES = [
    op1_line_dedup,
    op2_decontaminate,
    op3_license_scan,
    op4_secret_scan,
    op5_language_crf,
    op6_bpe_pairs,
    op7_reshard_flow,
    op8_simhash_gray,
    op9_chat_format,
    op10_topk_pivots,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": OP2_SQL, "op9_chat_format": OP9_SQL, "op10_topk_pivots": OP10_SQL}
