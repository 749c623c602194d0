"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from pathlore.llm.chat import op8_chat
from pathlore.llm.decontaminate import op5_decontaminate
from pathlore.llm.divergence import OP12_SQL, op12_divergence
from pathlore.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from pathlore.llm.keyed_ids import op7_keyed_ids
from pathlore.llm.lexical import OP11_SQL, op11_lexical
from pathlore.llm.line_dedup import op10_line_dedup
from pathlore.llm.near_dedup import op9_near_dedup
from pathlore.llm.packing import op1_packing
from pathlore.llm.pii import op13_pii
from pathlore.llm.quality import op2_quality
from pathlore.llm.substring_dedup import op6_substring_dedup
from pathlore.llm.toxicity import op4_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": corpus_pipeline.run,
    "op1_packing": op1_packing,
    "op2_quality": op2_quality,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_decontaminate": op5_decontaminate,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_keyed_ids": op7_keyed_ids,
    "op8_chat": op8_chat,
    "op9_near_dedup": op9_near_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op11_lexical": op11_lexical,
    "op12_divergence": op12_divergence,
    "op13_pii": op13_pii,
}
ORACLE_SQL: dict[str, str] = {"op3_exact_dedup": OP3_SQL, "op11_lexical": OP11_SQL, "op12_divergence": OP12_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
