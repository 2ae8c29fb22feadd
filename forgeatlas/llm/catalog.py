"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from forgeatlas.llm.op1_bpe import op1_bpe
from forgeatlas.llm.op2_quality import op2_quality
from forgeatlas.llm.op3_secrets import op3_secrets
from forgeatlas.llm.op4_simhash import op4_simhash
from forgeatlas.llm.op5_idfile import op5_idfile
from forgeatlas.llm.op6_rules import op6_rules
from forgeatlas.llm.op7_chat import OP7_SQL, op7_chat
from forgeatlas.llm.op8_tokens import op8_tokens
from forgeatlas.llm.op9_language import op9_language
from forgeatlas.llm.op10_decontaminate import op10_decontaminate
from forgeatlas.llm.op11_packing import op11_packing
from forgeatlas.llm.op12_structure import op12_structure
from forgeatlas.llm.op13_alignment import op13_alignment

QUERIES = (
    op1_bpe, op2_quality, op3_secrets, op4_simhash, op5_idfile,
    op6_rules, op7_chat, op8_tokens, op9_language, op10_decontaminate,
    op11_packing, op12_structure, op13_alignment,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op7_chat": OP7_SQL}
