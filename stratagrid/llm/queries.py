"""The corpus queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from stratagrid.llm import licenses
from stratagrid.llm.chat import op9_chat
from stratagrid.llm.langid import op10_language
from stratagrid.llm.masked import op6_masked_lm
from stratagrid.llm.neighbours import op3_neighbours
from stratagrid.llm.pieces import op7_sentencepiece
from stratagrid.llm.quality import op8_quality
from stratagrid.llm.simhash import op2_simhash
from stratagrid.llm.store import op5_store
from stratagrid.llm.wumanber import OP4_SQL, op4_decontamination


def queries() -> dict:
    return {
        "op1_licenses": licenses.op1_licenses,
        "op2_simhash": op2_simhash,
        "op3_neighbours": op3_neighbours,
        "op4_decontamination": op4_decontamination,
        "op5_store": op5_store,
        "op6_masked_lm": op6_masked_lm,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_quality": op8_quality,
        "op9_chat": op9_chat,
        "op10_language": op10_language,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_licenses": licenses.oracle(), "op4_decontamination": OP4_SQL}
