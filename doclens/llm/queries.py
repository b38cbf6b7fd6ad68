"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from doclens.llm.conversations import OP11_SQL, op11_conversation_repair
from doclens.llm.decontaminate import OP5_SQL, op5_decontaminate
from doclens.llm.fingerprints import op13_fingerprints
from doclens.llm.langid import op2_language_id
from doclens.llm.lm import op9_lm_scoring
from doclens.llm.near_dup import OP8_SQL, op8_ngram_join
from doclens.llm.packing import op6_packing
from doclens.llm.periodic import OP12_SQL, op12_periodic_runs
from doclens.llm.quality_rules import OP10_SQL, op10_quality_rules
from doclens.llm.sharding import op7_sharding
from doclens.llm.subword import op1_quality_classifier
from doclens.llm.toxicity import op4_toxicity
from doclens.llm.warc import OP3_SQL, op3_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_quality_classifier": op1_quality_classifier, "op4_toxicity": op4_toxicity, "op2_language_id": op2_language_id, "op3_warc": op3_warc, "op5_decontaminate": op5_decontaminate, "op6_packing": op6_packing, "op7_sharding": op7_sharding, "op8_ngram_join": op8_ngram_join, "op9_lm_scoring": op9_lm_scoring, "op10_quality_rules": op10_quality_rules, "op11_conversation_repair": op11_conversation_repair, "op12_periodic_runs": op12_periodic_runs, "op13_fingerprints": op13_fingerprints}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3_SQL, "op5_decontaminate": OP5_SQL, "op8_ngram_join": OP8_SQL, "op10_quality_rules": OP10_SQL, "op11_conversation_repair": OP11_SQL, "op12_periodic_runs": OP12_SQL}
