"""Registered queries of this subpackage and the SQL that yields the same rows, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from pointloom.llm.decontaminate import op4_decontaminate
from pointloom.llm.embeddings import op2_embeddings
from pointloom.llm.langid import op10_langid
from pointloom.llm.packing import op3_packing
from pointloom.llm.preferences import OP6_SQL, op6_preferences
from pointloom.llm.sharding import op1_sharding
from pointloom.llm.simhash import op9_simhash
from pointloom.llm.substrings import op5_substrings
from pointloom.llm.tokenstore import op8_tokenstore
from pointloom.llm.warc import op7_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_sharding, op2_embeddings, op3_packing, op4_decontaminate, op5_substrings, op6_preferences, op7_warc, op8_tokenstore, op9_simhash, op10_langid)
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op6_preferences": OP6_SQL}
