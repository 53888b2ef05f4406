"""The subpackage's queries by name, with SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronolith.llm.binary_packing import op7_query
from chronolith.llm.decontaminate import op1_query
from chronolith.llm.near_dedup import OP2_SQL, op2_query
from chronolith.llm.packing import op4_query
from chronolith.llm.quality import op9_query
from chronolith.llm.secret_scan import op10_query
from chronolith.llm.sharding import OP8_SQL, op8_query
from chronolith.llm.token_counts import op5_query
from chronolith.llm.toxicity import op3_query
from chronolith.llm.warc import OP6_SQL, op6_query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bm25_decontamination": op1_query,
        "op2_bagminhash_near_dedup": op2_query,
        "op3_lexicon_automaton_toxicity": op3_query,
        "op4_sum_of_squares_packing": op4_query,
        "op5_transducer_token_counts": op5_query,
        "op6_warc_normaliser": op6_query,
        "op7_best_fit_binary_packing": op7_query,
        "op8_extendible_hash_shards": op8_query,
        "op9_ngram_ratio_quality": op9_query,
        "op10_markov_secret_scan": op10_query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_bagminhash_near_dedup": OP2_SQL,
        "op6_warc_normaliser": OP6_SQL,
        "op8_extendible_hash_shards": OP8_SQL,
    }
