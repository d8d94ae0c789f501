"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import classifier, conversations, jaccard, mixing, neighbors, packing, personal, rules, secrets, sharding, substring, token_counts, whitening

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_quality_rules": rules.query,
        "op2_secret_scan": secrets.query,
        "op3_quality_classifier": classifier.query,
        "op4_packing": packing.query,
        "op5_jaccard_join": jaccard.query,
        "op6_mixing": mixing.query,
        "op7_embedding_dedup": neighbors.query,
        "op8_sharding": sharding.query,
        "op9_token_counts": token_counts.query,
        "op10_substring_dedup": substring.query,
        "op11_embedding_whitening": whitening.query,
        "op12_personal_data": personal.query,
        "op13_conversation_trie": conversations.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_secret_scan": secrets.ORACLE,
        "op5_jaccard_join": jaccard.ORACLE,
        "op7_embedding_dedup": neighbors.ORACLE,
        "op10_substring_dedup": substring.ORACLE,
        "op13_conversation_trie": conversations.ORACLE,
    }
