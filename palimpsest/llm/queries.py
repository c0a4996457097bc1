"""The queries of this subpackage and, where SQL can state them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, jaccard, licenses, mixing, parts, phrases, pii, quality, runs, sharding, simhash, topk, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": chat.query,
    "op2_simhash": simhash.query,
    "op3_quality": quality.query,
    "op4_licenses": licenses.query,
    "op5_pii": pii.query,
    "op6_sharding": sharding.query,
    "op7_decontamination": decontam.query,
    "op8_topk": topk.query,
    "op9_mixing": mixing.query,
    "op10_toxicity": toxicity.query,
    "op11_phrases": phrases.query,
    "op12_runs": runs.query,
    "op13_jaccard": jaccard.query,
    "licence_phrases": parts.licence_phrases,
    "private_base": parts.private_base,
    "shard_laws": parts.shard_laws,
    "mix_laws": parts.mix_laws,
}

ORACLES: dict[str, str] = {
    "op1_chat": chat.ORACLE,
    "op7_decontamination": decontam.ORACLE,
    "op8_topk": topk.ORACLE,
    "op11_phrases": phrases.ORACLE,
    "op12_runs": runs.ORACLE,
    "licence_phrases": parts.LICENCE_PHRASES,
    "private_base": parts.PRIVATE_BASE,
    "shard_laws": parts.SHARD_LAWS,
    "mix_laws": parts.MIX_LAWS,
}
