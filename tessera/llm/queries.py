"""The queries opN_<name> over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, jaccard, licenses, substrings
from .common import table
from .decontamination import decontaminate
from .hmm import score as hmm_score
from .jaccard import linked_copies
from .licenses import scan
from .packing import pack
from .quality import SQL as QUALITY_SQL
from .quality import score
from .sharding import shard
from .substrings import cut_repeats
from .token_counts import count_tokens
from .token_files import token_files


def _documents(op: Callable[..., DataFrame], **kwargs) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(table(spark, sf_dir, "documents"), **kwargs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": _documents(scan),
        "op2_packing": _documents(pack),
        "op3_substring_dedup": _documents(cut_repeats),
        "op4_ngram_jaccard": _documents(linked_copies),
        "op5_token_counts": _documents(count_tokens),
        "op6_sharding": _documents(shard),
        "op7_quality_rules": lambda spark, sf_dir: score(table(spark, sf_dir, "documents")).drop("failed_rule"),
        "op8_decontamination": lambda spark, sf_dir: decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
        "op9_token_files": _documents(token_files),
        "op10_lm_scoring": _documents(hmm_score),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": licenses.sql(),
        "op3_substring_dedup": substrings.SQL,
        "op4_ngram_jaccard": jaccard.SQL,
        "op7_quality_rules": QUALITY_SQL,
        "op8_decontamination": decontamination.SQL,
    }
