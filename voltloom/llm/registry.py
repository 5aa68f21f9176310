"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voltloom.llm import bpe, hostrules, langid, packing, pii, reshard, secrets, simhash, topk, zclass


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_langid": langid.op2_langid,
        "op3_simhash": simhash.op3_simhash,
        "op4_host_rules": hostrules.op4_host_rules,
        "op5_secrets": secrets.op5_secrets,
        "op6_reshard": reshard.op6_reshard,
        "op7_compression": zclass.op7_compression,
        "op8_pii": pii.op8_pii,
        "op9_topk": topk.op9_topk,
        "op10_packing": packing.op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_host_rules": hostrules.ORACLE, "op9_topk": topk.ORACLE}
