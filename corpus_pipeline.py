"""From raw documents to packed training windows: five stages, each an operator over all that the one before kept.

quality_rules       documents failing a rule, or of a rejected host, go
quality_classifier  documents scored below the classifier's limit go
near_dedup          one document of each group of near copies stays
secrets             literals given to sensitive names are masked in the texts that stay
packing             every remaining token gets its place in a window: (doc_id, piece, first_token, n_tokens, window_id, start)

A stage's result is written as Parquet to the shared folder and read again as the next one's documents, so a lost
executor repeats work of one stage only; a stage's folder is deleted when the next one's result is there. Nulls, empty tables and other cases: as the operators' docstrings say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltloom.llm import hostrules, packing, secrets, simhash, zclass
from voltloom.llm._shared import documents, drop, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return hostrules.keep(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model learns from labelled rows of the whole table: of docs alone, most bad ones are gone already."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return zclass.keep(docs, zclass.train(zclass.sample(documents(spark, sf_dir), labels)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.lengths(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Compression sizes and SimHash votes are beyond SQL; tests compare run() with a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = documents(spark, sf_dir), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    last = None
    for k, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if last:  # nothing reads it any more
            drop(spark, last)
        last = at
    return docs
