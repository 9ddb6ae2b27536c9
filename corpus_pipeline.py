"""A training corpus from raw documents, in five stages; each applies one operator of ``kinfold.llm`` to all that came before.

1. quality: documents the classifier rejects go;
2. near_duplicates: of each group of linked documents the one with the least doc_id stays, and of rows of one doc_id the one
   whose text has the least hash, which is the one that speaks for the document in the join;
3. decontamination: documents that hold a benchmark window go;
4. secrets: secrets are replaced by a mark, the documents stay;
5. packing: the rest is packed into sequences of at most 4,096 tokens.

A stage takes (spark, docs, sf_dir) and returns the columns of ``docs``, but for the last, whose rows are pieces.  Null
texts count as empty; rows without a doc_id pass the filters they cannot be judged by and take no part in packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm._base import read, sized, stored
from kinfold.llm.best_fit_packing import pack
from kinfold.llm.decontamination import clean
from kinfold.llm.jaccard_join import near_duplicates
from kinfold.llm.quality_classifier import accepted
from kinfold.llm.secret_scan import redact
from kinfold.session import ship


def _sized(docs: DataFrame) -> DataFrame:
    """Few documents in few partitions; counted from the files' footers, and without effect on a large table."""
    return sized(docs, docs.count())


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return accepted(_sized(docs), read(spark, sf_dir, "labels"), threshold=0.3)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    classes = stored(near_duplicates(docs, size=5, percent=80), "classes")
    later = classes.where("component_id != doc_id").select("doc_id")
    kept = _sized(docs).join(later, "doc_id", "left_anti").select(docs.columns)
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_m")).where("_m > 1").select("doc_id")
    several = stored(several, "several")
    if several.isEmpty():
        return kept
    row = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)))
    own = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(*docs.columns).alias("b"))
    one = kept.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, own).alias("_row"))
    one = one.select(*(F.col(f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns)))
    return kept.join(several, "doc_id", "left_anti").select(docs.columns).unionByName(one)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return clean(_sized(docs), read(spark, sf_dir, "benchmark"), window=10)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    out = redact(_sized(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pack(_sized(docs), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [("quality", quality), ("near_duplicates", dedup), ("decontamination", decontaminate), ("secrets", secrets), ("packing", packing)]

#: The trained classifier, the tokenizer and the packing are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
