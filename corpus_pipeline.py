"""A training corpus from documents, in five stages.

Toxic documents go, then those of low quality; of each group of near duplicates the document with
the smallest id stays; documents with copies of benchmark items go; the rest is encoded. Every
stage reads the Parquet files of the one before; all but the last keep the columns of documents.

Null texts count as empty; documents with a null doc_id pass the stages that work by id; repeated
rows are judged alike and stay repeated; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.llm import bpe, decontamination, jaccard, quality, toxicity
from foldline.llm.common import broadcast_below, crc_mod, stored, table

#: No SQL: learnt models and alignments aren't expressible.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 4) != 2), "toxic")
    return docs.filter(toxicity.scorer(spark, model)("text") < 0.3)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    weights = quality.fit(docs, table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 3) != 1), "quality")
    return docs.filter(quality.scorer(spark, weights)("text") >= 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, Jaccard similarity of 0.8 or more."""
    classes = jaccard.jaccard_components(docs, 5, 8, 10)
    copies = stored(classes.filter("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(broadcast_below(copies), "doc_id", "left_anti").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leaks = stored(decontamination.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct())
    return docs.join(broadcast_below(leaks), "doc_id", "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, n_split and packed ids."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
