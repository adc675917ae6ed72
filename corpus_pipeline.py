"""The corpus pipeline: toxicity, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and gets what its predecessor kept, read again from Parquet.  All but the last
return the columns of documents, whatever they are called.  An empty table stays empty in every stage; texts are read
whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridframe.llm import bagminhash, common, packing, pfair, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, fitted on the labels of docs, scores below the threshold.

    Null and empty texts score as texts without a match and stay; repeated rows go or stay together; a null doc_id has no
    label but is scored like any other.
    """
    model = toxicity.fit(toxicity.labelled(docs, common.table(spark, sf_dir, "labels")))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest doc_id (nulls last), of repeated rows the first by file and row.

    Null, empty and wordless texts are like no other and all stay.
    """
    return bagminhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order of the Pfair mixture (square-root weights).

    A null source is a source like any other; repeated rows each have their place; nothing is dropped.
    """
    return pfair.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's pieces go in sequences of 1024 tokens, numbered in the order of the mixture.

    A null or empty text is one piece, the end id alone; repeated rows are packed once each; a null doc_id stays null.
    """
    return packing.packed(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("mixing", mix_sources), ("packing", pack)]

#: SQL can't express the learned grammar, the signatures or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.stored(docs, name)
    return docs
