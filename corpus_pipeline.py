"""The corpus pipeline: raw documents to packed training sequences, in four stages.

quality: documents that the classifier rejects go. near_duplicates: one document of each SimHash component stays. mixing:
each source is drawn to its target, a document appearing as many times as the mix takes it. packing: the pieces of
sequences of token ids. Every stage works on all that its predecessor kept.

Defined results, of any stage: rows keep all their columns, of any type and name; ids of 64 bits are kept exact beside null
ids; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringseq.llm import mixing, packing, quality, simhash
from ringseq.llm.common import save, table
from ringseq.llm.queries import GOOD, MIX_WEIGHTS, TOKENIZER


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text scores GOOD or more; learnt from labelled rows that aren't held out.

    Defined results: null and empty texts are scored as one empty line, and go or stay by that; equal texts share their
    score; without labels of both kinds all rows have one score.
    """
    field, score = quality.train(docs, table(spark, sf_dir, "labels")), "score"
    while score in docs.columns:
        score += "_"
    return quality.scored(docs, field, to=score).where(F.col(score) >= GOOD).drop(score)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of fingerprints: the first by doc_id (null last), then by a hash of the row.

    Defined results: null, empty and blank texts are one component; repeated rows leave one.
    """
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it.

    Defined results: texts without a word are never taken; a null source is one of its own, last in order; repeated rows
    are drawn one by one.
    """
    whole = docs.select("doc_id", "source", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    mixed = mixing.mix(whole, MIX_WEIGHTS, carry=["row"])
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Defined results: null and empty texts are the end id alone; repeated rows are packed as often as they come.
    """
    return packing.pack(docs, TOKENIZER)


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: A field trained by gradient, fingerprints and encodings aren't expressible in SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = save(docs, name)
    return docs
