"""The corpus pipeline: quality, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; each is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents. Nulls: a null text is an empty one, a null id a value like
any other; repeated rows are near-duplicates of each other, so one stays. An
empty table passes through all stages as one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posframe.llm import packing, quality, similar, substrings
from posframe.llm.common import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (fitted on the labelled documents of
    the corpus) doesn't give a score below 0.5."""
    model = quality.fit(quality.training(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return quality.score(docs, model, keep=tuple(docs.columns)).filter("__score >= 0.5").select(docs.columns)


def near_duplicate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are linked by a five-word similarity
    of 0.8 or more, found by SimHash: that of the least id."""
    return similar.one_of_each(docs).select(docs.columns)


def substring_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of words that repeat in what is left; a document
    from which nothing is removed keeps its text as it is."""
    out = substrings.dedup(docs, keep=tuple(docs.columns))
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(F.decode("kept", "UTF-8"))
    return out.withColumn("text", text).withColumn("n_chars", F.when(F.size("spans") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(docs.columns)


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, as op3 returns them."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
