"""Corpus pipeline: stages applied one after another to ``documents``, each written as Parquet and reread.

Toxic documents go, low-quality documents go, repeated lines go, one document of each near-duplicate class
stays, and what is left is packed into sequences.

Defined cases.  Null and empty texts and texts without words fail the quality rules, so that later stages meet none of
the corpus' own; documents that lose all their lines to earlier ones are copies of each other without words, and one of each
text stays.  A null doc_id is never learned from, owns no line and is nobody's copy: it goes by its text alone and is packed.  Rows that
repeat a doc_id and its text are one document after the near-duplicate stage.  Texts are read whole; other columns, whatever their names,
are carried to the last stage; an empty table packs into nothing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.llm import op1_best_fit_packing, op3_suffix_repetition, op5_crf_toxicity, op8_bayes_jaccard_join, op10_line_dedup
from quaystone.llm.common import stored, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op5_crf_toxicity.clean(docs, docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op3_suffix_repetition.passing(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = op10_line_dedup.drop_repeated_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return out.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op8_bayes_jaccard_join.one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_best_fit_packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("best_fit_packing", packing),
]

#: A learned model and minimal packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
