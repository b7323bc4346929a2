"""A corpus pipeline of five of the operators: each stage works on all that its predecessor kept.

Stages write Parquet into the shared folder and the next one rereads it. Null texts count as empty
and are judged like any text; extra columns of the documents pass through the filtering stages; an empty
table passes through as an empty one. Mixing shows in the order of the written rows, which packing reads from the
files and keeps: the first sequences hold the first documents of the mix, up to one window of packing.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.llm import jaccard_join, mixing, packing, quality_model, quality_rules
from tillpoint.llm.catalog import SEQUENCE, table
from tillpoint.llm.common import save
from tillpoint.session import scratch_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the rule ensemble, learnt from `labels`, accepts."""
    model = quality_model.train_quality_model(docs, table(spark, sf_dir, "labels"), lambda: ~quality_model.held_out())
    # written before the filter, or the filter would be pushed into the scoring and repeat it
    whole = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_document"))
    scored = save(quality_model.score_quality(whole, model).select("_document", "predicted"), "scored")
    return scored.where("predicted = 1").select("_document.*")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose votes make them likely good and that pass the base rules."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of texts linked by a Jaccard similarity of 0.8 or more."""
    return jaccard_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of their places in the mix."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 2048 tokens, numbered in the order of the mix."""
    ordered = mixing.written_order(docs).select("row.doc_id", "row.text", "position")
    return packing.pack_in_order(ordered, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, size=SEQUENCE)


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", rules), ("ngram_jaccard_join", near_duplicates),
          ("source_mixing", mix), ("best_fit_packing", pack)]

#: The stages fit models and pack by rank, which SQL does not express; tests/llm hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from `documents` through all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
