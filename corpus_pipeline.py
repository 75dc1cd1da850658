"""Corpus pipeline: quality classifier, quality rules, near duplicates, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs.  All but the last return the
columns of `documents`; the last returns doc_id, ids, n_tokens and round_trip.

The mix keeps whole rows: a row's copies (0, 1 or 2) are its taken share of
itself, rounded by a draw seeded with its doc_id.

Edge cases, alike in all stages: an empty table gives none; extra columns stay,
whatever their names, until the last stage; very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fronda.llm import classifier, jaccard, mixing, pieces, quality_rules
from fronda.llm.common import Scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, trained on this stage's labelled rows, predicts as good.

    Each row is judged by itself: null and empty texts by the score of all-zero statistics, null ids and repeated rows
    like others; a score equal to the threshold stays; without labels every row scores 0.5 and stays.
    """
    model = classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classifier.keep_good(docs, model)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep.

    Each row is judged by itself; null, empty and short texts go, repeated rows go or stay together, null ids are no matter;
    a count equal to its limit stays.
    """
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that of its least doc_id, null ids last.

    Of repeated rows one stays, null ids included; rows that share an id but not a text are judged apart; rows without
    words (null or empty texts) link with nothing and all stay.
    """
    return jaccard.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated or left out so that sources near their target weights.

    Rows without words (null or empty texts) take nothing and go; null sources are one source, the last in order; rows of
    one id, null included, share the draw and the share of all rows of that id.
    """
    return mixing.mixed_copies(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every row, and whether they decode to its text.

    Null and empty texts have no ids; null ids and repeated rows keep a row each; equal texts get equal ids.
    """
    found = pieces.encode_documents(docs, check=True)
    return found.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_filter),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("sentencepiece", tokens),
]

#: SQL can express neither the classifier nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over `documents`."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
