"""Documents to packed training windows, in stages that each read what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, langid, mixing, packing, simhash, substrings
from tidemark.session import ship

#: A document whose likeliest language has less of the likelihood than this is rejected.
LEAST_SCORE = 0.5


#: The columns that stages work on; others are carried along.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learnt; one without letters, or torn between languages, goes.

    A null lang is filled in by the prediction.
    """
    ship(spark)
    model = langid.fit(docs, F.lit(True))
    own, back = common.carried(docs, OWN)
    kept = langid.predict(own, model, keep=False).where((F.col("lang_pred") != langid.UND) & (F.col("lang_score") >= LEAST_SCORE))
    return back(kept.withColumn("lang", F.coalesce("lang", "lang_pred")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints link at 3 or fewer bits."""
    ship(spark)
    own, back = common.carried(docs, OWN)
    return back(simhash.dedup(own))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words that repeat anywhere; n_chars counts what is left.

    A passage goes wherever it stands, as in the operator's query: no copy is more original than another, and near
    copies have gone before. It is found by strings of 200 bytes that repeat, fewer than 51 words of prose take; one
    of fewer words goes from 400 bytes on. A document that consisted of passages alone, with no word left, goes too;
    one that had no word before stays.
    """
    ship(spark)
    own, back = common.carried(docs, OWN)
    left = substrings.dedup_passages(own, as_text=True)
    emptied = (F.size("passages") > 0) & ~F.col("kept").rlike(r"\S")
    return back(left.where(~emptied).withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("long")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks."""
    ship(spark)
    own, back = common.carried(docs, OWN)
    return back(mixing.mix(own))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training windows, piece by piece, with their token ids."""
    ship(spark)
    return packing.pack(docs, keep=False)


STAGES = [("language ID", language_id), ("SimHash near-dedup", near_dedup), ("suffix-array dedup", substring_dedup), ("mixing", mix), ("packing", pack)]

#: Trained models, hashes and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``; what the stages before give is written to the shared folder."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        written = common.Written(stage(spark, docs, sf_dir))
        if held:
            held.drop()  # the stage after it has been written
        docs, held = written.df, written
    return STAGES[-1][1](spark, docs, sf_dir)
