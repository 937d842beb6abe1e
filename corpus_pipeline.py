"""From raw documents to a mix of token ids: five stages, each over all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from brackenlog.llm import lang_id, mixing, near_dedup, pieces
from brackenlog.llm.substring_dedup import dedup_substrings
from brackenlog.session import fresh_dir, small_batches

#: A document goes if no language has this share of its positions; four in ten still leaves
#: documents with passages in a second language.
LEAST_SCORE = 0.4

#: No SQL: a trained network and a tokenizer are not expressible. Tests compare with brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what has no letters or no language; fills null languages with the predicted one.

    Without labelled rows to learn from no language is known, and every text with a letter stays.
    Null and empty texts go, very long ones are read whole, repeated rows are judged alike, and an
    empty table stays empty.
    """
    small_batches(spark)
    net = lang_id.train(docs.where(~lang_id.held_out("doc_id")).select("text", "lang"))
    if not net.labels:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = lang_id.predict(docs, net)
    kept = found.where((F.col("lang_pred") != lang_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*(f"`{c}`" for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest doc_id.

    Sets are of five words, and links need a similarity of 0.8. Texts without words stay, rows
    that repeat an id are judged by their texts, and an empty table stays empty.
    """
    small_batches(spark)
    return near_dedup.keep_one(docs, threshold=80, size=5)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that an earlier document holds; other texts stay as they are.

    Nulls and texts without a repeated window are unchanged; a null doc_id comes after all others.
    """
    small_batches(spark)
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    found = dedup_substrings(docs, keep=others, rejoin=False)
    found = found.withColumns({"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")})
    return found.select(*(f"`{c}`" for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; texts without words are never taken."""
    small_batches(spark)
    return mixing.emit(mixing.mix(docs))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix; null ids for a null text."""
    small_batches(spark)
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), ("doc_id", "lang", "source"))


STAGES = [
    ("language id", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("repeated passages", drop_repeated_passages),
    ("mix", mix_sources),
    ("pieces", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = fresh_dir(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
