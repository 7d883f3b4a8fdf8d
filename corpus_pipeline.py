"""The corpus pipeline: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from harborline.llm import exact_dedup, language_id, near_copies, sentence_pieces, source_mix
from harborline.llm.common import table
from harborline.llm.queries import PIECE_MODEL
from harborline.session import spool


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with that language as their ``lang``; those without a letter go.

    Profiles are learned from the labelled documents at hand that are not held out. Rows
    with a null key are told but not learned from; repeated rows stay; an empty table gives
    no rows; columns of any name are carried.
    """
    profiles = language_id.train(docs.where(~language_id.held_out()))
    # Numbered columns can't clash with those of the prediction.
    numbered = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    told = language_id.predict(docs.toDF(*numbered.values()), profiles, list(numbered.values()), text=numbered["text"])
    kept = told.where(F.col("lang_pred") != language_id.UNKNOWN)
    return kept.select(*[F.col("lang_pred" if name == "lang" else own).alias(name) for name, own in numbered.items()])


def one_of_each_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id; null counts as empty, a null id loses to any other.

    A row that repeats id and text stays once; an empty table gives no rows.
    """
    return exact_dedup.drop_copies(docs, keep="largest")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard of five-word shingles 0.8 or more) the document with the smallest id.

    Rows with a null id stay; rows that repeat id and text stay or go together; an empty table gives no rows.
    """
    return near_copies.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them; those with a null id or no word go.

    Repeats of an id and size are each taken as often as the most taken; an empty table gives no rows.
    """
    return source_mix.repeat_to_mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with the scores of its two best segmentations."""
    return sentence_pieces.round_trip(docs, PIECE_MODEL)


STAGES = [
    ("language ID", known_language),
    ("exact dedup", one_of_each_text),
    ("near-dedup", one_of_near_copies),
    ("source mixing", mixed),
    ("piece encoding", encoded),
]

#: Near copies, the mix and segmentations are beyond SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = spool(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return docs
