"""The corpus pipeline: from documents to packed training sequences.

Each stage gets all that its predecessor kept, as a stored table, and gives the columns
of documents; the last gives pieces of packed sequences. See the operators in
codequarry/llm for what they do with nulls, empty texts, repeated rows and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from codequarry.llm.common import stash, table
from codequarry.llm.tokens import tokenizer_path

REJECT_FROM = 0.5  # toxicity score


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under REJECT_FROM; the grammar learns from labels."""
    grammar = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_of(docs, grammar) < REJECT_FROM)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal normalised texts the one with the smallest doc_id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each component of the Jaccard join."""
    found = ngram_join.near_duplicates(docs)
    gone = stash(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct(), "near-copies")
    gone = F.broadcast(gone) if gone.count() <= ngram_join.MOST_BROADCAST else gone
    return docs.join(gone, docs["doc_id"] == gone["_id"], "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document: copies and excerpts, under its doc_id."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, each with its sequence and offset."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Learnt scores, tokenizer ids and the linear program aren't SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
