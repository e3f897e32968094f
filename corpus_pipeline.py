"""From documents to token ids: toxicity, exact copies, near copies, source mixture, byte-level BPE.

Every stage takes all rows that the one before kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import byte_bpe, exact_dedup, mixing, ngram_join, toxicity
from marginalia.llm.frames import bounded_batches, stored
from marginalia.llm.queries import OTHER_SHARES, SHARES, table, vocabulary_path

#: Near copies: five-word shingles, a Jaccard similarity of 0.8 or more.
NEAR = ngram_join.Similarity(5, 80, 100)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier calls toxic go; it is fitted on those labelled."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each content stays, the one with the smallest doc_id."""
    bounded_batches(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one with the smallest doc_id."""
    bounded_batches(spark)
    return ngram_join.drop_similar(docs, NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated towards the target shares of their sources, and shuffled."""
    return mixing.mix(docs, SHARES, OTHER_SHARES, seed=9).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (little-endian unsigned 16-bit) and whether decoding them
    gives the text back."""
    bounded_batches(spark)
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    rows = byte_bpe.round_trip(docs.select("doc_id", "source", "text", digest.alias("was")), vocabulary_path(), narrow=True)
    same = F.sha2("decoded", 256) == F.col("was")
    return rows.select("doc_id", "source", "n_tokens", "ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_tokens),
]

#: Trained classifiers and draws cannot be written in SQL; the tests have brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
