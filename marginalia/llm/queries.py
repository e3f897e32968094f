"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from . import (
    byte_bpe,
    byte_cnn,
    conversations,
    exact_dedup,
    fill_in_middle,
    labelled,
    mixing,
    ngram_join,
    token_files,
    toxicity,
    url_reputation,
    vector_codes,
    warc,
    weighted_sampling,
)
from .frames import bounded_batches, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Vocabulary file of the tokenizer and its id for the end of a document.
VOCABULARY, END_OF_DOCUMENT = "byte_bpe_50k.json", 50256

RULES = [
    url_reputation.Rule("allow", "com/"),
    url_reputation.Rule("block", "example.com/en/"),
    url_reputation.Rule("allow", "www.example.com/en/"),
    url_reputation.Rule("block", "net/es/"),
    url_reputation.Rule("block", "net/fr/"),
]

#: Target shares, by characters: the large first source is halved or so, a few are raised.
SHARES = {"src0": 0.20, "src1": 0.08, "src2": 0.06, "src3": 0.02}
OTHER_SHARES = 0.64


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_chat_formatting(spark, d):
    return conversations.format_chats(table(spark, d, "conversations"))


@query
def op2_ngram_join(spark, d):
    like = ngram_join.Similarity(3, 90, 100)
    return ngram_join.classes(table(spark, d, "documents"), like)


@query
def op3_token_counts(spark, d):
    docs = byte_bpe.encode(table(spark, d, "documents").select("text"), vocabulary_path(), narrow=True)
    folder = shared_folder(spark, "token-files")
    token_files.write_token_files(F.col("ids"), docs, folder, END_OF_DOCUMENT, 2)
    counts = token_files.token_counts(spark, folder, END_OF_DOCUMENT, 2)
    # a file's name is new in each run, its number is not
    return counts.withColumn("file", token_files.file_number(F.col("file")))


def _judged(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id",
        labelled.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


@query
def op4_quality(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    net = byte_cnn.fit(docs, table(spark, d, "labels"), "quality")
    return _judged(byte_cnn.score(docs, net), 0.3)


@query
def op5_url_filter(spark, d):
    labels = table(spark, d, "labels")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    outcomes = labels.select(F.col("doc_id").alias("page_id"), good.alias("good"))
    pages = table(spark, d, "pages").select("page_id", "url")
    judged = url_reputation.judge(pages, outcomes, RULES).drop("url")
    return judged.withColumn("bound", F.round("bound", 8))


@query
def op6_exact_dedup(spark, d):
    return exact_dedup.copies(table(spark, d, "documents"))


@query
def op7_fingerprints(spark, d):
    return weighted_sampling.edited_fingerprints(table(spark, d, "documents").select("doc_id", "text"))


@query
def op8_toxicity(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, d, "labels"), "toxic")
    return _judged(toxicity.score(docs, model), 0.5)


@query
def op9_mixing(spark, d):
    return mixing.mix(table(spark, d, "documents"), SHARES, OTHER_SHARES, seed=9)


@query
def op10_byte_bpe(spark, d):
    rows = byte_bpe.round_trip(table(spark, d, "documents").select("doc_id", "text"), vocabulary_path())
    return rows.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query
def op11_vector_codes(spark, d):
    return vector_codes.compress(table(spark, d, "embeddings"))


@query
def op12_warc(spark, d):
    folder = shared_folder(spark, "warc")
    warc.write_archives(table(spark, d, "pages"), folder)
    records = stored(warc.read_archives(spark, folder).drop("payload"), "warc-records")
    pages = warc.outermost(records).where(F.col("record_type").isin("response", "revisit"))
    return pages.select(
        warc.page_id_of("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.page_id_of("refers_to_id").alias("refers_to"),
    )


@query
def op13_fill_in_middle(spark, d):
    rows = fill_in_middle.restore(fill_in_middle.transform(table(spark, d, "documents"), seed=1))
    return rows.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )
