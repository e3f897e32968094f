"""Token counts of the documents in flat token files, found by scanning for separators.

A token file is nothing but ids of a fixed width; a document ends at an end-of-document id.
The files are cut into blocks of equal size, read where they are by range, and searched with
numpy. What a block knows by itself is how many documents end in it and where; which document
it begins in, and how many tokens of it came before, follow from a prefix scan over the blocks'
summaries. A block is a task's unit, so one huge file is as good as many small ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import dealt, file_system, stored

#: Bytes of a block; a multiple of every width.
BLOCK = 1 << 22
#: Blocks whose summaries are scanned in one go; the scan has two levels.
RUN = 1 << 12

_BLOCKS = "file string, block bigint, start bigint, n_tokens bigint, ends array<int>"


def _texts_of(separator: int, width: int) -> str:
    """The separator's bytes as Latin-1 text, for the writer's line separator."""
    return int(separator).to_bytes(width, "little").decode("latin-1")


def file_number(file: Column) -> Column:
    """The number of a written file: the rows of a task of the writer. Its name is another in each run."""
    return F.regexp_extract(file, r"/part-([0-9]+)-[^/]*\z", 1).try_cast("bigint")


def write_token_files(tokens: Column, rows: DataFrame, folder: str, separator: int, width: int) -> None:
    """Writes one flat file per task: each row's ids (BINARY) and the separator behind them.

    The plain text writer puts out bytes as they are, with its commit protocol and on any file
    system of the cluster. A null row is an empty document.
    """
    line = F.coalesce(tokens, F.lit(b"")).cast("string")
    (
        rows.select(line.alias("value"))
        .write.option("lineSep", _texts_of(separator, width))
        .option("encoding", "ISO-8859-1")
        .text(folder)
    )


def blocks(spark: SparkSession, folder: str, separator: int, width: int, block: int = BLOCK) -> DataFrame:
    """One row per block: its file, number, first token, tokens, and where separators are in it.

    ``ends`` is bounded by the block's size. Bytes behind the last whole id of a file are left out.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "length")  # no content is read
    cut = files.where(F.col("length") >= width).select(
        F.col("path").alias("file"),
        "length",
        F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / block))).alias("block"),
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = file_system(row["file"])
                at = row["block"] * block
                n = min(block, row["length"] - at) // width
                with system.open_input_file(path) as source:
                    ids = np.frombuffer(source.read_at(n * width, at), f"<u{width}")
                ends = np.flatnonzero(ids == separator).astype(np.int32)
                yield pa.RecordBatch.from_pydict(
                    {
                        "file": pa.array([row["file"]]),
                        "block": pa.array([row["block"]], pa.int64()),
                        "start": pa.array([at // width], pa.int64()),
                        "n_tokens": pa.array([n], pa.int64()),
                        "ends": pa.array([ends], pa.list_(pa.int32())),
                    }
                )

    # a block is megabytes to read and a row to send, so blocks are dealt evenly over tasks
    return dealt(cut).mapInArrow(scan, _BLOCKS)


def _carried(found: DataFrame) -> DataFrame:
    """(file, block, done, open_at): what came before each block of its file, documents ended, and the token at which
    the document that is open at its start began. Two levels: inside runs of blocks, over runs. Only summaries are
    scanned, not the places of separators."""
    last = F.element_at("ends", -1)
    found = found.select(
        "file",
        "block",
        F.floor(F.col("block") / RUN).alias("run"),
        F.size("ends").cast("bigint").alias("n_ends"),
        F.when(F.size("ends") > 0, F.col("start") + last + 1).alias("reached"),
    )
    inside = W.partitionBy("file", "run").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    runs = found.groupBy("file", "run").agg(F.sum("n_ends").alias("n"), F.max("reached").alias("r"))
    before = W.partitionBy("file").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select("file", "run", F.sum("n").over(before).alias("n"), F.max("r").over(before).alias("r"))
    return found.join(runs, ["file", "run"]).select(
        "file",
        "block",
        (F.coalesce(F.sum("n_ends").over(inside), F.lit(0)) + F.coalesce("n", F.lit(0))).alias("done"),
        F.coalesce(F.max("reached").over(inside), "r", F.lit(0)).alias("open_at"),
    )


def token_counts(
    spark: SparkSession, folder: str, separator: int, width: int = 2, block: int = BLOCK
) -> DataFrame:
    """One row per document: file, doc_no (from 0 in its file), first_token, n_tokens.

    Separators are not counted. A document may span any number of blocks and may be empty.
    Tokens behind the last separator of a file are a document without an end; a file that ends
    with a separator has none. A file without a whole id, and an empty folder, give no rows.
    """
    found = stored(blocks(spark, folder, separator, width, block), "token-blocks")
    known = found.join(_carried(found), ["file", "block"])
    begins = F.transform(
        F.col("ends"),
        lambda end, i: F.struct(
            (F.col("done") + i).alias("doc_no"),
            F.when(i == 0, F.col("open_at"))
            .otherwise(F.col("start") + F.get("ends", i - 1) + 1)
            .alias("first_token"),
            (F.col("start") + end).alias("end"),
        ),
    )
    ended = known.select("file", F.explode(begins).alias("d")).select(
        "file",
        F.col("d.doc_no").alias("doc_no"),
        F.col("d.first_token").alias("first_token"),
        (F.col("d.end") - F.col("d.first_token")).alias("n_tokens"),
    )
    # what is open at the end of a file: one row per file from the summaries
    reached = F.when(F.size("ends") > 0, F.col("start") + F.element_at("ends", -1) + 1)
    tails = found.groupBy("file").agg(
        F.sum(F.size("ends").cast("bigint")).alias("doc_no"),
        F.coalesce(F.max(reached), F.lit(0)).alias("first_token"),
        F.sum("n_tokens").alias("total"),
    )
    tails = tails.where("total > first_token").select(
        "file", "doc_no", "first_token", (F.col("total") - F.col("first_token")).alias("n_tokens")
    )
    return ended.unionByName(tails)
