"""Fill-in-the-middle: a text is cut in three, and what stood in the middle comes last.

The text's bytes are copied once into a bytearray, with room for the sentinels before its parts. Two
segments that stand side by side change places in that array by three reversals (each of them,
then both together), which needs no second array. Restoring finds the sentinels, rotates back and
takes them out, so it needs the form and the output and nothing else.

Everything that is drawn is a function of seed and doc_id. A narrow pass over whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sentinels of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Of a hundred texts, so many are transformed, and so many of those have the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20

PLAIN, PSM, SPM = "plain", "psm", "spm"


class Draw(NamedTuple):
    """Four 32-bit numbers that hang on seed and document alone."""

    first_cut: int
    second_cut: int
    transformed: int
    suffix_first: int


def draw(seed: int, doc_id: int | None) -> Draw:
    """The first four groups of eight digits of a digest; a null doc_id is the empty text in it."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    return Draw(*np.frombuffer(hashlib.sha256(name.encode()).digest()[:16], ">u4").tolist())


def rotate(data: bytearray, start: int, middle: int, end: int) -> None:
    """Lets data[start:middle] and data[middle:end] change places by three reversals."""
    for a, b in ((start, middle), (middle, end), (start, end)):
        data[a:b] = data[a:b][::-1]


def code_point_starts(data: bytes) -> np.ndarray:
    """Where each code point begins: at every byte that continues none."""
    return np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)


def transform_bytes(data: bytes, d: Draw, marks: Sequence[bytes], transformed: int, suffix_first: int) -> tuple:
    """(n, form, prefix length, middle length, output) of one text; the lengths are None if it is plain."""
    starts = code_point_starts(data)
    n = len(starts)
    if not n or d.transformed % 100 >= transformed or any(mark in data for mark in marks):
        return n, PLAIN, None, None, data
    low, high = sorted((d.first_cut % (n + 1), d.second_cut % (n + 1)))
    cut, end = (int(starts[at]) if at < n else len(data) for at in (low, high))
    prefix, suffix, middle = marks
    out = bytearray(data)
    out[end:end] = suffix
    out[cut:cut] = middle
    out[:0] = prefix
    middle_at = len(prefix) + cut
    suffix_at = middle_at + len(middle) + end - cut
    form = SPM if d.suffix_first % 100 < suffix_first else PSM
    # prefix, middle, suffix: the suffix goes before the middle, or before both
    rotate(out, 0 if form == SPM else middle_at, suffix_at, len(out))
    return n, form, low, high - low, bytes(out)


def restore_bytes(data: bytes, form: str, marks: Sequence[bytes]) -> bytes:
    """The text of an output, by the inverse of its rotation."""
    if form == PLAIN:
        return data
    prefix, suffix, middle = marks
    out = bytearray(data)
    if form == SPM:
        before = out.find(prefix)  # as long as the suffix with its sentinel is
        rotate(out, 0, before, len(out))
        suffix_at = len(out) - before
    else:
        suffix_at, middle_at = out.find(suffix), out.find(middle)
        rotate(out, suffix_at, middle_at, len(out))
        suffix_at += len(out) - middle_at
    del out[suffix_at : suffix_at + len(suffix)]
    middle_at = out.find(middle)
    del out[middle_at : middle_at + len(middle)]
    del out[: len(prefix)]
    return bytes(out)


def _marks(sentinels: Sequence[str]) -> list[bytes]:
    """Sentinels as bytes. None may lie in another or overlap with text around it, so that the places
    where they are found in an output are those where they were put."""
    marks = [s.encode() for s in sentinels]
    for x in marks:
        for y in marks:
            inside = x != y and x in y
            overlap = any(x[-k:] == y[:k] for k in range(1, min(len(x), len(y))))
            if inside or overlap:
                raise ValueError("sentinels must not overlap with each other or themselves")
    if len(set(marks)) != 3 or not all(marks):
        raise ValueError("three different sentinels are needed")
    return marks


def _bytes(texts: pa.Array) -> Iterator[bytes]:
    return (b"" if t is None else t for t in texts.cast(pa.binary()).to_pylist())


def transform(
    docs: DataFrame,
    seed: int = 1,
    text: str = "text",
    sentinels: Sequence[str] = SENTINELS,
    transformed: int = TRANSFORMED,
    suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n, form, prefix_chars, middle_chars, output.

    The text's n code points are cut at two drawn places (prefix, middle and suffix may be empty). The form is
    ``psm`` (sentinel and prefix, suffix, middle), ``spm`` (suffix, prefix, middle) or ``plain``, which is
    the text itself: ``transformed`` of a hundred texts are not plain, of those ``suffix_first`` of a hundred are
    spm. A null text counts as empty. Empty texts and those that hold a sentinel are always plain, and
    prefix_chars and middle_chars of plain texts are null. A row with a null doc_id draws as one with an empty id;
    repeated rows have equal results. Other columns play no part, whatever their names. No rows give no rows.
    """
    marks = _marks(sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = [
                transform_bytes(data, draw(seed, i), marks, transformed, suffix_first)
                for i, data in zip(ids, _bytes(batch.column("text")))
            ]
            n, form, low, middle, out = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n": pa.array(n, pa.int64()),
                    "form": pa.array(form, pa.string()),
                    "prefix_chars": pa.array(low, pa.int64()),
                    "middle_chars": pa.array(middle, pa.int64()),
                    "output": pa.array(out, pa.binary()).view(pa.string()),
                }
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col(f"`{text}`").alias("text")).mapInArrow(
        run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    )


def restore(rows: DataFrame, sentinels: Sequence[str] = SENTINELS, output: str = "output") -> DataFrame:
    """Adds ``restored``: the exact text that the row's output was made of, from ``form`` and ``output``.

    A null output gives an empty text, a null form counts as plain. ``rows`` must not have a column ``restored``.
    """
    marks = _marks(sentinels)
    schema = T.StructType([*rows.schema.fields, T.StructField("restored", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = batch.column("form").to_pylist()
            texts = [restore_bytes(data, form or PLAIN, marks) for form, data in zip(forms, _bytes(batch.column(output)))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.binary()).view(pa.string())], names=schema.names
            )

    return rows.mapInArrow(run, schema)
