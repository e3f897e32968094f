"""Byte-level BPE over Arrow batches with the tokenizers library.

The vocabulary writes every byte as one printable character; ``byte_table`` turns its pieces
back into bytes, so decoding is a lookup per id and works for pieces that hold only a part
of a character. Offsets follow from the lengths of the pieces.

A text is cut only where no piece can cross: before a single space between two characters
that are not blank. Such parts recur, so each worker keeps a bounded table of parts it has
encoded and asks the library for the others, many as one text. There is no shuffle; memory is
bounded by the Arrow batch, the table and the longest text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .frames import free_names

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Parts longer than this are not kept. Two tables of so many parts are: when the younger is full it
#: becomes the older, and parts found there move on, so frequent ones stay.
KEPT_LENGTH, KEPT_PARTS = 48, 60_000
#: Characters of new parts that the library gets as one text.
RUN = 1 << 15


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary.

    Printable characters of Latin-1 stand for themselves, the other bytes for the characters
    from U+0100 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, and back."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        to_byte = byte_characters()
        pieces = [b""] * self.tokenizer.get_vocab_size()
        for piece, i in self.tokenizer.get_vocab().items():
            if all(c in to_byte for c in piece):
                pieces[i] = bytes(map(to_byte.__getitem__, piece))
        # the byte table: all pieces one behind the other
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def of(path: str) -> Encoder:
        """The worker process's encoder for this file.

        Functions travel to workers by value, so a table of this module would last for one task only;
        the library's module lasts as long as the process.
        """
        import tokenizers

        loaded = tokenizers.__dict__.setdefault("_loaded_encoders", {})
        if path not in loaded:
            loaded[path] = Encoder(path)
        return loaded[path]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_parts(self, parts: list[str]) -> Iterator[bytes]:
        """Ids of parts, each with a space before it: several are one text for the library, and are
        told apart by their bytes."""
        run, size = [], 0
        for i, part in enumerate(parts):
            run.append(" " + part)
            size += len(part)
            if size >= RUN or i == len(parts) - 1:
                (ids,) = self._ids(["".join(run)])
                ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(p.encode()) for p in run])) + 1
                for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
                    yield ids[a:b].tobytes()
                run, size = [], 0

    @staticmethod
    def _cut(text: str) -> list[str]:
        """Parts between the spaces that no piece can cross, the spaces left out."""
        plain = text.replace("\n", "x").isprintable()  # then space and line feed are the only blanks
        if plain and not ("  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " "):
            return text.split(" ")
        return _CUT.split(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """One entry per text; small batches of texts, so that the tables stay bounded."""
        cut = [self._cut(text) for text in texts]
        if len(self.kept) > KEPT_PARTS:
            self.kept, self.older = {}, self.kept
        kept, older, new = self.kept, self.older, set()
        rows = []
        for parts in cut:
            first, *rest = parts
            ids = list(map(kept.get, rest))
            if None in ids:
                for i, part in enumerate(rest):
                    if ids[i] is None:
                        if part in older:
                            ids[i] = kept[part] = older[part]
                        else:
                            new.add(part)
            rows.append((first, rest, ids))
        found = dict(zip(new, self._encode_parts(list(new))))
        kept.update((part, ids) for part, ids in found.items() if len(part) <= KEPT_LENGTH)
        out = []
        for (_, rest, ids), first in zip(rows, self._ids([first for first, _, _ in rows])):
            if None in ids:
                ids = [found[p] if i is None else i for p, i in zip(rest, ids)]
            out.append(first.tobytes() + b"".join(ids))
        return out

    def decode(self, ids: bytes, width: int = 4) -> bytes:
        ids = np.frombuffer(ids, f"<u{width}")
        size = self.size[ids]
        ends = np.cumsum(size)
        if not len(ids):
            return b""
        return self.bytes[np.repeat(self.start[ids] - ends + size, size) + np.arange(ends[-1])].tobytes()

    def char_offsets(self, ids: bytes) -> np.ndarray:
        """Start of each id's piece in the text, in characters; a piece that begins inside a
        character has that character's place."""
        data = np.frombuffer(self.decode(ids), np.uint8)
        size = self.size[np.frombuffer(ids, "<u4")]
        starts = np.cumsum(size) - size
        begun = np.cumsum((data & 0xC0) != 0x80)  # characters up to each byte, that of the byte included
        return (begun[starts] - 1).astype(np.int32) if len(size) else np.zeros(0, np.int32)


def _batches(column: pa.Array, chars: int = 1 << 19) -> Iterator[list[str]]:
    """The texts of a column (null: empty) in runs of about ``chars`` characters."""
    run, size = [], 0
    for text in column:
        text = text.as_py() or ""
        run.append(text)
        size += len(text)
        if size >= chars:
            yield run
            run, size = [], 0
    yield run


def _fits(encoder: Encoder, narrow: bool) -> Encoder:
    """The encoder, if its ids can be put down in 16 bits where that is asked for."""
    if narrow and len(encoder.size) > 1 << 16:
        raise ValueError(f"ids up to {len(encoder.size) - 1} do not fit into 16 bits")
    return encoder


def _narrowed(ids: list[bytes]) -> list[bytes]:
    return [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]


def encode(
    docs: DataFrame, path: str, text: str = "text", offsets: bool = False, narrow: bool = False
) -> DataFrame:
    """Adds ``ids`` BINARY (little-endian unsigned 32-bit, ``narrow``: 16-bit) and ``n_tokens`` BIGINT
    and, if asked, ``offsets`` ARRAY<INT>: the character at which each id's piece begins.

    A vocabulary with ids beyond 16 bits is refused where ``narrow`` is asked for.
    A null or empty text has no ids. Strings of special tokens are ordinary text. Rows stay as
    they are, repeated ones too; taken names get underscores behind them.
    """
    names = free_names(docs, "ids", "n_tokens", *["offsets"] * offsets)
    kinds = [T.BinaryType(), T.LongType(), T.ArrayType(T.IntegerType())]
    schema = T.StructType([*docs.schema.fields, *map(T.StructField, names, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _fits(Encoder.of(path), narrow)
        for batch in batches:
            at = 0
            for texts in _batches(batch.column(text)):
                ids = encoder.encode(texts)
                part = batch.slice(at, len(ids))
                at += len(ids)
                new = [pa.array(_narrowed(ids) if narrow else ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
                if offsets:
                    new.append(pa.array([encoder.char_offsets(x) for x in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *names])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", width: int = 4) -> DataFrame:
    """Adds ``decoded`` BINARY from ids of ``width`` bytes: the bytes of the pieces, which are valid UTF-8 for whole texts; a
    sequence cut inside a character keeps the bytes of that part. Null ids count as none."""
    (name,) = free_names(rows, "decoded")
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            decoded = [encoder.decode(x.as_py() or b"", width) for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(decoded, pa.binary())], names=[*batch.schema.names, name]
            )

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, text: str = "text", narrow: bool = False) -> DataFrame:
    """``docs`` without ``text`` and with ids, n_tokens and decoded, as ``encode`` and then ``decode``
    give them, in one pass through one worker."""
    rest = docs.drop(text)
    others, names = rest.columns, free_names(rest, "ids", "n_tokens", "decoded")
    kinds = [T.BinaryType(), T.LongType(), T.BinaryType()]
    schema = T.StructType([*rest.schema.fields, *map(T.StructField, names, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _fits(Encoder.of(path), narrow)
        for batch in batches:
            at = 0
            for texts in _batches(batch.column(text)):
                ids = encoder.encode(texts)
                part = batch.slice(at, len(ids)).select(others)
                at += len(ids)
                new = [
                    pa.array(_narrowed(ids) if narrow else ids, pa.binary()),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([encoder.decode(x) for x in ids], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=schema.names)

    return docs.mapInArrow(run, schema)
