"""Vector codes: product quantisation with equal-average nearest-neighbour search.

Vectors of floor(scale * x) are cut into equal parts, and each part is replaced by the number of the nearest
entry in its position's codebook. Entries are kept in order of the sum of their components. If two vectors of
dimension k have sums that differ by g, their squared distance is g * g / k at least, so the search begins at the entry whose
sum is next to the part's and goes outward to both sides until g * g / k is strictly greater than the best distance found.
All numbers are whole, so results are the same however rows are dealt out.

Codebooks are fitted on all vectors: a round assigns every part and adds up the parts of each entry, in each task
and then over all; only these sums (one row per part and entry) come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import spread_join, stored

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Whole numbers lie within this, or are taken for it, so that distances of up to 2,000 components do not overflow.
LIMIT = 1 << 25
SALTS = 32


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """ARRAY<INT> of floor(scale * x), held within +-LIMIT."""
    return F.transform(
        vector,
        lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int"),
    )


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are there and finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


@dataclass
class Codebooks:
    """``entries`` (part, entry, place in the part) of vectors with ``dim`` components."""

    entries: np.ndarray
    dim: int

    def __post_init__(self):
        sums = self.entries.sum(axis=2)
        self.order = np.argsort(sums, axis=1, kind="stable").astype(np.int64)
        self.sums = np.take_along_axis(sums, self.order, axis=1)
        self.ordered = np.take_along_axis(self.entries, self.order[:, :, None], axis=1)

    def split(self, vectors: np.ndarray) -> np.ndarray:
        """(vector, part, place): zeros fill up the last part."""
        parts, _, width = self.entries.shape
        room = parts * width - vectors.shape[1]
        return np.pad(vectors, ((0, 0), (0, room))).reshape(len(vectors), parts, width)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest entry, its squared distance) of each vector's parts; of equally near
        entries the first one."""
        parts, count, width = self.entries.shape
        pieces = self.split(vectors)
        part = np.tile(np.arange(parts), len(pieces))
        flat = pieces.reshape(-1, width)
        total = flat.sum(axis=1)
        best, which = np.full(len(flat), np.iinfo(np.int64).max), np.full(len(flat), count)
        begin = np.empty(len(flat), np.int64)  # the first entry whose sum is not smaller
        for p in range(parts):
            begin[p::parts] = np.searchsorted(self.sums[p], total[p::parts])
        sides = []
        for step, at in ((1, begin), (-1, begin - 1)):
            live = np.flatnonzero((at >= 0) & (at < count))
            sides.append((step, live, at[live]))
        while sides:  # a step to either side, for as long as a part is searched there
            sides = [(step, *self._step(flat, total, part, best, which, step, live, at)) for step, live, at in sides]
            sides = [side for side in sides if len(side[1])]
        return which.reshape(-1, parts), best.reshape(-1, parts)

    def _step(self, flat, total, part, best, which, step, live, at) -> tuple[np.ndarray, np.ndarray]:
        """Looks at entry ``at`` of the order for each of the parts ``live``; those that go on, and their next entry."""
        width, count = flat.shape[1], self.sums.shape[1]
        gap = np.minimum(np.abs(total[live] - self.sums[part[live], at]), 1 << 31)
        # gap * gap / width > best, strictly, ends the search on this side
        near = -(-(gap * gap) // width) <= best[live]
        live, at = live[near], at[near]
        away = flat[live] - self.ordered[part[live], at]
        far, number = (away * away).sum(axis=1), self.order[part[live], at]
        better = (far < best[live]) | ((far == best[live]) & (number < which[live]))
        best[live[better]], which[live[better]] = far[better], number[better]
        at = at + step
        inside = (at >= 0) & (at < count)
        return live[inside], at[inside]

    def sha256(self) -> str:
        """Of all entries' components as decimals, by part, entry and place, with commas between."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _matrix(column: pa.Array) -> np.ndarray:
    """(vector, component) of vectors of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def prepared(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v), stored: the usable rows, as whole numbers."""
    v = F.col(f"`{vector}`")
    return stored(
        vectors.where(usable(v)).select(F.col("vec_id").cast("bigint"), "label", whole_numbers(v, scale).alias("v")), "vectors"
    )


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks for ``prepared`` rows: they begin as the parts of the vectors with the smallest vec_ids (null
    last, ties in order of the vectors) and are moved ``rounds`` times to the floor of the mean of the parts assigned to
    each entry. Entries without parts stay. The length of the first vector counts; fewer vectors than
    ``entries`` give fewer entries, and none None."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).select(F.size("v").alias("dim")).first()
    if first is None:
        return None
    dim = first["dim"]
    rows = rows.where(F.size("v") == dim)
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()  # bounded
    width = max(-(-dim // parts), 1)
    start = np.zeros((len(seeds), parts * width), np.int64)
    start[:, :dim] = [r["v"] for r in seeds]
    books = Codebooks(start.reshape(len(seeds), parts, width).transpose(1, 0, 2).copy(), dim)
    for _ in range(rounds):
        books = _moved(rows, books)
    return books


def _moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every part to its nearest entry, and every entry to the mean of its parts."""
    parts, count, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((parts * count, width), np.int64), np.zeros(parts * count, np.int64)
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch.column("v"))
                which, _ = books.nearest(vectors)
                slot = (which + np.arange(parts) * count).ravel()
                np.add.at(sums, slot, books.split(vectors).reshape(-1, width))
                n += np.bincount(slot, minlength=parts * count)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict(
            {
                "slot": pa.array(used, pa.int32()),
                "n": pa.array(n[used], pa.int64()),
                "sums": pa.array(list(sums[used]), pa.list_(pa.int64())),
            }
        )

    added = rows.select("v").mapInArrow(run, "slot int, n bigint, sums array<bigint>")
    total = added.groupBy("slot").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums")
    )
    entries = books.entries.copy()
    for r in total.collect():  # one row per part and entry
        entries[r["slot"] // count, r["slot"] % count] = [s // r["n"] for s in r["sums"]]
    return Codebooks(entries, books.dim)


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) of ``prepared`` rows: the entry of each part in two hexadecimal digits, and the squared
    distance to what the code stands for. Vectors of another length have neither."""
    parts = books.entries.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = np.array([n == books.dim for n in batch.column("v").value_lengths().to_pylist()], bool)
            code, error = np.full(batch.num_rows, None), np.full(batch.num_rows, None)
            if fits.any():
                which, far = books.nearest(_matrix(batch.column("v").filter(pa.array(fits))))
                digits = which.astype(np.uint8).tobytes().hex()
                code[fits] = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
                error[fits] = far.sum(axis=1).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )

    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id bigint, label {kind}, code string, error bigint")


def decode(codes: DataFrame, books: Codebooks, code: str = "code") -> DataFrame:
    """Adds ``decoded`` ARRAY<BIGINT>: the vector of whole numbers that a code stands for (null for a null code)."""
    schema = T.StructType([*codes.schema.fields, T.StructField("decoded", T.ArrayType(T.LongType()))])
    parts = books.entries.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(code).to_pylist():
                which = None if text is None else list(bytes.fromhex(text))
                out.append(None if which is None else books.entries[np.arange(parts), which].ravel()[: books.dim].tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], names=schema.names)

    return codes.mapInArrow(run, schema)


def compress(
    vectors: DataFrame,
    vector: str = "embedding",
    scale: int = SCALE,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """One row per usable row of ``vectors`` (vec_id, label, ``vector``): vec_id, code, error, label_error, codebooks_sha256.

    Rows whose vector is null or holds a null, NaN or infinite component are left out. label_error is the sum of the errors of
    all rows of the same label, null labels together. Repeated rows have equal results. If the length is no multiple of
    ``parts``, the last part is filled up with zeros; vectors whose length is not that of the smallest vec_id's have a null code
    and error. ``entries`` is at most 256. Other columns play no part. No usable rows give none.
    """
    assert 1 <= entries <= 256
    rows = prepared(vectors, vector, scale)
    books = fit(rows, parts, entries, rounds)
    if books is None:  # no usable rows
        none = Codebooks(np.zeros((parts, 1, 1), np.int64), 0)
        coded, digest = encode(rows, none), none.sha256()
    else:
        coded, digest = encode(rows, books), books.sha256()
    coded = stored(coded, "codes")
    by_label = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    out = spread_join(coded, by_label, ["label"], SALTS, F.col("vec_id"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
