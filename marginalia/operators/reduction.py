"""Semi-join reduction: rows that cannot have a partner are left out before anything is shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys are hashed into so many bitmaps of 4 KB, so what is broadcast is 4 MB at most, however many keys there are.
BITMAPS = 1024
_BITS = 32_768  # of one bitmap, as the engine's functions make them


def _slot(columns: Sequence[str]) -> Column:
    # the engine counts from 1
    return F.pmod(F.xxhash64(*columns), F.lit(BITMAPS * _BITS)) + 1


def key_bitmaps(rows: DataFrame, *keys: Sequence[str]) -> DataFrame:
    """Bitmaps of the keys that rows have; each key is a list of columns. Null is a value like any other."""
    slots = rows.select(F.explode(F.array(*[_slot(k) for k in keys])).alias("__slot"))
    return slots.groupBy(F.bitmap_bucket_number("__slot").alias("__bitmap")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("__slot")).alias("__bits")
    )


def made(bitmaps: DataFrame) -> DataFrame:
    """The same bitmaps, made now and held by the driver, 4 MB at most.

    A plan that meets them at several places has all that they are made of at each of these, and the driver
    analyzes, optimizes and prints it each time.
    """
    rows, session = bitmaps._jdf, bitmaps.sparkSession
    return DataFrame(session._jsparkSession.createDataFrame(rows.collectAsList(), rows.schema()), session)


def _met(rows: DataFrame, bitmaps: DataFrame, key: Sequence[str], how: str) -> DataFrame:
    return rows.join(F.broadcast(bitmaps), F.bitmap_bucket_number(_slot(key)) == F.col("__bitmap"), how)


def _is_set(key: Sequence[str]) -> Column:
    at = F.bitmap_bit_position(_slot(key))
    byte = F.substring("__bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))
    return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (at % 8).cast("int")) == 1


def possibly_in(rows: DataFrame, bitmaps: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows whose ``key`` is in ``bitmaps``, and of the others about n in 2^25 where these hold n keys.

    The more keys, the less is saved, but nothing is lost. Rows stay where they are, and adaptive execution does not
    read them at all if there are no keys.
    """
    return _met(rows, bitmaps, key, "inner").where(_is_set(key)).select(*rows.columns)


def with_possibly_in(rows: DataFrame, bitmaps: DataFrame, key: Sequence[str], flag: str) -> DataFrame:
    """All rows, with a column that is false only where ``possibly_in`` would leave the row out."""
    met = _met(rows, bitmaps, key, "left")
    return met.select(*rows.columns, F.coalesce(_is_set(key), F.lit(False)).alias(flag))
