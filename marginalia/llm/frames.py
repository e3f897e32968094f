"""Small DataFrame helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import file_system, shared_folder  # noqa: F401

_A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Bytes of an Arrow batch. By number of rows alone a batch of long texts takes many times as much, in the
#: executor and in its Python workers.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches by bytes for the session's queries."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only, whatever the locale."""
    return F.translate(text, _A_TO_Z, _A_TO_Z.lower())


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, each with underscores behind it where ``df`` has it already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: it is computed once and
    its lineage ends there, so a lost executor costs no more than the tasks that it ran."""
    spark = df.sparkSession
    folder = shared_folder(spark, purpose)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


#: Tasks over which small rows that stand for much work are dealt, at most.
MOST_TASKS = 1 << 16


def dealt(rows: DataFrame) -> DataFrame:
    """``rows``, few bytes each that stand for much to read, over as many tasks as there are rows (at most ``MOST_TASKS``).

    The number is stated because the engine merges partitions by their bytes where it is not, and would
    leave all reading to a few tasks.
    """
    return rows.repartition(min(max(rows.count(), 1), MOST_TASKS))


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that hangs on ``seed`` and the keys alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11).cast("double") * F.lit(2.0**-53)


def spread_join(
    rows: DataFrame, small_rows: DataFrame, keys: Sequence[str], salts: int, by: Column
) -> DataFrame:
    """Left join whose hot keys are spread over ``salts`` tasks each.

    ``small_rows`` has one row per key (from an aggregate, so a skewed join is not split by
    the engine); each of its rows is repeated once per salt. ``by`` picks a row's salt.
    Keys join null-safely.
    """
    salt = f"salt_{uuid.uuid4().hex[:8]}"
    left = rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    right = small_rows.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    renamed = {k: f"{k}_{salt}" for k in keys}
    right = right.withColumnsRenamed(renamed)
    on = left[salt] == right[salt]
    for k in keys:
        on = on & left[k].eqNullSafe(right[renamed[k]])
    return left.join(right, on, "left").drop(right[salt]).drop(salt, *renamed.values())
