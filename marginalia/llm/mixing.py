"""Mixing sources to target weights by Poisson replication.

A source's rate is its target share over its present share, in characters. Each document
is repeated as often as a Poisson variable with that mean says; the variable is the inverse
of the distribution function at a number hashed from the document, so a second run, or a
task that runs again, gives the same copies. The copies are then shuffled globally.

Built-in functions only. The text is shuffled once, and after the draw. Rates are one row
per named source and one for all others, so their number is bounded by the parameter and
they can be broadcast; a hot source needs no join or window of its own.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import free_names, uniform

#: A Poisson variable of a larger mean is the sum of several with at most this one, so that
#: exp(-mean) stays a normal number.
MAX_MEAN = 16.0
#: P(X > 90) at a mean of 16 is below 2^-53, the grain of the hashed number.
MAX_STEPS = 90


def _group(source: Column, weights: Mapping[str, float]) -> Column:
    """The source if it has a weight of its own, else null: all others are one group."""
    return F.when(source.isin(*weights), source) if weights else F.lit(None).cast("string")


def rates(
    docs: DataFrame, weights: Mapping[str, float], others: float, total: float = 1.0
) -> DataFrame:
    """(source_group, rate): mean copies of a document of each group.

    ``weights`` are the target shares of the named sources, ``others`` that of all the rest
    together (null sources too); shares of groups without a character do not count. ``total``
    is the size of the mixture in multiples of the input.
    """
    share = F.lit(float(others))
    for name, weight in weights.items():
        share = F.when(F.col("source_group") == name, F.lit(float(weight))).otherwise(share)
    sizes = docs.groupBy(_group(F.col("source"), weights).alias("source_group")).agg(
        F.sum(F.length("text")).alias("size")
    )
    sizes = sizes.withColumn("share", F.when(F.col("size") > 0, share))
    everything = W.partitionBy(F.lit(1))  # as many rows as there are weights, and one
    mass = F.sum("share").over(everything)
    wanted = F.col("share") / mass * F.sum("size").over(everything) * total
    return sizes.select(
        "source_group", F.coalesce(F.when(mass > 0, wanted / F.col("size")), F.lit(total)).alias("rate")
    )


def poisson_table(mean: Column) -> Column:
    """ARRAY<DOUBLE> with P(X <= k) for k = 0, 1, ... as far as numbers below one need it."""
    start = F.struct(
        F.exp(-mean).alias("p"), F.exp(-mean).alias("below"), F.array(F.exp(-mean)).alias("table")
    )

    def add(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        below = acc["below"] + p
        done = acc["p"] + acc["below"] <= acc["below"]
        table = F.when(done & (k > mean), acc["table"]).otherwise(
            F.concat(acc["table"], F.array(below))
        )
        return F.struct(p.alias("p"), below.alias("below"), table.alias("table"))

    steps = F.sequence(F.lit(1), F.lit(MAX_STEPS))
    return F.aggregate(steps, start, add, lambda acc: acc["table"])


def mix(
    docs: DataFrame,
    weights: Mapping[str, float],
    others: float,
    seed: int = 0,
    total: float = 1.0,
    copy: str = "copy",
) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) replicated towards the target weights and shuffled.

    Adds ``copy`` (1, 2, ...; underscores behind it if the name is taken). The draw hangs on
    ``seed``, doc_id and, where that is null, the text; rows that repeat draw alike.
    A source with weight 0 goes. Documents of a group without a character, and all
    documents if no share is above 0, have rate ``total``. Null texts count as empty. Rows lie in an
    order hashed from seed, doc_id, text and copy; an empty table gives an empty result.
    """
    group, mean, parts, table, n, copy, place = free_names(
        docs, "source_group", "mean", "parts", "table", "n_copies", copy, "place"
    )
    rate = rates(docs, weights, others, total)
    plan = rate.select(
        F.col("source_group").alias(group),
        F.greatest(F.ceil(F.col("rate") / MAX_MEAN), F.lit(1)).cast("int").alias(parts),
        F.col("rate").alias(mean),
    )
    plan = plan.withColumn(table, poisson_table(F.col(mean) / F.col(parts))).drop(mean)
    key = F.coalesce(F.col("doc_id"), F.xxhash64("text"))

    def draw(part: Column) -> Column:
        u = uniform(seed, part, key)
        return F.size(F.filter(F.col(table), lambda below: below <= u))

    drawn = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.col(parts)), draw), F.lit(0), lambda a, x: a + x
    )
    named = docs.withColumn(group, _group(F.col("source"), weights))
    planned = named.join(
        F.broadcast(plan.withColumnRenamed(group, group + "_of")),
        F.col(group).eqNullSafe(F.col(group + "_of")),
        "left",
    )
    copies = planned.withColumn(n, drawn).where(F.col(n) > 0)
    copies = copies.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n))))
    shuffled = copies.withColumn(place, F.xxhash64(F.lit(seed + 1), key, F.xxhash64("text"), F.col(copy)))
    return (
        shuffled.select(*docs.columns, copy, place).repartition(place).sortWithinPartitions(place).drop(place)
    )
