"""Chat formatting: collapsing logged snapshots of growing conversations, then rendering.

A log often holds a conversation again each time it grows by a turn. Every prefix of a
conversation has a hash that rolls over its turns; a conversation that equals a prefix of a
longer one is a snapshot and goes (an anti-join), of equal ones the smallest id stays.

Turns stand in the order of number, role and text, and a prefix may end behind any of them, also between
turns of one number. A row that is logged twice is one turn. A prefix's hash is the exclusive or of a hash of
(number, role, text) of each of its turns, with two seeds, 128 bits in all; with the count of its turns it
identifies the prefix.

The log is put in order by ranges, so a conversation of any size, and one in which very many rows share a number or have
no id, is spread over as many slices as its rows take. Exclusive or is associative, so prefixes roll in two levels:
inside slices, and over the slices of a conversation. It is rendered in pieces of a fixed number of turns. Built-in
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import stored

#: Turns of one rendered piece.
BLOCK = 256
#: Characters of a text that take part in cutting the log into ranges.
RANGED = 64


def turn_table(log: DataFrame) -> DataFrame:
    """(conv_id, slice, seq, turn, role, text), stored: distinct turns, numbered in their order.

    ``seq`` grows with (conv_id, turn, role, text), nulls first, by one from row to row of a ``slice``.
    Only turns that agree in all but the end of a long text must be in the same slice.
    """
    rows = log.select("conv_id", "turn", "role", "text").distinct()
    order = ["conv_id", "turn", "role"]
    dealt = rows.repartitionByRange(*order, F.substring("text", 1, RANGED)).sortWithinPartitions(*order, "text")
    turns = stored(dealt.withColumn("seq", F.monotonically_increasing_id()), "turns")
    return turns.withColumn("slice", F.shiftright("seq", 33))


def _same(left: DataFrame, right: DataFrame) -> Column:
    """Slices of a conversation meet; the null id is one, too."""
    return left["conv_id"].eqNullSafe(right["conv_id"]) & (left["slice"] == right["slice"])


def spans(turns: DataFrame) -> DataFrame:
    """(conv_id, slice, low, before, first, total): of each conversation's part of a slice, its lowest seq and how many
    turns are before it, and of the whole conversation the smallest number and how many turns it has."""
    parts = turns.groupBy("conv_id", "slice").agg(
        F.min("seq").alias("low"), F.count("*").alias("n"), F.min("turn").alias("first")
    )
    whole = W.partitionBy("conv_id")
    earlier = whole.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    return parts.select(
        "conv_id",
        "slice",
        "low",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.min("first").over(whole).alias("first"),
        F.sum("n").over(whole).alias("total"),
    )


def _joined(rows: DataFrame, parts: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with columns of their part of a slice; a part is no longer than a slice."""
    return rows.join(parts, _same(rows, parts)).select(rows["*"], *[parts[c] for c in columns])


def prefix_hashes(turns: DataFrame, parts: DataFrame) -> DataFrame:
    """(conv_id, n, p1, p2, last): the hash of the first n turns, and whether these are the whole conversation.

    A turn's number counts from the conversation's smallest; a null number is one of its own.
    """
    rows = _joined(turns, parts, "low", "before", "first", "total")
    place = F.coalesce(F.col("turn") - F.col("first"), F.lit(-1)).cast("bigint")
    content = [place, F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    hashed = rows.select(
        "conv_id", "slice", "seq", "total",
        (F.col("before") + F.col("seq") - F.col("low") + 1).alias("n"),
        F.xxhash64(F.lit(1), *content).alias("h1"),
        F.xxhash64(F.lit(2), *content).alias("h2"),
    )
    inside = W.partitionBy("conv_id", "slice").orderBy("seq")
    rolled = hashed.select(
        "conv_id", "slice", "n", "total", F.bit_xor("h1").over(inside).alias("r1"), F.bit_xor("h2").over(inside).alias("r2")
    )
    rolled = stored(rolled, "rolled-hashes")
    # the hash at a slice's end goes on into the later slices of the conversation, if there are any
    ends = rolled.groupBy("conv_id", "slice").agg(F.max(F.struct("n", "r1", "r2", "total")).alias("end"))
    open_ends = ends.where("end.n < end.total OR slice > 0").select("conv_id", "slice", "end.r1", "end.r2")
    earlier = W.partitionBy("conv_id").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    bases = open_ends.select(
        "conv_id", "slice", F.bit_xor("r1").over(earlier).alias("b1"), F.bit_xor("r2").over(earlier).alias("b2")
    ).where("b1 IS NOT NULL")
    based = rolled.join(bases, _same(rolled, bases), "left").select(rolled["*"], bases["b1"], bases["b2"])
    return based.select(
        "conv_id",
        "n",
        F.col("r1").bitwiseXOR(F.coalesce("b1", F.lit(0))).alias("p1"),
        F.col("r2").bitwiseXOR(F.coalesce("b2", F.lit(0))).alias("p2"),
        (F.col("n") == F.col("total")).alias("last"),
    )


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_equal): the conversations that are a prefix of no longer one, one of each
    group of equals, and how many equal it."""
    key = ["n", "p1", "p2"]
    whole = (
        prefixes.where("last")
        .groupBy(*key)
        .agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"))
    )
    parts = prefixes.where("NOT last").select(*key).distinct()
    return whole.join(parts, key, "left_anti").select("conv_id", "n_equal")


def render(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, part, n_turns, text, n_equal) of turns with their number ``n`` from 1 on: ``block`` turns each in chat markup.

    The parts of a conversation in order make up its text. A null role is ``unknown``, a null text empty.
    """
    said = F.concat(
        F.lit("<|im_start|>"),
        F.coalesce("role", F.lit("unknown")),
        F.lit("\n"),
        F.coalesce("text", F.lit("")),
        F.lit("<|im_end|>\n"),
    )
    part = F.floor((F.col("n") - 1) / block)
    gathered = turns.groupBy("conv_id", part.alias("part"), "n_equal").agg(
        F.sort_array(F.collect_list(F.struct("n", said.alias("said")))).alias("t")
    )
    return gathered.select(
        "conv_id",
        "part",
        F.size("t").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("t", lambda t: t["said"]), "").alias("text"),
        "n_equal",
    )


def format_chats(log: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rendered conversations of a log (conv_id, turn, role, text) without its snapshots.

    Returns conv_id, part, n_turns, text, n_equal; most conversations have one part (0), longer
    ones one per ``block`` turns. Rows with a null conv_id are one conversation without an id. A
    single turn is a conversation like any other, and an empty log gives no rows. Two
    conversations are compared by all turns, with roles, texts and gaps in the numbering; rows that repeat are one
    turn, turns of one number stand in order of role and text, and turns without a number come first (so do null roles
    and texts). Other columns of the log play no part, whatever their names.
    """
    turns = turn_table(log)
    parts = stored(spans(turns), "conversation-spans")
    kept = maximal(prefix_hashes(turns, parts))
    kept = kept.select(F.col("conv_id").alias("kept_id"), "n_equal")
    wanted = stored(
        parts.join(kept, parts["conv_id"].eqNullSafe(kept["kept_id"])).select("conv_id", "slice", "low", "before", "n_equal"),
        "maximal",
    )
    rows = _joined(turns, wanted, "low", "before", "n_equal")
    return render(rows.withColumn("n", F.col("before") + F.col("seq") - F.col("low") + 1), block)
