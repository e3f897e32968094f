"""Array helpers built from Spark's higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 256


def exclusive_scan(
    values: Column, zero: Column, combine: Callable[[Column, Column], Column], element_type: str
) -> Column:
    """Array with, at each position, the combination of all elements *before* it.

    ``combine`` has to be associative. A fold that appends to an array copies it at
    every step, so one fold over the whole array would be quadratic; the array is cut
    into blocks instead: a short fold inside every block, one over the block totals,
    and a combination of the two.
    """
    nothing = F.array().cast(f"array<{element_type}>")

    def scan(arr: Column) -> Column:
        return F.aggregate(
            arr,
            F.struct(zero.alias("total"), nothing.alias("before")),
            lambda acc, x: F.struct(
                combine(acc["total"], x).alias("total"),
                F.concat(acc["before"], F.array(acc["total"])).alias("before"),
            ),
        )

    def blocks(bound: Column) -> Column:
        n_blocks = F.ceil(F.size(bound) / F.lit(_BLOCK)).cast("int")
        starts = F.when(n_blocks > 0, F.sequence(F.lit(0), n_blocks - 1)).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(starts, lambda b: scan(F.slice(bound, b * _BLOCK + 1, F.lit(_BLOCK))))

    def combined(inside: Column) -> Column:
        totals = F.transform(inside, lambda s: s["total"])
        # a file of very many elements has many blocks, so their totals are scanned the same way
        base = F.flatten(let(_grouped(totals, scan), lambda groups: _with_bases(groups, scan, combine)))
        return F.flatten(
            F.zip_with(inside, base, lambda s, b: F.transform(s["before"], lambda x: combine(b, x)))
        )

    # Both are looked into by index, or used twice, inside lambdas, so they are bound first.
    return let(values, lambda v: let(blocks(v), combined))


def _grouped(totals: Column, scan) -> Column:
    """Scans of groups of ``_BLOCK`` totals."""
    n = F.ceil(F.size(totals) / F.lit(_BLOCK)).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return let(totals, lambda t: F.transform(starts, lambda g: scan(F.slice(t, g * _BLOCK + 1, F.lit(_BLOCK)))))


def _with_bases(groups: Column, scan, combine) -> Column:
    base = scan(F.transform(groups, lambda s: s["total"]))["before"]
    return F.zip_with(groups, base, lambda s, b: F.transform(s["before"], lambda x: combine(b, x)))


def positions(texts: Column) -> Column:
    """ARRAY<STRUCT<line, col>>: 0-based line and column at which each text begins when
    the texts of the array stand one behind the other."""

    def place(line: Column, col: Column) -> Column:
        return F.struct(line.cast("int").alias("line"), col.cast("int").alias("col"))

    # How far a text moves the cursor: lines down, and the length of what is behind its
    # last line end. Two moves combine into one of the same form.
    moves = F.transform(
        texts,
        lambda t: place(
            F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))),
            F.length(F.substring_index(t, "\n", -1)),
        ),
    )

    def then(a: Column, b: Column) -> Column:
        return place(a["line"] + b["line"], F.when(b["line"] > 0, b["col"]).otherwise(a["col"] + b["col"]))

    return exclusive_scan(moves, place(F.lit(0), F.lit(0)), then, "struct<line:int,col:int>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    An array that a lambda looks into by index must be bound like this: written into the
    lambda as it is, the optimizer may repeat the expression for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def flags_at(size: Column, places: Column) -> Column:
    """ARRAY<BOOLEAN> of ``size`` entries, true at the 1-based ``places`` (NULL: none).

    One sort instead of a search per entry: every place sorts directly before the entry
    it points at.
    """
    entries = F.transform(
        F.sequence(F.lit(1), size), lambda i: F.struct(i.alias("at"), F.lit(1).alias("entry"))
    )
    asked = F.transform(
        F.coalesce(places, F.array().cast("array<int>")),
        lambda p: F.struct(p.cast("int").alias("at"), F.lit(0).alias("entry")),
    )

    def pair(ordered: Column) -> Column:
        before = F.concat(F.slice(ordered, 1, 1), ordered)
        return F.zip_with(
            F.slice(before, F.lit(1), F.size(ordered)),
            ordered,
            lambda b, o: F.struct(
                o["entry"].alias("entry"), ((b["entry"] == 0) & (b["at"] == o["at"])).alias("hit")
            ),
        )

    merged = let(F.sort_array(F.concat(entries, asked)), pair)
    return F.transform(F.filter(merged, lambda x: x["entry"] == 1), lambda x: x["hit"])
