"""The labelled sample that a classifier is fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One fold in so many is held out.
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Whether a document is in the fold whose labels are never learned."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, text: str = "text") -> DataFrame:
    """(text, label, weight): at most ``per_class`` documents of each class, outside the held-out fold.

    Documents are chosen by a hash of their id, so the sample is the same in every run. ``weight``
    makes up for the classes' shares. A document counts once, with its largest label; null
    labels and ids do not count. The chosen ids are at most twice ``per_class``, so they can be broadcast. Of rows that
    repeat a chosen id, the one with the smallest hash of its text counts.
    """
    known = labels.where((F.col(label).isin(0, 1)) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    place = F.xxhash64(F.lit(4), "doc_id")
    chosen = [known.where(F.col("label") == c).orderBy(place, "doc_id").limit(per_class) for c in (0, 1)]
    weight = F.when(F.col("label") == 1, F.lit(counts.get(1, 0) / max(min(counts.get(1, 0), per_class), 1))).otherwise(
        F.lit(counts.get(0, 0) / max(min(counts.get(0, 0), per_class), 1))
    )
    picked = chosen[0].union(chosen[1]).select(F.col("doc_id").alias("picked_id"), "label", weight.alias("weight"))
    rows = docs.select("doc_id", F.col(f"`{text}`").alias("text"))
    found = rows.join(F.broadcast(picked), F.col("doc_id") == F.col("picked_id"))
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))
    return found.groupBy("doc_id", "label", "weight").agg(one.alias("one")).select("doc_id", "one.text", "label", "weight")
