"""Document fingerprints by consistent weighted sampling.

A text's terms are its words, weighted by how often they occur. For each of a number of samples every term
has two gamma(2, 1) variables r and c and a uniform b, hashed from the term and the sample alone. With a
weight w, t = floor(ln w / r + b) and ln a = ln c - r (t - b + 1); the sample is the term and t with the
smallest a. Two texts agree in a sample with the probability of their generalised Jaccard
similarity, the sum of the smaller weights over the sum of the larger ones.

Built-in functions only. A text's terms are counted inside its row; rows of (text, term, weight) then
meet in one aggregate of minima, which shrinks to a row per text before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import let
from .frames import stored

#: A likeness moves in steps of 1/48, with a standard error of at most 0.072.
SAMPLES = 48
_WIDTH = 8  # hexadecimal digits of a sample in the fingerprint


def term_weights(text: Column) -> Column:
    """ARRAY<STRUCT<term BIGINT, weight INT>> of a text's words, in order of the terms' hashes."""
    found = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.sort_array(F.transform(found, lambda w: F.xxhash64(w)))

    def runs(sorted_hashes: Column) -> Column:
        n = F.size(sorted_hashes)
        starts = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda i: (i == 0) | (F.get(sorted_hashes, i) != F.get(sorted_hashes, i - 1)),
        )
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda i, k: F.struct(
                    F.get(sorted_hashes, i).alias("term"),
                    (F.coalesce(F.get(s, k + 1), n) - i).cast("int").alias("weight"),
                ),
            ),
        )

    none = F.array().cast("array<struct<term:bigint,weight:int>>")
    return let(hashes, lambda h: F.when(F.size(h) > 0, runs(h)).otherwise(none))


def _uniform(hashed: Column, low: int, bits: int) -> Column:
    """A number in (0, 1) from some bits of a hash."""
    part = F.shiftrightunsigned(hashed, low).bitwiseAND(F.lit((1 << bits) - 1))
    return (part.cast("double") + 0.5) * F.lit(2.0**-bits)


def _candidate(sample: int, term: Column, log_weight: Column) -> Column:
    """BIGINT that is smallest where ln a is, with the hash of (term, t) in its lower half."""
    first, second = F.xxhash64(term, F.lit(2 * sample)), F.xxhash64(term, F.lit(2 * sample + 1))
    r = -F.ln(_uniform(first, 0, 21) * _uniform(first, 21, 21))
    b = _uniform(first, 42, 21)
    log_c = F.ln(-F.ln(_uniform(second, 0, 31) * _uniform(second, 31, 31)))
    t = F.floor(log_weight / r + b)
    log_a = log_c - r * (t.cast("double") - b + 1)
    # ln a lies between -90 and 40 for any weight below 2^31
    rank = F.floor((log_a + 128) * F.lit(2.0**23)).cast("bigint")
    chosen = F.xxhash64(term, t, F.lit(sample)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(rank, 32).bitwiseOR(chosen)


def fingerprints(texts: DataFrame, keys: list[str], texts_of: dict[str, str], samples: int = SAMPLES) -> DataFrame:
    """One row per row of ``texts``, whose ``keys`` are unique: the keys and, for each column of
    text in ``texts_of``, a fingerprint under the name given there.

    A fingerprint is hexadecimal, eight digits a sample. A text without words has zeros. Equal texts
    have equal fingerprints; word order and the kind of blanks do not matter, case does.
    """
    found = packed_fingerprints(texts, keys, texts_of, samples)
    return found.select(*keys, *[F.lower(F.hex(name)).alias(name) for name in texts_of.values()])


def packed_fingerprints(texts: DataFrame, keys: list[str], texts_of: dict[str, str], samples: int = SAMPLES) -> DataFrame:
    """``fingerprints`` as BINARY, four bytes a sample: half of what is shuffled and stored."""
    kinds = list(texts_of)
    each = F.array(
        *[F.struct(F.lit(i).alias("kind"), term_weights(F.coalesce(kind, F.lit(""))).alias("terms")) for i, kind in enumerate(kinds)]
    )
    by_kind = texts.select(*keys, F.explode(each).alias("k")).select(*keys, "k.kind", "k.terms")
    rows = by_kind.select(*keys, "kind", F.explode_outer("terms").alias("t")).select(
        *keys, "kind", F.col("t.term").alias("term"), F.ln(F.col("t.weight").cast("double")).alias("log_weight")
    )
    minima = [F.min(_candidate(i, F.col("term"), F.col("log_weight"))).alias(f"m{i}") for i in range(samples)]
    found = rows.groupBy(*keys, "kind").agg(*minima)
    digits = [
        F.lpad(F.hex(F.coalesce(F.col(f"m{i}"), F.lit(0)).bitwiseAND(F.lit(0xFFFFFFFF))), _WIDTH, "0")
        for i in range(samples)
    ]
    found = found.select(*keys, "kind", F.unhex(F.concat(*digits)).alias("print"))
    own = [F.max(F.when(F.col("kind") == i, F.col("print"))).alias(texts_of[kind]) for i, kind in enumerate(kinds)]
    return found.groupBy(*keys).agg(*own)


def likeness(a: Column, b: Column, samples: int = SAMPLES, width: int = _WIDTH) -> Column:
    """The share of samples in which two fingerprints agree; of packed ones ``width`` is half."""
    same = [
        (F.substring(a, 1 + width * i, width) == F.substring(b, 1 + width * i, width)).cast("int")
        for i in range(samples)
    ]
    total = same[0]
    for s in same[1:]:
        total = total + s
    return total / F.lit(float(samples))


def next_rows(keys: DataFrame) -> DataFrame:
    """Distinct keys (id, mark, ...) with ``next_id`` and ``next_mark`` of the row behind, by id
    and mark; the last row's next is the first.

    The keys are sorted globally into files; a row's place is its place in its file and the rows in the
    files before, so only one number per file is summed in one place.
    """
    ordered = stored(keys.orderBy("id", "mark"), "ordered-keys")
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    placed = ordered.select("*", part.alias("part"), F.col("_metadata.row_index").alias("row"))
    counts = placed.groupBy("part").agg(F.count("*").alias("rows"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    total = counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]  # one number
    placed = placed.join(starts, "part").withColumn("place", F.col("start") + F.col("row")).drop("part", "row", "start")
    behind = placed.select(
        F.pmod(F.col("place") - 1, F.lit(max(total, 1))).alias("place"),
        F.col("id").alias("next_id"),
        F.col("mark").alias("next_mark"),
    )
    return placed.join(behind, "place").drop("place")


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its fingerprint, that of an edited text, and likenesses.

    The edited text has its last quarter (of code points, rounded down) replaced by as many of the
    first of the next document's, or all. The next document is the next row by doc_id, null ids
    first, rows of one id by a hash of their text; rows that repeat id and text are one document here and
    have the same result. Null texts count as empty. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.
    """
    text = F.coalesce("text", F.lit(""))
    # a null id is told from 0 by the mark
    mark = F.xxhash64(text, F.col("doc_id").isNull())
    texts = docs.select(F.coalesce("doc_id", F.lit(0)).alias("id"), mark.alias("mark"), text.alias("text"))
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("id"), mark.alias("mark"), F.length(text).alias("n"))
    rows = stored(rows, "document-keys")
    follow = stored(next_rows(rows.groupBy("id", "mark").agg(F.max("n").alias("n"))), "next-documents")
    key = ["id", "mark"]
    quarter = F.floor(F.col("n") / 4).cast("int")
    # the text is dealt by key once; both joins read it there
    asked = follow.select(
        F.col("next_id").alias("id"),
        F.col("next_mark").alias("mark"),
        F.col("id").alias("by_id"),
        F.col("mark").alias("by_mark"),
        quarter.alias("take"),
    )
    pieces = texts.join(asked, key).select(
        F.col("by_id").alias("id"), F.col("by_mark").alias("mark"), "take", F.substr("text", F.lit(1), "take").alias("piece")
    )
    # repeated rows of a document ask for, and send, the same piece
    pieces = pieces.groupBy(*key).agg(F.first("take").alias("take"), F.first("piece").alias("piece"))
    head = F.substr("text", F.lit(1), F.length("text") - F.col("take"))
    both = texts.join(pieces, key).select(*key, "text", F.concat(head, "piece").alias("edited"))
    both = both.withColumn("edited_sha256", F.sha2("edited", 256))
    wanted = {"text": "fingerprint", "edited": "edited_fingerprint"}
    found = stored(packed_fingerprints(both, [*key, "edited_sha256"], wanted, samples), "fingerprints")
    behind = found.select(
        F.col("id").alias("next_id"), F.col("mark").alias("next_mark"), F.col("fingerprint").alias("next_print")
    )
    known = found.join(follow, key).join(behind, ["next_id", "next_mark"])
    known = known.select(
        *key,
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples, _WIDTH // 2).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_print"), samples, _WIDTH // 2).alias("near_next"),
    )
    return rows.join(known, key).select(
        "doc_id",
        F.col("n").cast("bigint").alias("n_chars"),
        "edited_sha256",
        F.lower(F.hex("fingerprint")).alias("fingerprint"),
        F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
