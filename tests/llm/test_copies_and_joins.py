import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import exact_dedup, ngram_join
from marginalia.llm.components import components
from marginalia.llm.ngram_join import Similarity

from .conftest import DOCS, brute_classes, shingle_set


def brute_copies(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out, done = [], set()
    for i, t in rows:
        ids = groups[norm(t)]
        known = [x for x in ids if x is not None]
        keep = min(known) if known else None
        kept = i == keep and norm(t) not in done
        if kept:
            done.add(norm(t))
        out.append((i, keep, len(ids), kept, hashlib.sha256(norm(t).encode()).hexdigest()))
    return out


ODD_TEXTS = [
    (1, "a b"), (2, "a \t\n b"), (3, "a  b "), (4, None), (5, ""), (6, " "), (7, "x" * 300_000),
    (8, "x" * 300_000), (9, "a b"), (2, "a b"), (None, "a b"), (None, "only"), (11, "A b"), (12, "\n"),
]


@pytest.mark.parametrize("memory", [64 << 20, 1, 2000])
def test_exact_copies_match_brute_force(spark, docs_of, prose, memory):
    rows = ODD_TEXTS + [(100 + i, prose(i % 40, 30)) for i in range(200)]
    got = exact_dedup.copies(docs_of(rows).repartition(3), memory=memory).collect()
    order = lambda r: (r[0] is None, r[0] or 0, str(r[3]), r[4])
    assert sorted(map(tuple, got), key=order) == sorted(brute_copies(rows), key=order)


@pytest.mark.parametrize("memory", [64 << 20, 2000])
def test_one_content_in_every_batch(spark, docs_of, prose, monkeypatch, memory):
    """Hot contents are merged by salt before they meet, and what meets is a small part of their groups."""
    monkeypatch.setattr(exact_dedup, "HOT_GROUPS", 8)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        rows = [(None if i % 7 == 0 else i // 2, ["hot text", "second  hot", "second hot", prose(i, 20)][i * 7919 % 4]) for i in range(3000)]
        docs = docs_of(rows).repartition(5)
        groups = exact_dedup.stored(exact_dedup.local_groups(docs.select("doc_id", "text")), "groups")
        hot = exact_dedup._hot(groups)
        per_h = {r.h: r["count"] for r in groups.groupBy("h").count().collect()}
        assert len(hot) == 2 and all(per_h[h] > 400 and 20 <= salts <= 30 for h, salts in hot.items())
        contents = groups.select("g", "h", exact_dedup.normalised(exact_dedup.F.col("row.text")).alias("content"), "n", "min_id")
        roots = exact_dedup._merged(contents, hot).where("first").groupBy("h").count().collect()
        assert all(r["count"] <= hot[r.h] for r in roots) and len(roots) == 2
        got = exact_dedup.copies(docs, memory=memory).collect()
        kept = exact_dedup.drop_copies(docs, memory=memory).count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = brute_copies(rows)
    digest = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0, r[2], r[4])
    assert sorted(map(digest, got)) == sorted(map(digest, want))
    # of rows that repeat the kept id one is kept, whichever
    assert sorted(r.text_sha256 + str(r.doc_id) for r in got if r.kept) == sorted(r[4] + str(r[0]) for r in want if r[3])
    assert kept == sum(r.kept for r in got) == len({r[4] for r in want})


def test_exact_copies_keep_one_whole_row_each(spark):
    rows = [(3, "t", "c", "x"), (1, "t ", "a", "y"), (1, "t ", "b", "y"), (9, None, "d", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, content string, h string")
    kept = sorted((r.doc_id, r.text or "", r.content, r.h) for r in exact_dedup.drop_copies(docs).collect())
    assert len(kept) == 3  # "t" and "t " differ, null is a content of its own
    assert [r[0] for r in kept] == [1, 3, 9]
    assert exact_dedup.drop_copies(docs.limit(0)).columns == docs.columns
    assert exact_dedup.copies(docs.limit(0)).count() == 0


def test_colliding_hashes_are_told_apart_by_content():
    table = exact_dedup.ContentTable(bits=2)
    assert [table.number(5, c) for c in (b"a", b"b", b"a", b"c", b"b")] == [0, 1, 0, 2, 1]
    many = [str(i).encode() for i in range(500)]
    numbers = [table.number(7, c) for c in many]
    assert [table.number(7, c) for c in many] == numbers and len(set(numbers)) == 500


def edited(text, edits, seed):
    words, rng = text.split(), random.Random(seed)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def near_rows(prose):
    shared = prose("passage", 45)
    rows = [(i, prose(i, 5 + 7 * i % 160)) for i in range(60)]  # of all lengths
    rows += [(100 + i, edited(prose("base", 150), i % 9, i)) for i in range(90)]  # a crowd
    rows += [(200 + i, f"{prose(f'p{i}', 60)} {shared}") for i in range(60)]  # a shared passage
    rows += [(300 + i, edited(prose(f"q{i // 2}", 40 + i), i % 2, i)) for i in range(40)]  # pairs
    rows += [(400 + i, edited(prose("long", 2500), 10 * i, i)) for i in range(12)]
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "ONE"), (505, "one two"), (506, "One  two")]
    rows += [(510, "a b a b a b a b"), (511, "a b a b"), (520, prose("rep", 30)), (521, prose("rep", 30).upper())]
    rows += [(530 + i, edited(prose("mid", 90), i % 4, 1000 + i)) for i in range(60)]
    return rows


@pytest.mark.parametrize("like", [(3, 90, 100), (5, 80, 100), (1, 60, 100)])
@pytest.mark.parametrize("small", [False, True])
def test_ngram_classes_match_brute_force(spark, docs_of, prose, monkeypatch, like, small):
    if small:  # small limits send the same rows through combinations, crowds and blocks
        for name, value in (("FREQUENT", 3), ("PAIRED", 2), ("BLOCK_SETS", 16), ("PIVOTS", 4), ("HEAVY_SHARE", 20)):
            monkeypatch.setattr(ngram_join, name, value)
    rows = near_rows(prose)
    got = ngram_join.classes(docs_of(rows).repartition(3), Similarity(*like)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_classes(rows, *like)
    assert len(got) == len(rows)


def test_ngram_rows_that_repeat_or_lack_an_id(spark, docs_of, prose):
    a, b = prose("a", 50), prose("b", 50)
    docs = docs_of([(5, a), (5, a), (None, a), (None, b), (None, b), (7, None), (None, None), (8, a.upper())])
    got = sorted(map(tuple, ngram_join.classes(docs, Similarity(3, 90, 100)).collect()), key=str)
    n = len(shingle_set(a, 3))
    m = len(shingle_set(b, 3))
    assert got == sorted([(5, n, 5), (5, n, 5), (None, n, 5), (None, m, None), (None, m, None), (7, 0, 7), (None, 0, None), (8, n, 5)], key=str)
    kept = ngram_join.drop_similar(docs, Similarity(3, 90, 100))
    assert kept.columns == docs.columns and kept.where("doc_id = 8").count() == 0
    assert ngram_join.classes(docs.limit(0), Similarity(3, 90, 100)).count() == 0
    clash = docs.select("doc_id", "text", "lang").withColumnsRenamed({"lang": "kept_id"}).withColumn("node", docs.doc_id)
    assert ngram_join.drop_similar(clash, Similarity(3, 90, 100)).columns == clash.columns


def test_a_large_crowd_is_compared_in_proportion_to_its_size(spark, monkeypatch):
    """20,000 sets under common entries: a class of most of them, smaller classes, and sets that are alone."""
    n, size, rng = 20_000, 60, np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, (8, size), dtype=np.uint64)
    kind = np.where(np.arange(n) < n - 600, 0, np.arange(n) % 8)
    rows = []
    for i in range(n):
        tokens = base[kind[i]].copy()
        edits = 2 if i < n - 40 else 30  # the last are far from all others
        tokens[rng.choice(size, edits, replace=False)] = rng.integers(0, 1 << 62, edits, dtype=np.uint64)
        rows.append((i, size, 1, np.sort(tokens).tobytes()))
    sets = exact_dedup.stored(spark.createDataFrame(rows, "node bigint, n bigint, band int, tokens binary"), "sets")
    like, real, seen = Similarity(3, 90, 100), ngram_join._blocks_apart, {}
    # sets of a class share 56 of 60 tokens or more: 100 * 56 / 64 is less than 90, so neighbours may be linked by way of others only
    crowds = sets.select("node", F.lit(0).cast("bigint").alias("crowd"))

    def watched(located, like):
        blocks, pairs = real(located, like)
        met = pairs.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block")).join(blocks, "block")
        seen.update(later=met.count(), labels=located.select("label").distinct().count())
        return blocks, pairs

    monkeypatch.setattr(ngram_join, "_blocks_apart", watched)
    links = [tuple(r) for r in ngram_join._links_of_crowds(crowds, sets, like).collect()]
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for a, b in links:
        root[find(a)] = find(b)
    own = [frozenset(np.frombuffer(t, np.uint64).tolist()) for *_, t in rows]
    where = {}
    for i, tokens in enumerate(own):
        for t in tokens:
            where.setdefault(t, []).append(i)
    want = list(range(n))

    def top(i):
        while want[i] != i:
            want[i] = i = want[want[i]]
        return i

    # brute force by class: all pairs of the small ones, and each of the large one with 3,000 others
    for k in range(8):
        members = [i for i in range(n) if kind[i] == k]
        for at, i in enumerate(members):
            for j in members[:at] if len(members) < 1000 else rng.choice(members, 30):
                if like.linked(len(own[i] & own[j]), size, size):
                    want[top(i)] = top(int(j))
    for i in range(n):
        assert find(i) == find(top(i))
    assert all(like.linked(len(own[a] & own[b]), size, size) for a, b in links)
    assert seen["later"] <= 4 * n  # each member to each block of the crowd would be 157 * n
    assert len(links) < 6 * n


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (90, 91), (91, 90)]
    rng.shuffle(links)
    got = dict(map(tuple, components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 90: 90, 91: 90}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_schema_of_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert exact_dedup.copies(docs).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
