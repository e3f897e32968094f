"""Registered queries against DuckDB or brute force on the smallest data set, and the pipeline."""

import hashlib
import math
import struct
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import toxicity, words
from marginalia.llm.oracles import ORACLES
from marginalia.llm.queries import OTHER_SHARES, QUERIES, SHARES, table

from .conftest import brute_classes
from .test_chats_tokens_urls import reference_ids
from .test_copies_and_joins import brute_copies

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "labels", "conversations", "embeddings")


def sha256(data):
    return hashlib.sha256(data).hexdigest()


def texts(frame):
    return {r.doc_id: r.text for r in frame.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, SF_DIR)
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    rows = sorted(tuple(map(repr, r)) for r in got.select(*columns).collect())
    assert rows == sorted(tuple(map(repr, r)) for r in con.sql(f"SELECT {', '.join(columns)} FROM want").fetchall())


def test_token_counts_and_ids_of_all_documents(spark):
    docs = texts(table(spark, SF_DIR, "documents"))
    ids = dict(zip(docs, reference_ids(docs.values())))
    counts = QUERIES["op3_token_counts"](spark, SF_DIR).collect()
    assert sorted(r.n_tokens for r in counts) == sorted(map(len, ids.values()))
    encoded = QUERIES["op10_byte_bpe"](spark, SF_DIR).collect()
    assert {r.doc_id: r.n_tokens for r in encoded} == {i: len(x) for i, x in ids.items()}
    assert {r.doc_id: r.ids_sha256 for r in encoded} == {i: sha256(np.array(x, "<u4").tobytes()) for i, x in ids.items()}
    assert {r.doc_id: r.decoded_sha256 for r in encoded} == {i: sha256((t or "").encode()) for i, t in docs.items()}


def test_each_document_has_the_copies_that_its_draws_say(spark):
    docs = table(spark, SF_DIR, "documents").select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).alias("n")).collect()
    sizes = Counter()
    for r in docs:
        sizes[r.source if r.source in SHARES else None] += r.n
    share = {g: SHARES.get(g, OTHER_SHARES) for g, n in sizes.items() if n}
    want = {}
    for r in docs:
        group = r.source if r.source in SHARES else None
        rate = share[group] / sum(share.values()) * sum(sizes.values()) / sizes[group]
        parts, copies = max(math.ceil(rate / 16), 1), 0
        for part in range(1, parts + 1):
            h = 42
            for key in (struct.pack("<i", 9), struct.pack("<i", part), struct.pack("<q", r.doc_id)):
                h = xxhash.xxh64_intdigest(key, h)
            u, k, p = (h >> 11) * 2.0**-53, 0, math.exp(-rate / parts)
            below = p
            while below <= u:
                k += 1
                p *= rate / parts / k
                below += p
            copies += k
        if copies:
            want[r.doc_id] = list(range(1, copies + 1))
    got = {}
    for r in QUERIES["op9_mixing"](spark, SF_DIR).select("doc_id", "copy").collect():
        got.setdefault(r.doc_id, []).append(r.copy)
    assert {i: sorted(c) for i, c in got.items()} == want


def test_fingerprints_of_all_documents(spark):
    docs = sorted((i, t or "") for i, t in texts(table(spark, SF_DIR, "documents")).items())
    rows = {r.doc_id: r for r in QUERIES["op7_fingerprints"](spark, SF_DIR).collect()}
    assert list(sorted(rows)) == [i for i, _ in docs]

    def agree(a, b):
        cut = lambda x: [x[k : k + 8] for k in range(0, len(x), 8)]
        return np.mean([x == y for x, y in zip(cut(a), cut(b))])

    def likeness(a, b):
        a, b = Counter(a.split()), Counter(b.split())
        return sum((a & b).values()) / max(sum((a | b).values()), 1)

    off = []
    for at, (i, text) in enumerate(docs):
        following, behind = docs[(at + 1) % len(docs)]
        take = len(text) // 4
        edited, r = text[: len(text) - take] + behind[:take], rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha256(edited.encode()))
        assert r.near_edited == pytest.approx(agree(r.fingerprint, r.edited_fingerprint))
        assert r.near_next == pytest.approx(agree(r.fingerprint, rows[following].fingerprint))
        if text.split():
            off += [r.near_edited - likeness(text, edited), r.near_next - likeness(text, behind)]
    assert abs(np.mean(off)) < 0.02 and np.sqrt(np.mean(np.square(off))) < 0.08


@pytest.mark.parametrize("name", ["op4_quality", "op8_toxicity"])
def test_classifier_queries_score_every_document(spark, name):
    rows = QUERIES[name](spark, SF_DIR).collect()
    assert len({r.doc_id for r in rows}) == table(spark, SF_DIR, "documents").count() == len(rows)
    threshold = 0.3 if name == "op4_quality" else 0.5
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in rows)


def test_pipeline_stage_by_stage(spark):
    docs = table(spark, SF_DIR, "documents").cache()
    labels = table(spark, SF_DIR, "labels")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == [name for name, _ in corpus_pipeline.STAGES] and len(steps) == 5

    clean = steps["toxicity"](spark, docs, SF_DIR).cache()
    model = toxicity.fit(docs, labels, "toxic")
    plain = {}
    for i, text in texts(docs).items():
        data = np.frombuffer((text or "").encode(), np.uint8)
        plain[i] = model.scores(data, np.array([0, len(data)]))[0]
    assert sorted(texts(clean)) == sorted(i for i, s in plain.items() if s < 0.5)

    single = steps["exact dedup"](spark, clean, SF_DIR).cache()
    rows = list(texts(clean).items())
    assert sorted(texts(single)) == sorted(i for i, _, _, kept, _ in brute_copies(rows) if kept)

    apart = steps["n-gram Jaccard join"](spark, single, SF_DIR).cache()
    classes = brute_classes(list(texts(single).items()), 5, 80, 100)
    assert sorted(texts(apart)) == sorted(i for i, (_, low) in classes.items() if i == low)

    mixed = steps["mixing sources to target weights"](spark, apart, SF_DIR).cache()
    for stage in (clean, single, apart, mixed):
        assert stage.columns == docs.columns
    sizes = {r.source: r.n for r in apart.groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    groups = {s: s if s in SHARES else None for s in sizes}
    total, mass = sum(sizes.values()), sum(SHARES[s] for s in sizes if s in SHARES) + OTHER_SHARES
    size_of = {g: sum(n for s, n in sizes.items() if groups[s] == g) for g in set(groups.values())}
    expected = {r.doc_id: SHARES.get(r.source, OTHER_SHARES) / mass * total / size_of[groups[r.source]] for r in apart.collect()}
    copies = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert abs(sum(copies.values()) - sum(expected.values())) < 5 * math.sqrt(sum(expected.values()))
    whole = {r.doc_id: r.text for r in apart.collect()}
    assert all(whole[r.doc_id] == r.text for r in mixed.collect())

    tokens = steps["byte-level BPE encoding and decoding"](spark, mixed, SF_DIR).collect()
    ids = dict(zip(whole, reference_ids(whole.values())))
    assert len(tokens) == sum(copies.values()) and all(r.round_trip for r in tokens)
    assert all(np.frombuffer(r.ids, "<u2").tolist() == ids[r.doc_id] and r.n_tokens == len(ids[r.doc_id]) for r in tokens)


def test_run_is_the_stages_in_order(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids", "round_trip"]
    assert corpus_pipeline.ORACLE_SQL is None and out.where("NOT round_trip").count() == 0 < out.count()


def test_stages_take_empty_documents(spark):
    docs = table(spark, SF_DIR, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0


def test_words_of_a_text_do_not_depend_on_its_neighbours():
    data = np.frombuffer(b"ab cdcd ab", np.uint8)
    hashes, bounds = words.word_hashes(data, np.array([0, 5, 7, 7, 10]))
    assert bounds.tolist() == [0, 2, 3, 3, 4]
    assert hashes[0] == hashes[3] and hashes[1] == hashes[2]
