import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.llm import byte_cnn, labelled, toxicity, words

LABELS = "doc_id bigint, quality int, toxic int"


def corpus(prose, n=600):
    """Texts, and labels that follow from what was put into them."""
    rng, rows, labels = random.Random(5), [], []
    for i in range(n):
        words_ = prose(i, rng.randrange(20, 120)).split()
        toxic, poor = rng.random() < 0.25, rng.random() < 0.4
        if poor:
            words_ = [w.upper() + "!!" for w in words_]
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words_.insert(rng.randrange(len(words_)), rng.choice(["grumblefink", "grotzel" + prose(i, 1), "Zonk,"]))
        rows.append((i, " ".join(words_)))
        labels.append((i, int(not poor), int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def labelled_docs(spark, docs_of, prose):
    rows, labels = corpus(prose)
    return docs_of(rows).cache(), spark.createDataFrame(labels, LABELS).cache(), labels


def accuracy(scored, truth, threshold):
    held = scored.where(labelled.held_out(F.col("doc_id"))).collect()
    assert len(held) > 60
    return np.mean([(r["score"] >= threshold) == truth[r["doc_id"]] for r in held])


def test_toxicity_on_held_out_documents(labelled_docs):
    docs, labels, truth = labelled_docs
    model = toxicity.fit(docs, labels, "toxic")
    assert accuracy(toxicity.score(docs, model), {i: t for i, _, t in truth}, 0.5) > 0.95


def test_quality_on_held_out_documents(labelled_docs, monkeypatch):
    monkeypatch.setattr(byte_cnn, "EPOCHS", 12)
    docs, labels, truth = labelled_docs
    net = byte_cnn.fit(docs, labels, "quality")
    assert accuracy(byte_cnn.score(docs, net), {i: q for i, q, _ in truth}, 0.3) > 0.95


def test_labels_of_the_held_out_fold_are_not_learned(spark, labelled_docs):
    docs, labels, _ = labelled_docs
    picked = labelled.sample(docs, labels, "toxic", 10_000).collect()
    assert picked and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in picked)
    wrong = labels.withColumn("toxic", F.when(labelled.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels, "toxic"), toxicity.fit(docs, wrong, "toxic")
    assert (a.hashes == b.hashes).all() and (a.weights == b.weights).all()
    small = labelled.sample(docs, labels, "toxic", 7).collect()
    assert sorted(r["label"] for r in small) == [0] * 7 + [1] * 7


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (byte_cnn, "quality")])
def test_odd_tables(spark, labelled_docs, module, label, monkeypatch):
    monkeypatch.setattr(byte_cnn, "EPOCHS", 2)
    docs, labels, _ = labelled_docs
    model = module.fit(docs, labels, label)
    odd = [(None, None), (1, ""), (1, ""), (2, "\0\0"), (3, "é" * 5000), (4, "x" * 400_000), (5, " ")]
    rows = spark.createDataFrame(odd, "doc_id bigint, text string").withColumn("score", F.lit("mine"))
    got = module.score(rows, model)
    assert got.columns == ["doc_id", "text", "score", "score_"]
    found = got.collect()
    assert len(found) == len(odd) and all(0 <= r["score_"] <= 1 for r in found)
    by = {(r["doc_id"], r["text"]): r["score_"] for r in found}
    assert by[(None, None)] == by[(1, "")]
    assert module.score(rows.limit(0), model).count() == 0
    one_class = module.fit(docs, labels.withColumn(label, F.lit(1)), label)
    assert all(r["score"] > 0.9 for r in module.score(docs.limit(5), one_class).collect())
    none = module.fit(docs, labels.limit(0), label)
    assert 0 <= module.score(docs.limit(1), none).first()["score"] <= 1
    assert module.fit(docs.limit(0), labels, label) is not None


def test_toxic_documents_go_and_others_stay(labelled_docs):
    docs, labels, truth = labelled_docs
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    toxic = {i for i, _, t in truth if t}
    assert len(ids & toxic) < 0.1 * len(toxic) and len(ids) > 0.95 * (len(truth) - len(toxic))


def test_a_voter_that_repeats_another_counts_once():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    fire = lambda hi, lo: np.where(truth, rng.random(4000) < hi, rng.random(4000) < lo)
    a, b = fire(0.6, 0.02), fire(0.5, 0.05)
    votes = np.column_stack([a, a, b])
    votes = np.column_stack([votes, ~votes.any(axis=1)])
    model = toxicity.label_model(votes, np.ones(4000), 0.3)
    assert abs(model.rates[1][0] - 0.6) < 0.1 and model.rates[0][0] < 0.05
    assert model.correlation[0, 1] > 0.95 and model.discount[0] < 0.55 < model.discount[2]


def test_pooling_matches_a_plain_loop():
    rng = np.random.default_rng(3)
    net = byte_cnn.Network(rng.normal(0, 1, (byte_cnn.WIDTH, 256, byte_cnn.FILTERS)).astype(np.float32), rng.normal(0, 1, byte_cnn.FILTERS).astype(np.float32), np.zeros(3 * byte_cnn.FILTERS + 3, np.float32), 0.0)
    texts = [rng.integers(1, 256, n).astype(np.uint8) for n in (1, 3, 255, 256, 257, 511, 512, 513, 5000)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = net.pooled(np.concatenate(texts), offsets)
    for text, row in zip(texts, got):
        n = -(-(len(text) + byte_cnn.WIDTH) // byte_cnn.HALF) * byte_cnn.HALF
        padded = np.concatenate([text, np.zeros(n + byte_cnn.WIDTH - len(text), np.uint8)])
        inside = np.arange(n) < len(text)
        plain = np.array([[sum(net.tables[j, padded[t + j], f] for j in range(byte_cnn.WIDTH)) if inside[t] else -np.inf for f in range(byte_cnn.FILTERS)] for t in range(n)])
        starts = range(0, max(n - byte_cnn.HALF, 1), byte_cnn.HALF)
        chunks = np.array([np.maximum(plain[s : s + 2 * byte_cnn.HALF].max(axis=0) + net.shift, 0) for s in starts])
        want = np.concatenate([chunks.mean(axis=0), chunks.min(axis=0), chunks.max(axis=0)])
        assert np.abs(row[: 3 * byte_cnn.FILTERS] - want).max() < 1e-3


def test_word_hashes_see_words_and_not_their_place():
    texts = pa.array(["Ab  cd\n", None, "", "cd", " ab", "é é", "x" * 3_000_000 + " ab"])
    seen = []
    for _, data, offsets in words.chunks(texts):
        hashes, bounds = words.word_hashes(data, offsets)
        seen += [hashes[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    ab, cd = seen[0]
    assert seen[1] == seen[2] == [] and seen[3] == [cd] and seen[4] == [ab] and seen[6][1] == ab
    assert seen[5][0] == seen[5][1] and len({ab, cd, seen[5][0], seen[6][0]}) == 4
    assert sum(1 for _ in words.chunks(texts.slice(3, 2))) == 1


def test_gradients_of_whole_texts_match_differences():
    rng = np.random.default_rng(11)
    net = byte_cnn.Network(
        rng.normal(0, 0.3, (byte_cnn.WIDTH, 256, byte_cnn.FILTERS)), rng.normal(0, 0.1, byte_cnn.FILTERS), rng.normal(0, 0.5, 3 * byte_cnn.FILTERS + 3), 0.0
    )
    # zero bytes are bytes like others; every chunk of a long text counts
    texts = [(rng.integers(0, 256, n) * (rng.random(n) < 0.8)).astype(np.uint8) for n in (0, 4, 300, 2000)]
    target, weight = np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 1, 1])
    bias = np.zeros(1)

    def loss():
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        net.bias = bias[0]
        p = net.scores(np.concatenate(texts), offsets)
        return -(weight * np.log(np.where(target == 1, p, 1 - p))).sum() / len(texts) + 0.5e-4 * (net.head**2).sum()

    # the numbers of the pooling are single precision, so steps are not tiny
    grads = byte_cnn.gradients(net, bias, texts, target, weight)
    for param, grad in zip((net.tables, net.shift, net.head, bias), grads):
        for at in map(tuple, np.argwhere(np.abs(grad) > 0.02)[:25]):
            keep, step = param[at], 5e-4
            param[at] = keep + step
            up = loss()
            param[at] = keep - step
            down = loss()
            param[at] = keep
            assert abs((up - down) / (2 * step) - grad[at]) < 0.1 * abs(grad[at]) + 5e-3


def plain_items(text):
    """The distinct words and beginnings of words of a text, each hashed by itself."""
    out = set()
    for word in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode()):
        for kind, part in enumerate([word, *(word[:n] if len(word) > n else None for n in toxicity.STEMS)]):
            if part is not None:
                data = np.frombuffer(part, np.uint8)
                h, _ = words.word_hashes(data, np.array([0, len(data)]), inside=toxicity._WORD)
                out.add(int(words.mixed(h + np.uint64(2 * kind + 1))[0]))
    return out


def test_toxicity_matches_a_plain_loop(spark, labelled_docs, monkeypatch):
    """What is chosen, counted and scored, document by document and word by word."""
    monkeypatch.setattr(toxicity, "FEATURES", 60)
    monkeypatch.setattr(toxicity, "VOTERS", 20)
    docs, labels, truth = labelled_docs
    own = {r.doc_id: plain_items(r.text) for r in docs.select("doc_id", "text").collect()}
    picked = labelled.sample(docs, labels, "toxic", toxicity.PER_CLASS).withColumn("label", F.col("label").cast("int"))
    known = picked.collect()
    assert len(known) == sum(1 for i, _, _ in truth if zlib.crc32(str(i).encode()) % 5)
    counts = {}
    for r in known:
        for item in own[r.doc_id]:
            c = counts.setdefault(item, [0, 0, 0])
            c[0 if r.label else 1] += r.weight
            c[2] += r.label
    got = {r.item % (1 << 64): [round(r.hits, 6), round(r.misses, 6), r.support] for r in toxicity.item_counts(picked).collect()}
    assert got == {i: [round(x, 6) for x in c] for i, c in counts.items() if c[2] >= toxicity.SUPPORT}
    model = toxicity.fit(docs, labels, "toxic")
    weight = dict(zip(model.hashes.tolist(), model.weights))
    assert 60 <= len(weight) <= 80
    for r in toxicity.score(docs, model).collect():
        z = model.bias + sum(weight.get(i, 0.0) for i in own[r.doc_id])
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9


def test_a_repeated_document_counts_once_in_the_sample(spark, docs_of):
    docs = docs_of([(1, f"text {i}") for i in range(50)] + [(2, "b"), (3, None), (3, None), (4, "d")])
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 0, 0), (3, 0, 1), (4, 1, 0)], LABELS)
    rows = labelled.sample(docs, labels, "toxic", 10).collect()
    want = {i: t for i, t in ((1, 1), (2, 0), (3, 1), (4, 0)) if zlib.crc32(str(i).encode()) % 5}
    assert len(rows) == len(want) and {r.doc_id: r.label for r in rows} == want
