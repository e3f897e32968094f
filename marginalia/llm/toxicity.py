"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

1. *Voters.* A lexicon voter fires if a text has a certain word, a pattern voter if it has a word with a
   certain beginning. Both are mined from labelled documents outside the held-out fold.
2. *Label model.* A latent class explains which voters fire together: expectation maximisation finds each
   voter's rates in both classes (its accuracy) without looking at labels, and how far two voters
   still go together within a class (their correlation), by which their evidence is discounted.
3. *Classifier.* A logistic regression on the presence of words and beginnings is trained on the label
   model's posterior, and it alone scores documents.

Words are runs of letters, digits and bytes above 127, A-Z lower-cased, as 64-bit hashes; the classifier
knows its features by their full hash. All fitting is on a bounded sample (``PER_CLASS``); scoring
is a narrow pass over whole texts, and the model is a few thousand numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import labelled, words
from .frames import free_names, stored

#: Documents of each class that the model is fitted on.
PER_CLASS = 2500
#: Beginnings of so many bytes are patterns.
STEMS = (3, 4, 5, 6)
VOTERS, FEATURES = 200, 1500
#: A voter's items occur in so many positive documents at least.
SUPPORT = 4
ROUNDS = 15

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def items(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each word and each beginning of a word, with repeats."""
    words_, bounds, stems = words.word_hashes(data, offsets, inside=_WORD, stems=STEMS)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    kinds = [(words_, text)] + [(h, text[at]) for at, h in stems]
    salted = [words.mixed(h + np.uint64(2 * i + 1)) for i, (h, _) in enumerate(kinds)]
    return np.concatenate(salted), np.concatenate([t for _, t in kinds])


@dataclass
class Classifier:
    """Logistic regression on the presence of items: sorted hashes, their weights, and a bias."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = np.full(len(offsets) - 1, self.bias)
        if len(self.hashes) and len(data):
            hashes, text = items(data, offsets)
            few = np.zeros(1 << 20, bool)  # a first sieve; what passes is looked up exactly
            few[(self.hashes >> np.uint64(44)).astype(np.intp)] = True
            hit = np.flatnonzero(few[(hashes >> np.uint64(44)).astype(np.intp)])
            at = np.minimum(np.searchsorted(self.hashes, hashes[hit]), len(self.hashes) - 1)
            known = self.hashes[at] == hashes[hit]
            pairs = np.unique(text[hit][known] * len(self.hashes) + at[known])  # presence, not number
            np.add.at(z, pairs // len(self.hashes), self.weights[pairs % len(self.hashes)])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class LabelModel:
    """Rates at which voters fire in both classes, their correlations and discounts."""

    prior: float
    rates: np.ndarray  # (2, voter): class 0, class 1
    correlation: np.ndarray  # (voter, voter) within classes
    discount: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        lo, hi = self.rates  # a voter that is silent abstains, which says nothing
        z = np.log(self.prior / (1 - self.prior)) + votes @ (np.log(hi / lo) * self.discount)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def label_model(votes: np.ndarray, weight: np.ndarray, prior: float) -> LabelModel:
    """Fitted to votes (document, voter) without labels; ``prior`` is the share of class 1.

    The last voter is the one for texts in which no other fires.
    """
    n, m = votes.shape
    votes = votes.astype(np.float64)
    model = LabelModel(prior, np.vstack([np.full(m, 0.001), np.full(m, 0.2)]), np.eye(m), np.ones(m))
    posterior = np.where(votes[:, :-1].any(axis=1), 0.9, prior / 10)  # to begin with, any vote counts
    for _ in range(ROUNDS):
        for c, w in enumerate((weight * (1 - posterior), weight * posterior)):
            model.rates[c] = np.clip((w @ votes + 0.05) / (w.sum() + 1), 1e-5, 0.999)
        w0, w1 = weight * (1 - posterior), weight * posterior
        gap = [votes - r for r in model.rates]
        joint = (gap[0] * w0[:, None]).T @ gap[0] + (gap[1] * w1[:, None]).T @ gap[1]
        sd = np.sqrt(np.maximum(np.diag(joint), 1e-12))
        model.correlation = joint / sd[:, None] / sd[None, :]
        # voters that say the same thing share the weight of one
        model.discount = 1 / np.maximum((model.correlation.clip(0) ** 2).sum(axis=1), 1)
        after = model.posterior(votes)
        if np.abs(after - posterior).max() < 1e-4:
            break
        posterior = after
    return model


def _of_texts(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct items of each text."""
    for _, data, offsets in words.chunks(texts):
        hashes, text = items(data, offsets)
        order = np.argsort(text, kind="stable")
        cut = np.searchsorted(text[order], np.arange(len(offsets)))
        for a, b in zip(cut[:-1], cut[1:]):
            yield np.unique(hashes[order[a:b]])


def item_counts(picked: DataFrame) -> DataFrame:
    """(item, hits, misses, support) of the sample's (text, label, weight): the weight of positive and of other documents
    that have an item, and the number of positive ones. Items with less than SUPPORT are left out. Summed up in
    each batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = list(_of_texts(batch.column("text")))
            if not own:
                continue
            label = np.repeat(batch.column("label").to_numpy(), [len(x) for x in own])
            weight = np.repeat(batch.column("weight").to_numpy(), [len(x) for x in own])
            seen, at = np.unique(np.concatenate(own), return_inverse=True)
            sums = [np.bincount(at, w, len(seen)) for w in (weight * label, weight * (1 - label), label)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(seen.view(np.int64)), *map(pa.array, sums[:2]), pa.array(sums[2].astype(np.int64))],
                names=["item", "hits", "misses", "support"],
            )

    counted = picked.select("text", "label", "weight").mapInArrow(run, "item bigint, hits double, misses double, support bigint")
    summed = counted.groupBy("item").agg(*[F.sum(c).alias(c) for c in ("hits", "misses", "support")])
    return summed.where(F.col("support") >= SUPPORT)


def _chosen(counts: DataFrame, positive: float, negative: float) -> tuple[np.ndarray, np.ndarray]:
    """(voters, features): sorted hashes, at most VOTERS and FEATURES and as many more.

    Voters are items that speak for the class nearly always, the widest first; features those that say most
    about either class, and the voters.
    """
    lift = F.log((F.col("hits") + 0.5) / (positive + 1)) - F.log((F.col("misses") + 0.5) / (negative + 1))
    both = F.col("hits") + F.col("misses")
    # sums of weights may come in any order: rounding keeps the choice the same
    counts = stored(
        counts.select("item", F.round("hits", 6).alias("hits"), both.alias("both"), F.round(lift, 9).alias("lift")), "item-counts"
    )
    precise = counts.where((F.col("hits") >= 0.8 * F.col("both") - 1e-9) & (F.col("lift") > 1))
    voters = [r["item"] for r in precise.orderBy(F.desc("hits"), "item").limit(VOTERS).collect()]
    if not voters:
        voters = [r["item"] for r in counts.orderBy(F.desc("lift"), "item").limit(1).collect()]
    gain = F.round(F.abs("lift") * F.sqrt("both"), 6)
    features = [r["item"] for r in counts.orderBy(gain.desc(), "item").limit(FEATURES).collect()]
    return tuple(np.unique(np.array(x, np.int64).view(np.uint64)) for x in (voters, [*voters, *features]))


def _present(picked: DataFrame, known: np.ndarray) -> list:
    """(doc_id, label, weight, found) of the sample: which of the items of ``known`` are in a text, by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.flatnonzero(np.isin(known, x)) for x in _of_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "label", "weight")), pa.array(own, pa.list_(pa.int32()))],
                names=["doc_id", "label", "weight", "found"],
            )

    rows = picked.mapInArrow(run, "doc_id bigint, label int, weight double, found array<int>")
    return sorted(rows.collect(), key=lambda r: r["doc_id"])  # bounded, in rows and in places


def fit(docs: DataFrame, labels: DataFrame, label: str, text: str = "text") -> Classifier:
    """A classifier for label = 1; without labels of both classes it gives the known share.

    What comes to the driver of the sampled texts is which of the chosen items they have, however long they are.
    """
    picked = labelled.sample(docs, labels, label, PER_CLASS, text).withColumn("label", F.col("label").cast("int"))
    picked = stored(picked, "labelled-sample")
    totals = {r["label"]: (r["n"], r["w"]) for r in picked.groupBy("label").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    (positive_n, positive), (_, negative) = (totals.get(c, (0, 0.0)) for c in (1, 0))
    prior = float((positive + 0.01) / (positive + negative + 1))
    known = Classifier(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))))
    if len(totals) < 2 or positive_n < SUPPORT:
        return known
    voters, features = _chosen(item_counts(picked), positive, negative)
    return fit_presence(_present(picked, features), features, voters, prior) if len(features) else known


def fit_presence(rows: list, features: np.ndarray, voters: np.ndarray, prior: float) -> Classifier:
    """The same from rows with label, weight and found (places in ``features``)."""
    weight = np.array([r["weight"] for r in rows], np.float64)
    present = np.zeros((len(rows), len(features)), np.float32)
    for i, r in enumerate(rows):
        present[i, r["found"]] = 1
    votes = present[:, np.searchsorted(features, voters)].astype(np.float64)
    # one voter more for a text in which no other fires; else a silent voter abstains
    votes = np.column_stack([votes, ~votes.any(axis=1)])
    soft = label_model(votes, weight, prior).posterior(votes)
    weights, bias = _logistic(present, soft, weight)
    return Classifier(features, weights, bias)


def _logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Full-batch gradient steps with momentum and a small penalty."""
    x, weight = x.astype(np.float32), (weight / weight.sum()).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), np.float32(-2)
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for i in range(1, rounds + 1):
        gap = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - target) * weight
        g = np.append(x.T @ gap + 1e-6 * w, gap.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-9)
        w, b = (w - move[:-1]).astype(np.float32), np.float32(b - move[-1])
    return w.astype(np.float64), float(b)


def score(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """Adds ``score`` DOUBLE (underscores behind it if taken): P(toxic) of the whole text.

    A null or empty text has no item, so it has the classifier's bias. All rows are kept.
    """
    (name,) = free_names(docs, "score")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.scores(data, offsets) for _, data, offsets in words.chunks(batch.column(text))]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name]
            )

    return docs.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without those that the fitted classifier gives ``threshold`` or more."""
    scored = score(docs, fit(docs, labels, "toxic"))
    return scored.where(F.col(scored.columns[-1]) < threshold).select(*docs.columns)
