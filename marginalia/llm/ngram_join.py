"""N-gram Jaccard join by prefixes of token combinations, and the classes it links.

A text's tokens are its distinct k-word shingles as 64-bit numbers, ordered by number. Texts with
equal token sets are one node. Two sets of Jaccard similarity t or more differ in at most d(n) =
floor((1 - t) n) tokens of either, so if both are cut to *extended prefixes* of d + K tokens,
K(n) = d + 1, they share at least kk(n) = K(ceil(t n)) of these.

Only extended prefixes are shuffled. How many nodes have a token there says how frequent it
is. Put in order of frequency, rare tokens first, the first e - kk + j of a node's e tokens hold
the j smallest that it shares with any partner. So a node is indexed under

* each single *rare* token among the first e - kk + 1 (or + 2, see below),
* each combination of two *frequent* tokens among the first e - kk + 2, where both lengths are in the
  range for combinations; outside it, under the single frequent tokens among the first e - kk + 1.

Two nodes that match share an entry, and most documents have rare tokens enough, so that a passage or
line that thousands of them share brings none of them together.

Entries with few nodes give pairs. Entries with many would give the square of their number; their
nodes are put into crowds instead (connected by common entries), and crowds are dealt into blocks. First each block is
compared with itself and with a few pivots of its crowd, by one matrix product that returns a spanning set of its
links: rows in proportion to the crowd. Near copies are linked by then. What is still apart is dealt into blocks by label and nearest pivot, and only
such blocks meet as can hold similar sets: Jaccard distance is a metric, so two sets whose distances to any pivot differ by
more than 1 - t are not similar. All candidates are verified on complete sets, and no candidate is dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import words
from .components import components
from .frames import free_names, spread_join, stored

#: More nodes than this make a token frequent.
FREQUENT = 32
#: An entry with at most so many nodes gives pairs, else its nodes are a crowd.
PAIRED = 8
#: Sets, and tokens, of a block of a crowd.
BLOCK_SETS, BLOCK_TOKENS = 128, 1 << 20
#: Combinations are for lengths at which the indexed part is at most this long; in longer texts a
#: shared passage is too small a part to bring frequent tokens into it.
COMBINED = 18
SALTS = 16
#: About so many members of a crowd are its pivots, and never more than the second number.
PIVOTS, MOST_PIVOTS = 12, 24
#: Tokens that more than one node in so many has, the most frequent ones, are counted apart.
HEAVY_SHARE, HEAVY_TOKENS = 200, 4096
#: Stands for the number of nodes of these tokens: they come last in the order of tokens.
_HEAVY = 1 << 40


class Similarity:
    """A threshold of ``num`` / ``den`` (at least one half) on sets of ``k``-word shingles."""

    def __init__(self, k: int, num: int, den: int):
        assert k >= 1 and den < 2 * num <= 2 * den
        self.k, self.num, self.den = k, num, den
        fit = [n for n in range(1, 4096) if self.kept(n) >= 2 and self.indexed(n, 2) <= COMBINED]
        self.low, self.high = (min(fit), max(fit)) if fit else (1, 0)
        self.bounds = [1]  # lengths at which the next band begins
        while self.bounds[-1] < 1 << 40:
            self.bounds.append(self.bounds[-1] * den // num + 1)

    def spare(self, n):
        """d: so many tokens of n may be missing in a partner."""
        return n - (n * self.num + self.den - 1) // self.den

    def extended(self, n):
        """e: length of the extended prefix."""
        return 2 * self.spare(n) + 1

    def kept(self, n):
        """kk: so many tokens of the extended prefix are in any partner's."""
        least = (n * self.num + self.den - 1) // self.den
        return self.spare(least) + 1

    def indexed(self, n, j: int):
        return self.extended(n) - self.kept(n) + j

    def linked(self, both, n_a, n_b):
        return both * self.den >= self.num * (n_a + n_b - both)


def _tokens(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    for _, data, offsets in words.chunks(texts):
        yield from words.shingles(*words.word_hashes(data, offsets), k)


def _node(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketches(docs: DataFrame, like: Similarity, text: str = "text") -> DataFrame:
    """(doc_id, n, node, band, prefix): set size, number of the set, band of lengths, and the
    extended prefix, which only the first of equal sets in a batch has. Without words n is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, n, node, prefix = set(), [], [], []
            for tokens in _tokens(batch.column("text"), like.k):
                n.append(len(tokens))
                node.append(_node(tokens) if len(tokens) else None)
                first = len(tokens) and node[-1] not in seen
                seen.add(node[-1])
                prefix.append(tokens[: like.extended(len(tokens))].view(np.int64) if first else None)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n": pa.array(n, pa.int64()),
                    "node": pa.array(node, pa.int64()),
                    "band": pa.array(np.searchsorted(like.bounds, n, "right"), pa.int32()),
                    "prefix": pa.array(prefix, pa.list_(pa.int64())),
                }
            )

    return docs.select("doc_id", F.col(f"`{text}`").alias("text")).mapInArrow(
        run, "doc_id bigint, n bigint, node bigint, band int, prefix array<bigint>"
    )


def _heavy(found: DataFrame) -> list[int]:
    """Tokens that a large share of all nodes has in the extended prefix; bounded. Each batch counts its own and
    puts out those that are frequent there, so no task sees all rows of one token. That such a token is here or not
    changes its place in the order of tokens only, which is the same for all nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("prefix").flatten().to_numpy(zero_copy_only=False)
            seen, n = np.unique(flat, return_counts=True)
            some = n >= max(2, batch.num_rows // (2 * HEAVY_SHARE))
            yield pa.RecordBatch.from_pydict({"token": pa.array(seen[some], pa.int64()), "n": pa.array(n[some], pa.int64())})

    prefixes = found.where("prefix IS NOT NULL").select("prefix")
    limit = max(FREQUENT * PAIRED, prefixes.count() // HEAVY_SHARE)
    counts = prefixes.mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") > limit).orderBy(F.desc("n"), "token").limit(HEAVY_TOKENS)
    return [r["token"] for r in top.collect()]


def _floor_div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("bigint")


def index(found: DataFrame, like: Similarity) -> DataFrame:
    """(entry, band, node): what each node is indexed under, once for its band of lengths and once
    for the next, so that nodes of neighbouring bands meet."""
    rows = found.where("prefix IS NOT NULL").select("node", "n", "band", F.explode("prefix").alias("token"))
    heavy = _heavy(found)
    light = rows.where(~F.col("token").isin(heavy)) if heavy else rows
    # dealt by token once: dropping repeats and counting need no further shuffle
    light = light.repartition("token").dropDuplicates(["token", "node", "n", "band"])
    shared = light.withColumn("df", F.count("*").over(W.partitionBy("token"))).where("df > 1")
    if heavy:
        often = rows.where(F.col("token").isin(heavy)).distinct()
        shared = shared.unionByName(often.withColumn("df", F.lit(_HEAVY)))
    nodes = shared.groupBy("node", "n", "band").agg(
        F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t")  # at most the node's prefix
    )
    n, num, den = F.col("n"), like.num, like.den
    spare = lambda x: x - _floor_div(x * num + (den - 1), den)
    least = _floor_div(n * num + (den - 1), den)
    alone = 2 * spare(n) + 1 - F.size("t")  # tokens no other node has come first and need no entry
    nodes = nodes.withColumn("one", 2 * spare(n) + 1 - (spare(least) + 1) + 1 - alone)
    inside = F.col("n").between(like.low, like.high)
    single = ~inside | (least < like.low) | (_floor_div(n * den, num) > like.high)
    nodes = nodes.select(
        "node", "band", "one", inside.alias("inside"), single.alias("single"),
        F.transform("t", lambda x, i: F.struct(i.alias("i"), x["token"].alias("token"), (x["df"] > FREQUENT).alias("often"))).alias("t"),
    )
    ones = F.filter(
        "t",
        lambda x: F.when(x["often"], F.col("single") & (x["i"] < F.col("one"))).otherwise(
            x["i"] < F.col("one") + F.col("inside").cast("int")
        ),
    )
    often = F.filter("t", lambda x: x["often"] & F.col("inside") & (x["i"] < F.col("one") + 1))
    nodes = nodes.select("node", "band", ones.alias("ones"), often.alias("often"))
    pairs = F.flatten(
        F.transform(
            "often",
            lambda x: F.transform(
                F.filter("often", lambda y: y["i"] > x["i"]),
                lambda y: F.xxhash64(x["token"], y["token"]),
            ),
        )
    )
    entries = F.concat(F.transform("ones", lambda x: x["token"]), pairs)
    return nodes.select("node", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), entries.alias("e")).select(
        F.explode("e").alias("entry"), "band", "node"
    )


def _links_of_pairs(pairs: DataFrame, sets: DataFrame, like: Similarity) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar."""
    a = sets.select(F.col("node").alias("a"), F.col("tokens").alias("a_tokens"))
    b = sets.select(F.col("node").alias("b"), F.col("tokens").alias("b_tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for x, y in zip(batch.column("a_tokens"), batch.column("b_tokens")):
                x, y = (np.frombuffer(t.as_buffer(), np.uint64) for t in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                hit.append(like.linked(both, len(x), len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return pairs.join(a, "a").join(b, "b").mapInArrow(run, "a bigint, b bigint")


def _similarity(tokens: list[np.ndarray]) -> np.ndarray:
    """(set, set): how many tokens they share, by matrix products over runs of tokens."""
    known, where = np.unique(np.concatenate(tokens), return_inverse=True)
    both = np.zeros((len(tokens), len(tokens)), np.float32)
    row = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    step = 1 << 14  # columns of the dense incidence matrix at a time
    order = np.argsort(where, kind="stable")
    cuts = np.searchsorted(where[order], np.arange(0, len(known) + step, step))
    for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
        dense = np.zeros((len(tokens), step), np.float32)
        dense[row[order[x:y]], where[order[x:y]] - i * step] = 1
        both += dense @ dense.T
    return both.round().astype(np.int64)


def _spanning(both: np.ndarray, sizes: np.ndarray, nodes: list[int], like: Similarity) -> list[tuple[int, int]]:
    """Links that connect what all similar pairs of these sets connect."""
    similar = like.linked(both, sizes[:, None], sizes[None, :])
    root, out = list(range(len(nodes))), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, j in zip(*np.nonzero(np.triu(similar, 1))):
        if (a := find(i)) != (b := find(j)):
            root[a] = b
            out.append((nodes[i], nodes[j]))
    return out


def _token_arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(t.as_buffer(), np.uint64) for t in column]


def _blocks(sets: Column, tokens: Column) -> Column:
    return F.greatest(F.ceil(sets / BLOCK_SETS), F.ceil(tokens / BLOCK_TOKENS)).cast("int")


def _met_pivots(placed: DataFrame, sets: DataFrame, like: Similarity) -> DataFrame:
    """(a, b, node, gaps), stored: links of each block of a crowd with itself and its crowd's pivots, and the distance of each
    member of a crowd of several blocks to the pivots, in order of their nodes."""
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    own = F.array(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    sent = placed.select("crowd", "node", "pivot", "blocks", F.explode(F.when(F.col("pivot"), every).otherwise(own)).alias("block"))

    def compare(table: pa.Table) -> pa.Table:
        nodes, tokens = table.column("node").to_pylist(), _token_arrays(table.column("tokens"))
        sizes, both = np.array([len(t) for t in tokens]), _similarity(tokens)
        links = _spanning(both, sizes, nodes, like)
        a, b = zip(*links) if links else ((), ())
        located, gaps = [], []
        if table.column("blocks")[0].as_py() > 1:
            pivot = np.array(table.column("pivot").to_pylist())
            at = sorted(np.flatnonzero(pivot).tolist(), key=nodes.__getitem__)[:MOST_PIVOTS]
            apart = 1 - both[:, at] / np.maximum(sizes[:, None] + sizes[at][None, :] - both[:, at], 1)
            block = table.column("block")[0].as_py()
            rows = [i for i in range(len(nodes)) if not pivot[i] or block == 0]  # a pivot is in all blocks
            located, gaps = [nodes[i] for i in rows], [apart[i].astype(np.float32).tolist() for i in rows]
        none = pa.nulls(len(located), pa.int64())
        return pa.concat_tables(
            [
                pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "node": pa.nulls(len(a), pa.int64()), "gaps": pa.nulls(len(a), pa.list_(pa.float32()))}),
                pa.table({"a": none, "b": none, "node": pa.array(located, pa.int64()), "gaps": pa.array(gaps, pa.list_(pa.float32()))}),
            ]
        )

    # a block and the pivots meet in a group, and their number and tokens are bounded
    met = (
        sent.join(sets.select("node", "tokens"), "node")
        .select("crowd", "block", "blocks", "node", "pivot", "tokens")
        .groupBy("crowd", "block")
        .applyInArrow(compare, "a bigint, b bigint, node bigint, gaps array<float>")
    )
    return stored(met, "ngram-pivots")


def _blocks_apart(located: DataFrame, like: Similarity) -> tuple[DataFrame, DataFrame]:
    """(block, node) of members that may have links to others with another label, and the pairs (x, y) of blocks to compare.

    ``located`` has crowd, node, n, band, label and gaps. Members of a label that fills blocks have blocks of their own; the
    others are dealt by their nearest pivot. Two blocks are compared unless all in them has one label, their
    bands are not neighbours, or their distances to some pivot differ too much.
    """
    labels = located.groupBy("crowd", "label").agg(F.count("*").alias("held"))
    crowds = labels.groupBy("crowd").agg(F.count("*").alias("labels"), F.max(F.struct("held", "label")).alias("top"))
    crowds = crowds.where("labels > 1").select("crowd", F.col("top.label").alias("top"))
    labels = stored(labels.join(crowds, "crowd"), "ngram-labels-held")  # crowds that are one by now are done
    rows = located.join(labels, ["crowd", "label"])
    near = F.array_position("gaps", F.array_min("gaps").cast("float")).cast("int")
    home = F.when(F.col("held") >= BLOCK_SETS, F.col("label"))
    cell = ["crowd", "band", "home", "near"]
    rows = rows.withColumn("near", near).withColumn("home", home)
    cells = rows.groupBy(*cell).agg(F.count("*").alias("sets"), F.sum("n").alias("tokens"))
    cells = cells.select(*cell, _blocks(F.col("sets"), F.col("tokens")).alias("blocks"))
    rows = spread_join(rows, cells, cell, SALTS, F.col("node"))
    chunk = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = stored(rows.withColumn("block", F.struct(*cell, chunk.alias("chunk"))), "ngram-blocks")
    ends = [F.struct(F.min(F.get("gaps", F.lit(i))).alias("lo"), F.max(F.get("gaps", F.lit(i))).alias("hi")) for i in range(MOST_PIVOTS)]
    outline = rows.groupBy("block", "top").agg(F.array(*ends).alias("ends"))
    outline = stored(outline.select("block", "block.crowd", "block.band", "block.home", "top", "ends"), "ngram-outlines")
    x = outline.where("home IS NULL OR home != top").select(*[F.col(c).alias(f"x_{c}") for c in outline.columns])
    y = outline.withColumn("minor", F.expr("home IS NULL OR home != top"))
    reach = 1 - like.num / like.den + 1e-5
    apart = F.exists(
        F.zip_with("x_ends", "ends", lambda a, b: (a["lo"] - b["hi"] > reach) | (b["lo"] - a["hi"] > reach)),
        lambda far: F.coalesce(far, F.lit(False)),
    )
    pairs = x.join(y, (F.col("x_crowd") == F.col("crowd")) & (F.abs(F.col("x_band") - F.col("band")) <= 1))
    # of two minor blocks the smaller one comes first; a block of one label has no links in itself that count
    once = ~F.col("minor") | (F.col("x_block") <= F.col("block"))
    same = F.coalesce(F.col("x_home") == F.col("home"), F.lit(False))
    pairs = pairs.where(once & ~same & ~apart).select(F.col("x_block").alias("x"), F.col("block").alias("y"))
    return rows.select("block", "node"), stored(pairs, "ngram-block-pairs")


def _links_of_crowds(crowds: DataFrame, sets: DataFrame, like: Similarity) -> DataFrame:
    """(a, b): links inside crowds (node, crowd) that connect all similar sets of a crowd."""
    members = crowds.join(sets.select("node", "n", "band"), "node")
    sizes = members.groupBy("crowd").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens"))
    sizes = sizes.select("crowd", "sets", _blocks(F.col("sets"), F.col("tokens")).alias("blocks"))
    picked = F.pmod(F.xxhash64(F.lit(7), "node"), F.ceil(F.col("sets") / PIVOTS)) == 0
    placed = spread_join(members, sizes, ["crowd"], SALTS, F.col("node"))
    placed = stored(placed.withColumn("pivot", (F.col("blocks") > 1) & picked), "ngram-crowds")
    met = _met_pivots(placed, sets, like)
    found = met.where("node IS NULL").select("a", "b")
    big = placed.where("blocks > 1")
    if big.isEmpty():
        return found
    labels = components(found.join(big.select(F.col("node").alias("a")), "a", "left_semi"))
    gaps = met.where("node IS NOT NULL").select("node", "gaps")
    located = big.join(gaps, "node").join(labels, "node", "left")
    located = located.select("crowd", "node", "n", "band", F.coalesce("component", "node").alias("label"), "gaps")
    blocks, pairs = _blocks_apart(located, like)

    def compare(table: pa.Table) -> pa.Table:
        tokens = _token_arrays(table.column("tokens"))
        sizes = np.array([len(t) for t in tokens])
        links = _spanning(_similarity(tokens), sizes, table.column("node").to_pylist(), like)
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    either = F.explode(F.array_distinct(F.array("x", "y"))).alias("block")
    sent = pairs.select("x", "y", either).join(blocks, "block").join(sets.select("node", "tokens"), "node")
    later = sent.select("x", "y", "node", "tokens").groupBy("x", "y").applyInArrow(compare, "a bigint, b bigint")
    return found.unionByName(later)


def links(docs: DataFrame, found: DataFrame, like: Similarity, text: str = "text") -> DataFrame:
    """(a, b): links between nodes of ``found`` (stored sketches) that connect all classes."""
    entries = stored(index(found, like), "ngram-index")
    entry = ["entry", "band"]
    sizes = entries.groupBy(*entry).agg(F.count("*").alias("nodes"), F.min("node").alias("hub")).where("nodes > 1")
    matched = stored(entries.join(sizes, entry), "ngram-matches")
    few = matched.where(F.col("nodes") <= PAIRED).select(*entry, "node")
    left, right = few.withColumnRenamed("node", "a"), few.withColumnRenamed("node", "b")
    pairs = left.join(right, entry).where("a < b").select("a", "b").distinct()
    many = matched.where((F.col("nodes") > PAIRED) & (F.col("node") != F.col("hub")))
    crowds = components(many.select(F.col("node").alias("a"), F.col("hub").alias("b")))

    # the complete sets of the nodes that have a candidate, from one document each
    wanted = matched.select("node").distinct()
    ids = found.groupBy("node").agg(F.min("doc_id").alias("low")).join(wanted, "node").select("low")
    some = docs.select("doc_id", F.col(f"`{text}`").alias("text")).join(
        ids.distinct(), F.col("doc_id").eqNullSafe(F.col("low")), "left_semi"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [t for t in _tokens(batch.column("text"), like.k) if len(t)]
            yield pa.RecordBatch.from_pydict(
                {
                    "node": pa.array([_node(t) for t in out], pa.int64()),
                    "n": pa.array([len(t) for t in out], pa.int64()),
                    "band": pa.array(np.searchsorted(like.bounds, [len(t) for t in out], "right"), pa.int32()),
                    "tokens": pa.array([t.tobytes() for t in out], pa.binary()),
                }
            )

    sets = some.mapInArrow(run, "node bigint, n bigint, band int, tokens binary")
    sets = stored(sets.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "ngram-sets")
    by_pair = _links_of_pairs(pairs, sets, like)
    by_crowd = _links_of_crowds(crowds.withColumnRenamed("component", "crowd"), sets, like)
    return by_pair.unionByName(by_crowd)


def classes(docs: DataFrame, like: Similarity, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    A text with fewer than k words is one shingle, its whole sequence; a null or empty text and one
    without words has none and is alone. Texts with equal sets are linked. component_id is the
    smallest doc_id reachable by links, its own included (null ids do not count, and a class of
    null ids has none). Repeated rows have the same result each. Tables may be empty.
    """
    found = stored(sketches(docs, like, text), "ngram-sketches")
    labels = stored(components(links(docs, found, like, text)), "ngram-labels")
    nodes = found.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("rows"))
    linked = labels.join(nodes, "node")
    best = linked.groupBy("component").agg(F.min("low").alias("best"))
    linked = linked.join(best, "component").select("node", "best")
    # only classes of more than one row need to be told to their members
    told = nodes.join(linked, "node", "left").where("rows > 1 OR best IS NOT NULL")
    told = told.select("node", F.coalesce("best", "low").alias("component_id"))
    rows = found.select("doc_id", F.col("n").alias("n_shingles"), "node")
    out = spread_join(rows, told, ["node"], SALTS, F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_similar(docs: DataFrame, like: Similarity, text: str = "text") -> DataFrame:
    """``docs`` with one row of each class: the one with the smallest doc_id.

    Texts without words are classes of their own and all stay, and so do rows with a null doc_id
    whose class has no id. Of rows that repeat the kept id and text, each stays.
    """
    (mark,) = free_names(docs, "kept_id")
    kept = classes(docs, like, text).where("component_id <=> doc_id").select(F.col("doc_id").alias(mark)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(mark)), "left_semi")
