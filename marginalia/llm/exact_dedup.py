"""Exact deduplication by Grace hashing: partition, partition again, compare whole contents.

1. In each Arrow batch, before any shuffle, rows of equal content become one local group, so a
   group of copies reaches the shuffle at most once per batch.
2. The most frequent hashes of local groups are counted. Their groups are partitioned by hash and salt first, and what is
   equal there becomes one group, so that of a content that a third of all batches hold as many groups are
   left as the root of their number.
3. Groups are partitioned by a hash of their content. A task fills an open-addressing table
   with its partition's contents; if they do not fit, all go to spill files by the next bits of the
   hash, and each file is treated the same way, until its contents fit.
4. The local groups learn their group's verdict by a key of their own, so the members of a
   very large group stay spread over tasks.

Equality is always that of complete contents; the hash only says where to look. Spill files lie in
the shared folder, in a folder per task attempt, and are removed when the task is done with them.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import shared_folder
from .frames import file_system, stored

#: Bytes of distinct contents that a task's table holds before its partition is split.
MEMORY = 64 << 20
#: Spill files of one split: so many bits of the hash are used up by each.
FAN_BITS = 4

#: Hashes that more local groups than this have are hot, the ``HOT_HASHES`` most frequent of them: any other has at most
#: one group in so many.
HOT_GROUPS, HOT_HASHES = 64, 1000

_MERGED = "g bigint, root bigint, first boolean, h bigint, content binary, n bigint, min_id bigint"
_VERDICT = "g bigint, winner boolean, keep_id bigint, group_size bigint, text_sha256 string"


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of blanks (space, tab to carriage return) is one space."""
    # a single space is right as it is, so only other runs are matched
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\t-\r][\x20\t-\r]*|\x20[\x20\t-\r]+", " ")


class ContentTable:
    """Open addressing with linear probing over contents; a slot holds the number of a content."""

    def __init__(self, bits: int = 10):
        self.slots = [-1] * (1 << bits)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.size = 0

    def _place(self, h: int, content: bytes | None) -> int:
        """The slot of this content, or the free one where it belongs."""
        mask = len(self.slots) - 1
        at = (h >> 17) & mask
        while (i := self.slots[at]) >= 0 and (
            content is None or self.hashes[i] != h or self.contents[i] != content
        ):
            at = (at + 1) & mask
        return at

    def number(self, h: int, content: bytes) -> int:
        """The number of this content, which is put in if it is new."""
        at = self._place(h, content)
        if self.slots[at] < 0:
            self.slots[at] = len(self.contents)
            self.hashes.append(h)
            self.contents.append(content)
            self.size += len(content) + 64
            if 2 * len(self.contents) > len(self.slots):
                self.slots = [-1] * (4 * len(self.slots))
                for i, hash_ in enumerate(self.hashes):
                    self.slots[self._place(hash_, None)] = i  # all differ: any free slot of the run
                return len(self.contents) - 1
        return self.slots[at]


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def local_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """(g, h, ids, first_at, n, min_id, row): rows of equal content in one batch are one group.

    ``row`` is the row with the smallest doc_id (null ids come last, ties by position) and
    ``first_at`` its place in ``ids``. ``g`` is unique as soon as the result is stored.
    """
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = keyed.withColumn("content", normalised(F.col(f"row.{text}"))).withColumn("h", F.xxhash64("content"))
    schema = T.StructType.fromDDL(
        "g bigint, h bigint, ids array<bigint>, first_at int, n bigint, min_id bigint"
    ).add("row", keyed.schema["row"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 36
        for batch in batches:
            if not batch.num_rows:
                continue
            table, members = ContentTable(), []
            contents = batch.column("content")
            for i, h in enumerate(batch.column("h").to_pylist()):
                number = table.number(h, contents[i].as_buffer().to_pybytes())
                if number == len(members):
                    members.append([])
                members[number].append(i)
            doc_ids = batch.column("row").field("doc_id").to_pylist()
            ids = [[doc_ids[i] for i in rows] for rows in members]
            firsts = [
                min(range(len(own)), key=lambda j: (own[j] is None, own[j] or 0)) for own in ids
            ]
            keep = pa.array([rows[j] for rows, j in zip(members, firsts)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(made, made + len(ids)), pa.int64()),
                    batch.column("h").take(keep),
                    pa.array(ids, pa.list_(pa.int64())),
                    pa.array(firsts, pa.int32()),
                    pa.array([len(own) for own in ids], pa.int64()),
                    pa.array([own[j] for own, j in zip(ids, firsts)], pa.int64()),
                    batch.column("row").take(keep),
                ],
                names=schema.names,
            )
            made += len(ids)

    return keyed.mapInArrow(run, schema)


def _verdicts(rows: Iterator[list[tuple]], depth: int, spill: str, memory: int) -> Iterator[list[tuple]]:
    """Verdicts of lists of (g, h, content, n, min_id), in lists; splits what does not fit."""
    table, seen, spilled = ContentTable(), [], None
    can_split = FAN_BITS * (depth + 1) <= 64
    for some in rows:
        if spilled is not None:
            spilled.write(some)
            continue
        for g, h, content, n, min_id in some:
            seen.append((g, table.number(h, content), n, min_id))
        if table.size > memory and can_split:
            spilled = _Spill(spill, depth)
            spilled.write([(g, table.hashes[i], table.contents[i], n, low) for g, i, n, low in seen])
            table, seen = ContentTable(), []
    if spilled is not None:
        yield from spilled.read(lambda part: _verdicts(part, depth + 1, spill, memory))
        return
    size, low, best = ([x] * len(table.contents) for x in (0, None, None))
    for g, i, n, min_id in seen:
        size[i] += n
        rank = _rank(min_id, g)
        if best[i] is None or rank < best[i]:
            best[i] = rank
        low[i] = _least(low[i], min_id)
    digest = [hashlib.sha256(content).hexdigest() for content in table.contents]
    for at in range(0, len(seen), 10_000):
        yield [(g, best[i][2] == g, low[i], size[i], digest[i]) for g, i, _, _ in seen[at : at + 10_000]]


class _Spill:
    """Rows in 2 ** FAN_BITS Arrow files by the hash's next bits, in a folder of the shared store."""

    SCHEMA = pa.schema(
        [("g", pa.int64()), ("h", pa.int64()), ("content", pa.binary()), ("n", pa.int64()), ("min_id", pa.int64())]
    )

    def __init__(self, folder: str, depth: int):
        self.shift = 64 - FAN_BITS * (depth + 1)
        self.system, base = file_system(folder)
        self.base = f"{base}/{uuid.uuid4().hex}"
        self.system.create_dir(self.base, recursive=True)
        names = [f"{self.base}/{i:02d}.arrow" for i in range(1 << FAN_BITS)]
        self.files = [(name, self.system.open_output_stream(name)) for name in names]
        self.writers = [pa.ipc.new_stream(f, self.SCHEMA) for _, f in self.files]

    def write(self, rows: list[tuple]) -> None:
        parts: dict[int, list[tuple]] = {}
        for row in rows:
            parts.setdefault((row[1] >> self.shift) & ((1 << FAN_BITS) - 1), []).append(row)
        for i, part in parts.items():
            columns = [pa.array(list(c), f.type) for c, f in zip(zip(*part), self.SCHEMA)]
            self.writers[i].write_batch(pa.RecordBatch.from_arrays(columns, schema=self.SCHEMA))

    def read(self, use) -> Iterator[list[tuple]]:
        for (_, f), writer in zip(self.files, self.writers):
            writer.close()
            f.close()
        try:
            for name, _ in self.files:
                with self.system.open_input_stream(name) as f:
                    yield from use(_tuples(pa.ipc.open_stream(f)))
        finally:
            self.system.delete_dir(self.base)


def _tuples(batches, step: int = 1000) -> Iterator[list[tuple]]:
    """(g, h, content, n, min_id) of Arrow batches, a thousand rows at a time."""
    for batch in batches:
        g, h, n, low = (batch.column(c).to_pylist() for c in ("g", "h", "n", "min_id"))
        content = batch.column("content")
        for at in range(0, len(g), step):
            own = [c.as_buffer().to_pybytes() for c in content[at : at + step]]
            yield list(zip(g[at : at + step], h[at : at + step], own, n[at : at + step], low[at : at + step]))


def _hot(groups: DataFrame) -> dict[int, int]:
    """{hash: salts} of the hashes with the most local groups; bounded. What is not in it is only slower."""
    counts = groups.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > HOT_GROUPS)
    top = counts.orderBy(F.desc("n"), "h").limit(HOT_HASHES).collect()
    return {r["h"]: math.isqrt(r["n"] - 1) + 1 for r in top}


def _rank(min_id: int | None, g: int) -> tuple:
    return min_id is None, min_id or 0, g


def _merged(contents: DataFrame, hot: dict[int, int]) -> DataFrame:
    """(g, root, first, h, content, n, min_id), stored: the groups of hot hashes, merged by hash and salt where they are
    equal. ``first`` marks the group with the smallest row of those with one ``root``; only that row has the
    content, and the count and smallest id of them all."""
    frame = contents.sparkSession.createDataFrame(list(hot.items()), "hot_h bigint, salts int")
    rows = contents.join(F.broadcast(frame), F.col("h") == F.col("hot_h"))  # HOT_HASHES rows at most
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("g"), F.col("salts")).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = ContentTable(), []
        for some in _tuples(batches):
            seen += [(g, table.number(h, content), n, low) for g, h, content, n, low in some]
        total, best, low = ([x] * len(table.contents) for x in (0, None, None))
        for g, i, n, min_id in seen:
            total[i] += n
            low[i] = _least(low[i], min_id)
            best[i] = min(filter(None, (best[i], _rank(min_id, g))))
        for at in range(0, len(seen), 10_000):
            out = []
            for g, i, _, _ in seen[at : at + 10_000]:
                root = best[i][2]
                mine = (table.hashes[i], table.contents[i], total[i], low[i]) if g == root else (table.hashes[i], None, None, None)
                out.append((g, root, g == root, *mine))
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            columns = [pa.array(list(c), kind) for c, kind in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _MERGED.split(", ")])

    dealt = salted.repartition("h", "salt").select("g", "h", "content", "n", "min_id")
    return stored(dealt.mapInArrow(run, _MERGED), "merged-groups")


def group_verdicts(groups: DataFrame, text: str = "text", memory: int = MEMORY) -> DataFrame:
    """(g, winner, keep_id, group_size, text_sha256) of stored local groups."""
    spill = shared_folder(groups.sparkSession, "grace-spill")
    contents = groups.select("g", "h", normalised(F.col(f"row.{text}")).alias("content"), "n", "min_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _VERDICT.split(", ")]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
        for rows in _verdicts(_tuples(batches), 0, spill, memory):
            if rows:
                columns = [pa.array(list(c), kind) for c, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    hot = _hot(groups)
    if not hot:
        return contents.repartition("h").mapInArrow(run, _VERDICT)
    merged = _merged(contents, hot)
    cold = contents.where(~F.col("h").isin(list(hot)))
    roots = merged.where("first").select("g", "h", F.col("content").cast("string").alias("content"), "n", "min_id")
    verdicts = stored(cold.unionByName(roots).repartition("h").mapInArrow(run, _VERDICT), "verdicts")
    members = merged.where("NOT first").select("g", "root")
    told = verdicts.withColumnRenamed("g", "root").join(members, "root")
    others = told.select("g", F.lit(False).alias("winner"), "keep_id", "group_size", "text_sha256")
    return verdicts.unionByName(others)


def copies(docs: DataFrame, text: str = "text", memory: int = MEMORY) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are one content. Of equal contents the row with the smallest doc_id is
    kept; of rows that repeat that id one, and where all ids are null one of them, with a null
    keep_id. Columns besides doc_id and ``text`` play no part, whatever their names. An empty
    table gives an empty result.
    """
    groups = stored(local_groups(docs.select("doc_id", text), text), "local-groups")
    verdicts = group_verdicts(groups, text, memory)
    members = groups.select("g", "first_at", "ids").join(verdicts, "g")
    return members.select("*", F.posexplode("ids").alias("at", "doc_id")).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("winner") & (F.col("at") == F.col("first_at"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, text: str = "text", memory: int = MEMORY) -> DataFrame:
    """``docs`` with one row of each content: the one that ``copies`` keeps, with all its columns."""
    groups = stored(local_groups(docs, text), "local-groups")
    winners = group_verdicts(groups, text, memory).where("winner").select("g")
    return groups.join(winners, "g", "left_semi").select("row.*")
