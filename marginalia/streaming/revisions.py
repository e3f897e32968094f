"""The commit loop as a stream of revisions.

Stripping and density are row-local, so the batch operators run on streams as they are.
Telling comment-only changes apart takes state: the digest of the last code per path. A micro-batch is compared with
itself as a table; only the last revision of each path meets the state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import TAG
from ..operators.changes import code_digests, with_previous
from ..operators.metrics import line_counts, ratio
from ..operators.strip import clean, prune
from ..sources.files import REVISIONS_SCHEMA
from ..sources.shared import exists, numbered, remove

def revision_stream(
    spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = 1000, tasks: int | None = None
) -> DataFrame:
    """revisions as they arrive as files in ``path``, at most ``max_files`` per micro-batch.

    A file is often one task, so few files to lex would keep few cores busy: with ``tasks`` the rows of each micro-batch
    are dealt over so many.
    """
    reader = spark.readStream.format(fmt).schema(REVISIONS_SCHEMA)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.load(path)
    return stream if tasks is None else stream.repartition(tasks)


def source_stream(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """files(path, ext, content) as source files appear below ``root``."""
    from ..sources.files import ACCEPTED_GLOB
    from ..sources.ignore import extension_of

    reader = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", ACCEPTED_GLOB)
    )
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return reader.load(root).select(
        "path", extension_of(F.col("path")).alias("ext"), text.alias("content")
    )


def strip_stream(stream: DataFrame, mode: str = "strict", tag: str = TAG) -> DataFrame:
    """Stateless stripping of a stream: strict, prune or clean."""
    if mode == "clean":
        return clean(stream, tag)
    return prune(stream, policy="strict" if mode == "strict" else "compat")


_PLACE = ("commit_ts", "commit_id")
_LAST = (*_PLACE, "digest", "is_empty")
_LAST_SCHEMA = "commit_ts timestamp, commit_id bigint, digest string, is_empty boolean"
_EDGES = f"path string, {_LAST_SCHEMA}"
_NEWEST = "path string, last struct<{0}>, seen struct<{0}>, met boolean".format(
    "commit_ts:timestamp,commit_id:bigint,digest:string,is_empty:boolean"
)


def _place(revision: Column) -> Column:
    return F.struct(*[revision[c] for c in _PLACE])


def _in_state(newest: DataFrame, watermark: int | None, ttl_ms: int | None) -> DataFrame:
    """(path, seen): the paths of the table of a micro-batch that the next one still knows."""
    if watermark is not None:
        newest = newest.where(F.unix_millis("last.commit_ts") + ttl_ms >= watermark)
    return newest.select("path", F.col("last").alias("seen"))


def _met(ends: DataFrame, state: DataFrame, watermark: int | None) -> DataFrame:
    """(path, last, seen, met): the newest revision of each path after a micro-batch; ``seen`` is that before, and ``met``
    tells whether the micro-batch has the path and its last revision is not behind the watermark."""
    here = F.col("here")
    arrived = ends.select("path", F.struct(*_LAST).alias("here"))
    if watermark is not None:
        arrived = arrived.where(F.unix_micros("here.commit_ts") > watermark * 1000)
    newer = here.isNotNull() & (F.col("seen").isNull() | (_place(F.col("seen")) <= _place(here)))
    return arrived.join(state, "path", "full").select(
        "path", F.when(newer, here).otherwise(F.col("seen")).alias("last"), "seen", here.isNotNull().alias("met")
    )


def _in_order(batch: DataFrame) -> DataFrame:
    """Digests of a micro-batch (made here if it still has texts), each with the revision of its path before it there. A revision
    that is delivered twice in a micro-batch counts once. Lags run in buckets of time, so a path that holds most of
    the batch is spread."""
    here = code_digests(batch) if "content" in batch.columns else batch
    once = here.dropDuplicates(["path", "commit_ts", "commit_id", "digest"])
    return with_previous(once, list(_LAST), bucket_seconds=3600)


def _kinds(rows: DataFrame, before: DataFrame, ttl_ms: int | None) -> DataFrame:
    """The rows of a micro-batch with their kinds; ``before`` has one row per path (none: all of it was too late)."""
    # never broadcast: there may be as many paths as rows. Adaptive execution cuts the rows of a hot path.
    told = before.select("path", "seen", F.lit(True).alias("told")).hint("merge")
    known = rows.join(told, "path", "left")

    own = F.struct(*_PLACE)
    seen, told = F.col("seen"), F.col("told").isNotNull()
    late = ~told | (seen.isNotNull() & (own < _place(seen)))
    prev = F.struct(*[F.col(f"prev_{c}").alias(c) for c in _LAST])
    # the one before is that of the batch, unless that is late itself; then it is the newest seen before
    in_batch = prev["commit_ts"].isNotNull() & (seen.isNull() | (_place(prev) >= _place(seen)))
    was = F.when(in_batch, prev).otherwise(seen)
    if ttl_ms is not None:
        age = F.unix_millis("commit_ts") - F.unix_millis(was["commit_ts"])
        was = F.when(age <= ttl_ms, was)
    kind = (
        F.when(late, "late")
        .when(F.col("digest").isNull(), "deleted")
        .when(F.col("was.digest").isNull(), "new")
        .when((F.col("digest") == F.col("was.digest")) & ~F.col("was.is_empty"), "comment_only")
        .otherwise("code")
    )
    judged = known.withColumn("was", was)
    return judged.select("path", "ext", "commit_id", "commit_ts", "message", kind.alias("kind"))


def drain_change_kinds(
    stream: DataFrame, out: str, work: str, ttl: str | None = None, delay: str = "0 seconds"
) -> StreamingQuery:
    """Tells the kinds of all revisions that are there, and writes them to ``out`` as parquet, a folder per micro-batch.

    (path, ext, commit_id, commit_ts, message, kind): ``kind`` is new, code, comment_only, deleted, or late for a
    revision older than the newest one that an earlier micro-batch had of its path. A micro-batch is compared
    with itself, spread over tasks; only the last revision of each path meets the state. That is a table with a digest
    and a place per path; a micro-batch joins it with its last revisions and writes the next one, in plain columns, so no
    path costs a call of its own. It is written anew by each micro-batch, which is meant for micro-batches that are not
    small beside it, and tables before the last two are removed.

    With ``ttl`` (such as ``30 days``) a path whose newest revision is older than that by the time of commits is new again; it
    leaves the state when the watermark, ``delay`` behind the newest revision of all, has passed. Revisions
    of paths that are behind the watermark altogether are late; ``late_counts`` counts them.

    ``work`` holds the checkpoint, the state and the digests of the rows. A micro-batch that runs again finds the digests
    that it has put down and the state of the one before, so each revision is told once.
    """
    spark = stream.sparkSession
    ttl_ms = None if ttl is None else _milliseconds(spark, ttl)
    delay_ms = _milliseconds(spark, delay)

    def put(batch: DataFrame, number: int) -> None:
        rows_at, edges_at = f"{work}/rows/batch={number}", f"{work}/edges/batch-{number}"
        if not exists(spark, f"{rows_at}/_SUCCESS"):
            code_digests(batch).write.mode("overwrite").parquet(rows_at)
        rows = spark.read.parquet(rows_at)
        if rows.isEmpty():
            return
        if not exists(spark, f"{edges_at}/_SUCCESS"):
            last = F.max(F.struct(*_LAST)).alias("last")
            rows.groupBy("path").agg(last).select("path", "last.*").write.mode("overwrite").parquet(edges_at)
        whole = [n for n in numbered(spark, f"{work}/newest", "batch=") if n < number and exists(spark, f"{work}/newest/batch={n}/_SUCCESS")]
        watermark, state = None, spark.createDataFrame([], _NEWEST)
        if whole:
            state = spark.read.schema(_NEWEST).parquet(f"{work}/newest/batch={max(whole)}")
            if ttl_ms is not None:
                newest = state.agg(F.unix_millis(F.max("last.commit_ts")).alias("ms")).first()["ms"]
                watermark = None if newest is None else newest - delay_ms
        ends = spark.read.schema(_EDGES).parquet(edges_at)
        newest_at = f"{work}/newest/batch={number}"
        _met(ends, _in_state(state, watermark, ttl_ms), watermark).write.mode("overwrite").parquet(newest_at)
        known = spark.read.schema(_NEWEST).parquet(newest_at).where("met")
        _kinds(_in_order(rows), known, ttl_ms).write.mode("overwrite").parquet(f"{out}/batch={number}")
        for old in sorted(whole)[:-1]:
            remove(spark, f"{work}/newest/batch={old}")

    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{work}/batches").foreachBatch(put).start()
    query.awaitTermination()
    return query


def _milliseconds(spark: SparkSession, interval: str) -> int:
    sql = f"SELECT unix_millis(timestamp'1970-01-01 00:00:00Z' + interval '{interval}') AS ms"
    return spark.sql(sql).first()["ms"]


def read_change_kinds(spark: SparkSession, out: str) -> DataFrame:
    """(path, ext, commit_id, commit_ts, message, kind) that ``drain_change_kinds`` has written."""
    schema = "path string, ext string, commit_id bigint, commit_ts timestamp, message string, kind string"
    return spark.read.schema(schema).parquet(out).drop("batch")


def late_counts(kinds: DataFrame) -> DataFrame:
    """(day, n_revisions, n_late): how many revisions of each day of commits came too late."""
    day = F.date_trunc("day", "commit_ts").alias("day")
    return kinds.groupBy(day).agg(F.count("*").alias("n_revisions"), F.count_if(F.col("kind") == "late").alias("n_late"))


def density_stream(revisions: DataFrame, watermark: str = "30 days", width: str = "1 day") -> DataFrame:
    """Comment density of the revisions per tumbling window of commit time and language.

    Windows older than the watermark leave the state. Written in update mode, so a batch puts out
    the windows it changed and no others (see ``drain_merged`` and ``merged``).
    """
    counted = line_counts(revisions.withWatermark("commit_ts", watermark))
    return (
        counted.select("ext", "commit_ts", "n_comment", "n_code")
        .groupBy(F.window("commit_ts", width).alias("w"), "ext")
        .agg(
            F.count("*").alias("n_files"),
            F.sum("n_comment").alias("n_comment"),
            F.sum("n_code").alias("n_code"),
        )
        .select(
            F.col("w.start").alias("day"),
            "ext",
            "n_files",
            "n_comment",
            "n_code",
            ratio(F.col("n_comment"), F.col("n_code")).alias("per_code"),
        )
    )


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes everything that is there and writes it to ``out`` as parquet.

    Append streams use the file sink, which is exactly-once. In update mode each micro-batch
    has a folder of its own below ``out``, which a batch that runs again replaces; read them with
    ``latest``.
    """
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").start(out)
    else:

        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        query = writer.outputMode(mode).foreachBatch(put).start()
    query.awaitTermination()
    return query


def latest(spark: SparkSession, out: str, *keys: str) -> DataFrame:
    """What an update stream last said about each of its keys."""
    return _newest_of(spark.read.parquet(out), keys)


def _newest_of(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = F.max_by(F.struct(*rest), "batch").alias("newest")
    return rows.groupBy(*keys).agg(newest).select(*keys, "newest.*")


def drain_merged(stream: DataFrame, out: str, checkpoint: str, *keys: str) -> StreamingQuery:
    """Processes everything that is there in update mode and keeps one table of what was last said about each of ``keys`` in ``out``.

    A micro-batch merges its rows into the table of the one before and writes the result as a table of its own, which
    ``merged`` reads once it is whole. A batch that runs again starts from the same table. Older tables are
    removed, so ``out`` holds two at most, however many micro-batches there have been; a reader has until the
    end of the next but one. A batch rewrites the table, which is meant for rows by window and not by file.
    """
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("batch", F.lit(1))
        if number > 0:
            before = spark.read.schema(batch.schema).parquet(f"{out}/batch={number - 1}")
            rows = rows.unionByName(before.withColumn("batch", F.lit(0)))
        _newest_of(rows, keys).select(*batch.columns).write.mode("overwrite").parquet(f"{out}/batch={number}")
        remove(spark, f"{out}/batch={number - 2}")

    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    query = writer.outputMode("update").foreachBatch(put).start()
    query.awaitTermination()
    return query


def merged(spark: SparkSession, out: str) -> DataFrame:
    """The newest whole table that ``drain_merged`` has written."""
    whole = [n for n in numbered(spark, out, "batch=") if exists(spark, f"{out}/batch={n}/_SUCCESS")]
    if not whole:
        raise FileNotFoundError(f"no table in {out}")
    return spark.read.parquet(f"{out}/batch={max(whole)}")
