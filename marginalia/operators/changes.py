"""Telling comment-only revisions from code changes.

revisions(path, ext, commit_id, commit_ts, message, content).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.langs import EXTENSIONS
from ..sources.ignore import drop_ignored_commit, with_ext
from .strip import prune
from .windows import lag_in_buckets

OWN_SUBJECT = "docs: auto-generated comments"


def skip_own_commits(revisions: DataFrame, subject: str = OWN_SUBJECT) -> DataFrame:
    """Drops commits whose message is exactly the automatic subject."""
    return revisions.where(~F.col("message").eqNullSafe(F.lit(subject)))


def changed_files(revisions: DataFrame, commit_id: int | None = None) -> DataFrame:
    """Files touched by a commit (default: every commit) with ``prev_content`` beside them.

    A revision that is delivered more than once counts once. For every commit, texts are lagged over
    the history in buckets of time, in one reading of it. For one commit, each task keeps of a path no more than
    the revision of that commit and the newest one before, so that little is shuffled.
    """
    if commit_id is not None:
        return _changed_in(revisions, commit_id)
    lagged = with_previous(revisions, ["commit_id", "content"])
    return lagged.where(~_delivered_again()).drop("prev_commit_id")


def _changed_in(revisions: DataFrame, commit_id: int) -> DataFrame:
    at = revisions.where(F.col("commit_id") == commit_id).agg(F.max("commit_ts").alias("at")).first()["at"]
    place, commit = F.struct("commit_ts", "commit_id"), F.struct(F.lit(at).alias("commit_ts"), F.lit(commit_id).alias("commit_id"))
    now = F.struct(*[F.col(c) for c in revisions.columns])
    before = F.struct("commit_ts", "commit_id", "content")
    found = revisions.groupBy("path").agg(
        F.max(F.when(F.col("commit_id") == commit_id, now)).alias("now"),
        F.max(F.when(place < commit, before)).alias("before"),
    )
    return found.where("now IS NOT NULL").select("now.*", F.col("before.content").alias("prev_content"))


def _delivered_again() -> Column:
    """Of rows of the same commit, which stand one behind the other, all but the first."""
    return F.coalesce(F.col("prev_commit_id") == F.col("commit_id"), F.lit(False))


def with_previous(
    revisions: DataFrame, columns: list[str], bucket_seconds: int = 86_400
) -> DataFrame:
    """Adds ``prev_<column>`` from the revision before, by (commit_ts, commit_id)."""
    slot = F.floor(F.unix_seconds("commit_ts") / bucket_seconds)
    return lag_in_buckets(revisions, "path", ["commit_ts", "commit_id"], slot, columns)


def code_digests(revisions: DataFrame) -> DataFrame:
    """revisions without content, with ``digest`` of the text without comments and
    ``is_empty``. Row-local; what is shuffled later is the digest, never the text."""
    return (
        prune(revisions, output="__code")
        .withColumn("digest", F.sha2("__code", 256))
        .withColumn("is_empty", F.col("content") == "")
        .drop("__code", "content")
    )


def change_kind(revisions: DataFrame, force: bool = False) -> DataFrame:
    """(path, ext, commit_id, commit_ts, message, kind, skipped).

    ``kind``: new, code, deleted (no content), or comment_only when the text without comments is
    unchanged. A missing, deleted or empty predecessor never makes a change comment-only.
    ``skipped`` is false for everything under ``force``. A revision that is delivered more than once counts once.
    """
    digests = with_previous(code_digests(revisions), ["commit_id", "digest", "is_empty"]).where(~_delivered_again())
    same = (F.col("digest") == F.col("prev_digest")) & ~F.col("prev_is_empty")
    kind = (
        F.when(F.col("digest").isNull(), "deleted")
        .when(F.col("prev_digest").isNull(), "new")
        .when(same, "comment_only")
        .otherwise("code")
    )
    return digests.select(
        "path",
        "ext",
        "commit_id",
        "commit_ts",
        "message",
        kind.alias("kind"),
        (F.lit(not force) & (kind == "comment_only")).alias("skipped"),
    )


def to_annotate(revisions: DataFrame, force: bool = False, subject: str = OWN_SUBJECT) -> DataFrame:
    """Revisions to send to the annotator: accepted language (by the path, whatever its case),
    not ignored, there after the commit, not made by the engine itself, and not comment-only."""
    # Revisions of the engine stay in until the comparison: they are predecessors too.
    wanted = drop_ignored_commit(with_ext(revisions).where(F.col("ext").isin(*EXTENSIONS)))
    kinds = change_kind(wanted, force).where(F.col("kind") != "deleted")
    return skip_own_commits(kinds, subject).where(~F.col("skipped"))


def files_per_commit(revisions: DataFrame) -> DataFrame:
    """(commit_id, n_files): accepted, not ignored files each commit touches."""
    wanted = drop_ignored_commit(with_ext(revisions).where(F.col("ext").isin(*EXTENSIONS)))
    # a path can be listed once per commit only, but revisions may be delivered twice
    return wanted.groupBy("commit_id").agg(F.count_distinct("path").alias("n_files"))
