"""The registered queries: every operator over corpora made from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import changes, lines, metrics, prompts, responses, splice, strip, verify
from ..sources import ignore
from ..sources.corpora import corpus
from ..sources.files import (
    qualified,
    read_responses,
    read_suggestions,
    read_version,
    scan_source_tree,
    write_files,
    write_tree,
    write_version,
)
from ..sources.shared import shared_folder
from ..streaming import revisions
from . import annotate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

USER_IGNORES = ["# ours", "  repo3/ ", "*9.py", "", "*.kt", "part_7.html"]


def widened(df: DataFrame) -> DataFrame:
    """Integer columns as BIGINT, so that results compare with other engines."""
    small = (T.IntegerType, T.ShortType, T.ByteType)
    return df.select(
        *[
            F.col(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, small) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return widened(fn(spark, sf_dir))

    QUERIES[fn.__name__] = run
    return fn


def _marked_tokens(files: DataFrame) -> DataFrame:
    return (
        lines.token_positions(files)
        .where(F.col("kind") != "code")
        .select("path", "kind", "line_no", "col", "n_lines", "text")
    )


# -- pages ----------------------------------------------------------------------------
@query
def page_tokens(spark, d):
    return _marked_tokens(corpus(spark, d, "pages_html"))


@query
def page_comments(spark, d):
    return lines.comments(corpus(spark, d, "pages_html"))


@query
def page_prune(spark, d):
    return strip.prune(corpus(spark, d, "pages_html")).select("path", "content")


@query
def page_density(spark, d):
    return metrics.density(corpus(spark, d, "pages_html"))


# -- scans and filters ------------------------------------------------------------------
def _odd_paths(spark, d):
    k, path = F.col("k"), F.col("path")
    return corpus(spark, d, "src_part").select(
        F.when(k % 5 == 0, F.upper(path))
        .when(k % 5 == 1, F.concat(path, F.lit(".md")))
        .when(k % 5 == 2, F.concat(F.lit("repo/"), k.cast("string"), F.lit("/"), F.col("ext")))
        .when(k % 5 == 3, F.concat(path, F.lit(".")))
        .otherwise(path)
        .alias("path"),
        "content",
    )


@query
def accepted_files(spark, d):
    return ignore.accepted_files(_odd_paths(spark, d)).select("path", "ext")


@query
def ignored_scan(spark, d):
    user = spark.createDataFrame([(p,) for p in USER_IGNORES], "value string")
    patterns = ignore.ignore_patterns(spark, user)
    return ignore.drop_ignored(corpus(spark, d, "src_part"), patterns).select("path")


@query
def ignored_commit(spark, d):
    return ignore.drop_ignored_commit(corpus(spark, d, "src_part")).select("path")


@query
def skip_empty(spark, d):
    return ignore.drop_empty(corpus(spark, d, "src_part")).select("path")


# -- lines and tokens -------------------------------------------------------------------
@query
def split_lines(spark, d):
    return lines.to_lines(corpus(spark, d, "src_part"))


@query
def eol_style(spark, d):
    return lines.with_eol(corpus(spark, d, "src_part")).select("path", "eol")


@query
def numbered_listing(spark, d):
    return lines.number_lines(corpus(spark, d, "src_part"))


@query
def part_tokens(spark, d):
    return _marked_tokens(corpus(spark, d, "src_part"))


@query
def part_code(spark, d):
    return lines.code_runs(corpus(spark, d, "src_part"))


@query
def doc_code(spark, d):
    return lines.code_runs(corpus(spark, d, "docs_text"))


@query
def part_comments(spark, d):
    return lines.comments(corpus(spark, d, "src_part"))


@query
def line_state(spark, d):
    return lines.line_state(corpus(spark, d, "src_part")).where(F.col("text").isNotNull())


@query
def starts_in_string(spark, d):
    return (
        lines.line_state(corpus(spark, d, "src_part")).where("starts_in_string").select("path", "line_no")
    )


@query
def hard_comments(spark, d):
    return lines.comments(corpus(spark, d, "hard_part")).select("path", "seq", "text")


# -- stripping --------------------------------------------------------------------------
@query
def prune(spark, d):
    return strip.prune(corpus(spark, d, "src_part")).select("path", "content")


@query
def clean(spark, d):
    return strip.clean(corpus(spark, d, "src_part")).select("path", "content")


@query
def strict_prune(spark, d):
    return strip.prune(corpus(spark, d, "src_part"), policy="strict").select("path", "content")


@query
def hard_strict_prune(spark, d):
    return strip.prune(corpus(spark, d, "hard_part"), policy="strict").select("path", "content")


@query
def quirk_strict_prune(spark, d):
    return strip.prune(corpus(spark, d, "quirk_part"), policy="strict").select("path", "content")


@query
def quirk_comments(spark, d):
    return lines.comments(corpus(spark, d, "quirk_part")).select("path", "seq", "text")


@query
def doc_prune(spark, d):
    return strip.prune(corpus(spark, d, "docs_text")).select("path", "content")


@query
def doc_density(spark, d):
    return metrics.density(corpus(spark, d, "docs_text"))


@query
def dry_run(spark, d):
    return strip.preview(corpus(spark, d, "src_part"), lambda f: strip.clean(f, output="after"))


@query
def explicit_deletions(spark, d):
    files, _ = strip.apply_deletions(corpus(spark, d, "src_part"), corpus(spark, d, "del_part"), "[ds]")
    return files.select("path", "content")


@query
def refused_deletions(spark, d):
    _, refused = strip.apply_deletions(corpus(spark, d, "src_part"), corpus(spark, d, "del_part"), "[ds]")
    return refused


@query
def prune_bulk(spark, d):
    return strip.prune(corpus(spark, d, "src_order")).select("path", "content")


# -- inserting --------------------------------------------------------------------------
@query
def valid_suggestions(spark, d):
    return splice.valid_suggestions(corpus(spark, d, "sugg_order"), corpus(spark, d, "src_order"))


@query
def refused_suggestions(spark, d):
    asked = corpus(spark, d, "del_part").withColumn("idx", F.lit(0)).withColumn("comment", F.lit("// x"))
    return splice.refused_suggestions(asked, corpus(spark, d, "src_part")).select("path", "line")


@query
def insertable_suggestions(spark, d):
    asked = corpus(spark, d, "del_part").withColumn("idx", F.lit(0)).withColumn("comment", F.lit("// x"))
    ok, _ = splice.insertable(asked, corpus(spark, d, "src_part"))
    return ok.select("path", "line")


@query
def expanded_comments(spark, d):
    return splice.expand_comments(corpus(spark, d, "sugg_order"))


def _orders(spark, d):
    return corpus(spark, d, "src_order"), corpus(spark, d, "sugg_order")


@query
def splice_comments(spark, d):
    return splice.splice(*_orders(spark, d)).select("path", "content")


QUERIES["splice"] = QUERIES.pop("splice_comments")


@query
def spliced_lines(spark, d):
    return splice.spliced_lines(*_orders(spark, d))


@query
def annotate_overwrite(spark, d):
    return splice.annotate(*_orders(spark, d), overwrite=True).select("path", "content")


@query
def annotate_keep(spark, d):
    return splice.annotate(*_orders(spark, d), overwrite=True, keep=True).select("path", "content")


# -- verification -----------------------------------------------------------------------
@query
def verify_lines(spark, d):
    files = corpus(spark, d, "src_part")
    spoiled = F.when(F.col("orig_line") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    out = strip.stripped_lines(files).withColumn("text", spoiled)
    return verify.verify_lines(files, out, mode="prune")


@query
def verify_order(spark, d):
    out = strip.stripped_lines(corpus(spark, d, "src_part"))
    moved = F.when(F.col("out_line") % 4 == 0, F.col("orig_line") - 3).otherwise(F.col("orig_line"))
    return verify.verify_order(out.withColumn("orig_line", moved), chunk=8)


@query
def verify_roundtrip(spark, d):
    return verify.splice_roundtrip(*_orders(spark, d))


@query
def lost_code(spark, d):
    return verify.lost_code(corpus(spark, d, "src_part"))


@query
def payload_audit(spark, d):
    return verify.payload_audit(*_orders(spark, d))


@query
def quarantine(spark, d):
    """Which files a run may not write, found in their rows."""
    return verify.audit_flags(*_orders(spark, d)).select("path", "bad")


@query
def quarantine_join(spark, d):
    """The same from the table of violations."""
    files, suggestions = _orders(spark, d)
    return verify.flag_violations(files, verify.payload_audit(files, suggestions)).select("path", "bad")


# -- prompts and responses --------------------------------------------------------------
@query
def prompt_table(spark, d):
    return prompts.build_prompts(corpus(spark, d, "src_part"), "full")


QUERIES["prompts"] = QUERIES.pop("prompt_table")


@query
def response_text(spark, d):
    return responses.response_text(corpus(spark, d, "resp_order"))


@query
def response_items(spark, d):
    return responses.response_items(corpus(spark, d, "resp_order"))


@query
def response_errors(spark, d):
    return responses.response_errors(corpus(spark, d, "resp_order"))


@query
def stored_responses(spark, d):
    """Responses as they are stored, one JSON object a line."""
    folder = shared_folder(spark, "responses")
    corpus(spark, d, "resp_order").write.json(folder)
    return responses.response_errors(read_responses(spark, folder))


@query
def stored_suggestions(spark, d):
    folder = shared_folder(spark, "suggestions")
    corpus(spark, d, "sugg_order").write.orc(folder)
    return splice.expand_comments(read_suggestions(spark, folder, "orc"))


@query
def accepted_items(spark, d):
    return responses.accepted_items(corpus(spark, d, "resp_order"))


@query
def accepted_deletions(spark, d):
    accepted = responses.accepted_items(corpus(spark, d, "resp_clean"), mode="clean")
    return accepted.select("path", "idx", "line")


@query
def request_outcomes(spark, d):
    return responses.request_outcomes(corpus(spark, d, "attempts_events"))


# -- changes ----------------------------------------------------------------------------
@query
def change_kind(spark, d):
    return changes.change_kind(corpus(spark, d, "rev_part")).drop("skipped")


@query
def to_annotate(spark, d):
    return changes.to_annotate(corpus(spark, d, "rev_listed")).drop("skipped")


@query
def changed_files(spark, d):
    sha = lambda c: F.sha2(F.col(c), 256).alias(c)
    found = changes.changed_files(corpus(spark, d, "rev_listed"))
    return found.select("path", "commit_id", sha("content"), sha("prev_content"))


@query
def files_per_commit(spark, d):
    return changes.files_per_commit(corpus(spark, d, "rev_listed"))


# -- metrics ----------------------------------------------------------------------------
@query
def density_bulk(spark, d):
    return metrics.density_by(corpus(spark, d, "src_order"), "ext")


@query
def target_bands(spark, d):
    """Whether the files of each mode have about as many comments as the mode is to give."""
    mode = F.when(F.length("path") % 3 == 0, "light").when(F.length("path") % 3 == 1, "default").otherwise("full")
    found = metrics.density(corpus(spark, d, "src_part")).withColumn("mode", mode)
    return found.select("path", "mode", metrics.in_target_band(F.col("per_code"), F.col("mode")).alias("in_band"))


@query
def density_by_language(spark, d):
    by_length = F.length("path") % 3
    mode = F.when(by_length == 0, "light").when(by_length == 1, "default").otherwise("full")
    return metrics.density_by(corpus(spark, d, "src_part").withColumn("mode", mode), "ext", "mode")


@query
def tag_counts(spark, d):
    return metrics.tag_counts(corpus(spark, d, "src_part"))


@query
def corpus_totals(spark, d):
    return metrics.corpus_totals(corpus(spark, d, "src_part"))


@query
def run_summary(spark, d):
    return metrics.run_summary(corpus(spark, d, "run_log_events"))


# -- annotation run ---------------------------------------------------------------------
@query
def annotate_offline(spark, d):
    files = corpus(spark, d, "src_part").select("path", "ext", "content")
    return annotate.annotate_files(ignore.drop_empty(files), annotate.offline_annotator)


def _part_number(prompt: str) -> int:
    """k of the file part_<k> that a prompt is about."""
    return int(prompt.split("/part_", 1)[-1].split("part_", 1)[-1].split(".", 1)[0])


@query
def annotate_resumed(spark, d):
    """Two runs over one ledger: the service fails for every third file in the first, and in the second for all
    that it has answered before."""
    files = ignore.drop_empty(corpus(spark, d, "src_part").select("path", "ext", "content"))
    ledger, retry = shared_folder(spark, "ledger"), annotate.Retry(2, 1)

    def failing(wrong):
        def annotator(texts):
            if any(wrong(_part_number(p)) for p in texts):
                raise annotate.Refused(503, "unavailable")
            return annotate.offline_annotator(texts)

        return annotator

    first = annotate.annotate_files(files, failing(lambda k: k % 3 == 0), retry=retry, ledger=ledger)
    if first.where("err = 'request_failed'").isEmpty():
        raise RuntimeError("no request failed")
    return annotate.annotate_files(files, failing(lambda k: k % 3 != 0), retry=retry, ledger=ledger)


@query
def request_log(spark, d):
    """What becomes of requests to a service that is unavailable, overloaded or refuses, by the number of the file."""
    files = ignore.drop_empty(corpus(spark, d, "src_part").select("path", "ext", "content"))

    def make():
        seen: dict[str, int] = {}  # in each worker: how often a prompt has been asked here

        def annotator(texts):
            (text,) = texts if len(texts) == 1 else (None,)
            if text is None:
                raise annotate.Refused(400, "one at a time")
            n = seen[text] = seen.get(text, 0) + 1
            k = _part_number(text)
            if k % 5 == 0:
                raise annotate.Refused(400, "bad request")
            if n <= k % 4:  # as often as that it cannot answer
                raise annotate.Refused(429 if k % 2 else 503, "later")
            return annotate.offline_annotator(texts)

        return annotator

    asked = annotate.ask(prompts.build_prompts(files), make(), retry=annotate.Retry(first_delay_ms=1))
    return responses.request_outcomes(annotate.attempt_log(asked)).withColumnRenamed("request_id", "path")


@query
def scanned_tree(spark, d):
    """A tree of source files, written and scanned."""
    root = shared_folder(spark, "tree")
    uri = qualified(spark, root)
    files = corpus(spark, d, "src_part").select(F.concat(F.lit(f"{uri}/"), "path").alias("path"), "content")
    written = metrics.run_summary(write_tree(files)).first()
    if written["n_error"]:
        raise RuntimeError(f"{written['n_error']} files were not written")
    found = scan_source_tree(spark, root)
    return found.select(F.substr("path", F.lit(len(uri) + 2), F.length("path")).alias("path"), "ext", "content")


@query
def written_version(spark, d):
    """The sink: a version with every file, then one in which every third file is annotated."""
    files = corpus(spark, d, "src_part").select("path", "ext", "content", "k")
    first, second = shared_folder(spark, "version-1"), shared_folder(spark, "version-2")
    write_files(files, first)
    changed = files.where("k % 3 = 0").select("path", "ext", "content")
    annotated = annotate.annotate_files(ignore.drop_empty(changed), annotate.offline_annotator)
    write_files(annotate.accepted(annotated), second, previous=first)
    return spark.read.parquet(second).select("path", "content")


@query
def current_version(spark, d):
    """The same by versions of one table; a reader of the first keeps it."""
    table = shared_folder(spark, "table")
    files = corpus(spark, d, "src_part").select("path", "ext", "content", "k")
    write_version(files, table)
    changed = read_version(spark, table).join(files.where("k % 3 = 0").select("path"), "path", "left_semi")
    annotated = annotate.annotate_files(ignore.drop_empty(changed), annotate.offline_annotator)
    write_version(annotate.accepted(annotated), table)
    return read_version(spark, table).select("path", "content")


@query
def tree_log(spark, d):
    """What becomes of files that are written to a tree: good ones, and those without text, in no known store, or
    in the place of a folder."""
    root = qualified(spark, shared_folder(spark, "tree"))
    k = F.col("k")
    path = F.when(k % 7 == 1, F.concat(F.lit("nowhere://x/"), "path")).when(k % 7 == 2, F.lit("src")).otherwise(
        F.concat(F.lit(root + "/"), "path")
    )
    content = F.when(k % 7 != 3, F.col("content"))
    files = corpus(spark, d, "src_part").select("path", path.alias("at"), content.alias("content"))
    log = write_tree(files.select(F.col("at").alias("path"), "content"))
    return log.groupBy(F.regexp_replace("path", r"\A.*/", "").alias("name"), "status").agg(F.count("*").alias("n"))


# -- streams ----------------------------------------------------------------------------
def _revision_files(spark, d):
    """The revisions as a folder of files in commit order, for a stream to pick up."""
    folder = shared_folder(spark, "revisions")
    revisions_sorted = corpus(spark, d, "rev_part").repartitionByRange("commit_ts")
    revisions_sorted.write.parquet(folder)
    return folder


def _arriving(spark, d):
    """The same as a stream, two files per micro-batch, which are lexed by as many tasks as run at once."""
    tasks = spark.sparkContext.defaultParallelism
    return revisions.revision_stream(spark, _revision_files(spark, d), max_files=2, tasks=tasks)


def _drained(spark, name, stream, mode="append"):
    out = shared_folder(spark, name)
    revisions.drain(stream, out, shared_folder(spark, name + "-checkpoint"), mode)
    return spark.read.parquet(out)


def _told(spark, name, *waves, **how):
    """Kinds of revisions that arrive in waves, each a table and one micro-batch, however many files it has."""
    folder, out, work = (shared_folder(spark, f"{name}-{n}") for n in ("in", "out", "work"))
    for wave in waves:
        wave.write.mode("append").parquet(folder)
        revisions.drain_change_kinds(revisions.revision_stream(spark, folder, max_files=None), out, work, **how)
    return revisions.read_change_kinds(spark, out)


@query
def stream_change_kind(spark, d):
    """The history in two waves, cut in the middle of the revisions of some paths."""
    arriving = corpus(spark, d, "rev_part")
    return _told(spark, "kinds", arriving.where("commit_id <= 76"), arriving.where("commit_id > 76"))


@query
def stream_late(spark, d):
    """Each path's first revision arrives when the others have been seen."""
    late = F.col("commit_id") % 3 == 1
    arriving = corpus(spark, d, "rev_part")
    return _told(spark, "late", arriving.where(~late), arriving.where(late))


def _idle(spark, d):
    """Three waves: two revisions of each path; a third, for every other path 60 days later; then first
    revisions of that time again, for paths that went on and for others."""
    rows = corpus(spark, d, "rev_part")
    n, k = F.col("commit_id") % 3, F.length("path") % 2
    later = F.when((n == 0) & (k == 0), F.col("commit_ts") + F.expr("interval 60 days")).otherwise(F.col("commit_ts"))
    again = rows.where(n == 1).withColumn("commit_id", F.col("commit_id") + 1000)
    return rows.where(n != 0), rows.where(n == 0).withColumn("commit_ts", later), again


@query
def stream_idle(spark, d):
    """A path that nobody has touched for 30 days is new when it comes back."""
    return _told(spark, "idle", *_idle(spark, d), ttl="30 days", delay="10 days")


@query
def stream_late_counts(spark, d):
    return revisions.late_counts(_told(spark, "counts", *_idle(spark, d), ttl="30 days", delay="10 days"))


@query
def stream_density(spark, d):
    source = _arriving(spark, d)
    out = shared_folder(spark, "density")
    checkpoint = shared_folder(spark, "density-checkpoint")
    revisions.drain_merged(revisions.density_stream(source), out, checkpoint, "day", "ext")
    return revisions.merged(spark, out)


def _stripped_stream(spark, d, mode):
    out = _drained(spark, mode, revisions.strip_stream(_arriving(spark, d), mode))
    return out.select(
        F.concat("path", F.lit("@"), F.col("commit_id").cast("string")).alias("path"), "content"
    )


@query
def stream_strict_prune(spark, d):
    return _stripped_stream(spark, d, "strict")


@query
def stream_prune(spark, d):
    return _stripped_stream(spark, d, "prune")
