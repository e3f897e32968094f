"""The whole annotation run as one plan: strip, prompt, ask, validate, insert, check.

The file stays in its row from the scan to the new text, so the run shuffles nothing. With a ledger of
answers a run that was broken off, or met a service that was, goes on where it was left.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TAG
from ..operators import responses
from ..operators.prompts import build_prompts
from ..operators.splice import as_blocks, checked_splice, prepared
from ..sources.shared import exists, shared_folder

# Given the prompts of a batch, returns one response body per prompt (None: no answer).
Annotator = Callable[[list[str]], list[str | None]]


class Refused(Exception):
    """What an annotator raises if a request fails: with the status of the answer, or None if there was none."""

    def __init__(self, status: int | None = None, message: str = ""):
        super().__init__(message)
        self.status = status


class Retry(NamedTuple):
    """How often a request is made, and the delay before the second time, which doubles each time after."""

    attempts: int = responses.MAX_ATTEMPTS
    first_delay_ms: int = responses.FIRST_DELAY_MS


_ATTEMPTS = "array<struct<attempt:int,status:int,error:string>>"
_ASKED = f"body string, error string, attempts {_ATTEMPTS}"


def _tried_again(status: int | None) -> bool:
    return status is None or status == 429 or 500 <= status <= 599


def _one_round(prompts: list[str], annotator: Annotator) -> list[tuple[str | None, int | None, str | None]]:
    """(body, status, error) of each prompt. Where the call for all of them fails each is asked about
    by itself, so that one bad prompt spoils no other."""
    try:
        bodies = annotator(prompts)
        if len(bodies) != len(prompts):
            raise Refused(None, f"{len(bodies)} answers to {len(prompts)} prompts")
        return [(b, None, "no answer") if b is None else (b, 200, None) for b in bodies]
    except Exception as error:  # whatever it is, it is the failure of a request and not of the run
        if len(prompts) > 1:
            return [_one_round([p], annotator)[0] for p in prompts]
        return [(None, getattr(error, "status", None), str(error) or type(error).__name__)]


def answers(prompts: list[str], annotator: Annotator, retry: Retry) -> list[dict]:
    """body, error and attempts of each prompt. What can be tried again is, after a delay; the rest fails at once."""
    out = [{"body": None, "error": None, "attempts": []} for _ in prompts]
    waiting = list(range(len(prompts)))
    for attempt in range(retry.attempts):
        if not waiting:
            break
        if attempt:
            time.sleep(retry.first_delay_ms * 2 ** (attempt - 1) / 1000)
        found = _one_round([prompts[i] for i in waiting], annotator)
        again = []
        for i, (body, status, error) in zip(waiting, found):
            out[i]["attempts"].append({"attempt": attempt, "status": status, "error": error})
            out[i].update(body=body, error=error)
            if body is None and _tried_again(status):
                again.append(i)
        waiting = again
    return out


def ask(prompts: DataFrame, annotator: Annotator, provider: str = "openai", retry: Retry = Retry()) -> DataFrame:
    """responses(path, provider, body, error, attempts) from a caller-supplied annotator.

    The annotator runs in Python workers over Arrow batches, and only prompts go there; it is
    the only place where a service would be called. A request that fails for good is a row with a null body and
    the last ``error``; ``attempts`` tells of each time it was made. Columns of ``prompts`` other
    than the prompt are kept, so that the file can travel with its question.
    """
    kind = pa.struct(
        [
            ("body", pa.string()),
            ("error", pa.string()),
            ("attempts", pa.list_(pa.struct([("attempt", pa.int32()), ("status", pa.int32()), ("error", pa.string())]))),
        ]
    )

    @F.arrow_udf(_ASKED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(answers([p or "" for p in batch.to_pylist()], annotator, retry), kind)

    # A service may answer otherwise the next time: the optimizer must neither move nor repeat the call.
    asked = prompts.withColumn("__asked", run.asNondeterministic()("prompt"))
    kept = [c for c in prompts.columns if c != "prompt"]
    return asked.select(*kept, F.lit(provider).alias("provider"), "__asked.body", "__asked.error", "__asked.attempts")


def attempt_log(asked: DataFrame, request_id: str = "path") -> DataFrame:
    """attempts(request_id, attempt, status, error) of ``ask``, for ``responses.request_outcomes``."""
    return asked.select(F.col(request_id).alias("request_id"), F.explode("attempts").alias("a")).select("request_id", "a.*")


# -- the ledger ---------------------------------------------------------------------------
LEDGER_SCHEMA = f"digest string, provider string, {_ASKED}"
#: Prompts that are asked before their answers are put down; a run that is broken off loses no more.
WAVE = 1_000_000


def prompt_digest(provider: str):
    """Names a request: who is asked, and what."""
    return F.sha2(F.concat(F.lit(provider + "\n"), F.col("prompt")), 256)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """ledger(digest, provider, body, error, attempts): all that was asked so far, failures too."""
    if not exists(spark, ledger):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(ledger)


def ledger_answers(spark: SparkSession, ledger: str) -> DataFrame:
    """(digest, body): one answer to each request that has one."""
    return read_ledger(spark, ledger).where("body IS NOT NULL").groupBy("digest").agg(F.min("body").alias("body"))


def ask_once(
    prompts: DataFrame,
    annotator: Annotator,
    ledger: str,
    provider: str = "openai",
    retry: Retry = Retry(),
    wave: int = WAVE,
) -> DataFrame:
    """``ask`` that puts down what it learns in the folder ``ledger``, and asks only what has no answer there.

    Equal prompts are asked about once. Answers are put down in waves of about ``wave`` prompts, each in
    one commit, so a run that fails has lost one wave at most; requests that failed are asked again by the next run. The result
    is ``prompts`` without the prompt, with provider, body, and the error of requests without an answer.
    """
    spark = prompts.sparkSession
    keyed = prompts.withColumn("__digest", prompt_digest(provider))
    known = ledger_answers(spark, ledger).select(F.col("digest").alias("__digest"))
    todo = shared_folder(spark, "prompts")
    keyed.select("__digest", "prompt").dropDuplicates(["__digest"]).join(known, "__digest", "left_anti").write.parquet(todo)
    pending = spark.read.schema("__digest string, prompt string").parquet(todo)
    waves = -(-pending.count() // wave)
    for number in range(waves):
        part = pending.where(F.pmod(F.xxhash64("__digest"), F.lit(waves)) == number)
        asked = ask(part, annotator, provider, retry).withColumnRenamed("__digest", "digest")
        asked.select("digest", "provider", "body", "error", "attempts").write.mode("append").parquet(ledger)
    # written out, so that a prompt which very many files share can be split when its answer meets them
    told, folder = read_ledger(spark, ledger), shared_folder(spark, "answers")
    told.groupBy(F.col("digest").alias("__digest")).agg(
        F.min("body").alias("body"), F.max(F.when(F.col("body").isNull(), F.col("error"))).alias("__error")
    ).write.parquet(folder)
    told = spark.read.schema("__digest string, body string, __error string").parquet(folder)
    error = F.when(F.col("body").isNull(), F.col("__error"))
    kept = [c for c in prompts.columns if c != "prompt"]
    return keyed.drop("prompt").join(told, "__digest", "left").select(
        *kept, F.lit(provider).alias("provider"), "body", error.alias("error")
    )


def offline_annotator(prompts: list[str]) -> list[str]:
    """A deterministic stand-in for a service: one comment above the first code line."""
    import json

    bodies = []
    for prompt in prompts:
        token = prompt.split("Begin comments with ", 1)[1].split(" ", 1)[0]
        n_lines = prompt.rsplit("\n", 1)[-1].split(":", 1)[0]
        closing = " -->" if token == "<!--" else ""
        items = [{"line": 1, "comment": f"{token} {n_lines} lines{closing}"}]
        bodies.append(json.dumps({"choices": [{"message": {"content": json.dumps(items)}}]}))
    return bodies


def annotate_files(
    files: DataFrame,
    annotator: Annotator,
    mode: str = "default",
    overwrite: bool = False,
    keep: bool = False,
    provider: str = "openai",
    tag: str = TAG,
    retry: Retry = Retry(),
    ledger: str | None = None,
) -> DataFrame:
    """(path, ext, content, err): the new text, or the stripped one and what was wrong.

    ``err`` is a fault of the response, ``request_failed`` if there is none after all attempts, or ``changed_lines`` if
    a line of the file would not come out as it was. Only rows without ``err`` are to be written (``accepted``).
    With a folder ``ledger``, requests that were answered in an earlier run are not made again (see ``ask_once``); the
    files then meet their answers in one join.

    Filter ``files`` first (see ``changes.to_annotate``): nothing is pushed below the
    call of the annotator.
    """
    stripped = prepared(files.select("path", "ext", "content"), overwrite, keep, tag)
    asked = build_prompts(stripped, mode, keep_columns=["ext", "content"])
    asked = asked.select("path", "ext", "content", "prompt")
    if ledger is None:
        answered = ask(asked, annotator, provider, retry)
    else:
        answered = ask_once(asked, annotator, ledger, provider, retry)
    answered = answered.withColumn("failed", F.col("body").isNull())
    checked = responses.checked_items(answered, keep_columns=["ext", "content", "failed"])
    blocks = as_blocks(F.when(F.col("err").isNull(), F.col("items")), tag)
    err = F.when(F.col("failed"), F.lit("request_failed")).otherwise(F.col("err"))
    ready = checked.select("path", "ext", "content", err.alias("err"), blocks.alias("blocks"))

    err = F.coalesce("err", F.when(~F.col("intact"), F.lit("changed_lines")))
    return checked_splice(ready).select("path", "ext", "content", err.alias("err"))


def accepted(annotated: DataFrame) -> DataFrame:
    """(path, ext, content) of the files of an annotation run that may be written."""
    good = F.filter(F.array(F.struct("content", "err")), lambda r: r["err"].isNull())
    return annotated.select("path", "ext", F.explode(good).alias("r")).select("path", "ext", "r.content")


def run_log(annotated: DataFrame) -> DataFrame:
    """run_log(path, status, error) of an annotation run."""
    failed = F.col("err").isNotNull()
    return annotated.select(
        "path", F.when(failed, "error").otherwise("ok").alias("status"), F.col("err").alias("error")
    )
