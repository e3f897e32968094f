"""From stored model responses to validated suggestions.

responses(path, provider, body). Items are parsed as VARIANT, which keeps the type of
every element; a typed from_json would lose a whole array to one bad element.
Everything up to the accepted items is row-local.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.text import trim

# Where each provider's envelope keeps the text; others use "chat".
TEXT_PATHS = {
    "gemini": "$.candidates[0].content.parts[0].text",
    "claude": "$.content[0].text",
}
CHAT_PATH = "$.choices[0].message.content"

# What a comment may begin with.
COMMENT_OPENINGS = ("//", "/*", "#", "<!--", "--")

# Error classes, in the order they are tested.
ERRORS = (
    "bad_envelope",
    "api_error",
    "no_text",
    "not_json",
    "not_array",
    "not_object",
    "bad_line",
    "bad_action",
    "bad_comment",
    "bad_marker",
)


def response_text(responses: DataFrame, keep_columns: list[str] | None = None) -> DataFrame:
    """(path, provider, text, err, message): the model's text, or why there is none."""
    provider = F.col("provider")

    def unpack(v: Column) -> Column:
        text = F.try_variant_get(v, CHAT_PATH, "string")
        for name, where in TEXT_PATHS.items():
            text = F.when(provider == name, F.try_variant_get(v, where, "string")).otherwise(text)
        failed = F.try_variant_get(v, "$.error", "variant")
        has_error = _truthy(failed)
        return F.struct(
            F.when(~has_error, text).alias("text"),
            F.when(v.isNull(), "bad_envelope")
            .when(has_error, "api_error")
            .when(text.isNull(), "no_text")
            .alias("err"),
            F.when(has_error, F.try_variant_get(v, "$.error.message", "string")).alias("message"),
        )

    keep_last_of_duplicate_keys(responses.sparkSession)
    return responses.withColumn("__r", let(parse_json(F.col("body")), unpack)).select(
        "path", *(keep_columns or []), "provider", "__r.text", "__r.err", "__r.message"
    )


def keep_last_of_duplicate_keys(spark: SparkSession) -> None:
    """Lets an object repeat a key, in which case its last value counts, for plans of this session."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def _truthy(v: Column) -> Column:
    """Whether a JSON value is neither missing nor null, false, zero or an empty string."""
    kind = _kind(v)
    number = F.try_variant_get(v, "$", "double")
    return (
        F.when(v.isNull() | (kind == "VOID"), F.lit(False))
        .when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(kind == "STRING", F.try_variant_get(v, "$", "string") != "")
        .when(kind.isin("OBJECT", "ARRAY"), F.lit(True))
        .otherwise(F.coalesce(number != 0, F.lit(True)))
    )


def parse_json(text: Column) -> Column:
    """VARIANT of a text that is exactly one JSON value, else NULL.

    try_parse_json takes the first value and ignores what follows. Wrapped in an array
    and in an object, the text parses both ways, to one element, only if nothing does.
    """

    def strict(t: Column) -> Column:
        in_object = F.try_parse_json(F.concat(F.lit('{"v":'), t, F.lit("}")))
        in_array = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))
        return let(
            F.when(in_object.isNotNull(), in_array.cast("array<variant>")),
            lambda elements: F.when(F.size(elements) == 1, F.get(elements, F.lit(0))),
        )

    return let(text, strict)


def json_slice(text: Column) -> Column:
    """From the first ``[`` to the last ``]``, or the whole trimmed text."""
    found = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    return F.when(found != "", found).otherwise(trim(text))


def _kind(variant: Column) -> Column:
    """Type of a variant without its details: OBJECT, ARRAY, STRING, BIGINT, ..."""
    return F.regexp_extract(F.coalesce(F.schema_of_variant(variant), F.lit("")), r"\A[A-Z]*", 0)


def _checked(item: Column, action: str | None) -> Column:
    line = F.try_variant_get(item, "$.line", "variant")
    number = F.try_variant_get(item, "$.line", "double")
    whole = _kind(line).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT") & (number > 0) & (number == F.rint(number))
    comment = F.try_variant_get(item, "$.comment", "variant")
    text = F.try_variant_get(item, "$.comment", "string")
    is_text = F.coalesce(_kind(comment) == "STRING", F.lit(False))
    marked = F.lit(False)
    for opening in COMMENT_OPENINGS:
        marked = marked | F.startswith(trim(text), F.lit(opening))
    err = F.when(~_kind(item).isin("OBJECT", "ARRAY"), "not_object").when(
        ~F.coalesce(whole, F.lit(False)), "bad_line"
    )
    if action is None:
        err = err.when(~is_text, "bad_comment").when(~marked, "bad_marker")
    else:
        act = F.try_variant_get(item, "$.action", "variant")
        same = (_kind(act) == "STRING") & (F.try_variant_get(item, "$.action", "string") == action)
        err = err.when(~F.coalesce(same, F.lit(False)), "bad_action")
    # A number past every BIGINT is a good line number, though no file has that line.
    known = F.when(F.coalesce(whole, F.lit(False)), number)
    return F.struct(
        known.try_cast("bigint").alias("line"),
        (known.isNotNull() & known.try_cast("bigint").isNull()).alias("past_any_file"),
        F.when(is_text, text).alias("comment"),
        err.alias("err"),
    )


def checked_items(
    responses: DataFrame, mode: str = "default", keep_columns: list[str] | None = None
) -> DataFrame:
    """(path, err, items): all items of a response with their errors, still in one row.

    ``err`` is the first thing wrong with the response: a fault of the envelope or the
    JSON, or of its first bad item; NULL means the whole response is accepted.
    """
    action = "delete" if mode == "clean" else None
    fault = F.col("err")

    def judge(v: Column) -> Column:
        elements = F.when(_kind(v) == "ARRAY", v.cast("array<variant>"))
        items = F.transform(elements, lambda item: _checked(item, action))
        return let(F.struct(v.isNull().alias("no_json"), items.alias("items")), verdict)

    def verdict(s: Column) -> Column:
        first_bad = F.get(F.filter(s["items"], lambda i: i["err"].isNotNull()), F.lit(0))["err"]
        err = (
            F.when(fault.isNotNull(), fault)
            .when(s["no_json"], "not_json")
            .when(s["items"].isNull(), "not_array")
            .otherwise(first_bad)
        )
        return F.struct(err.alias("err"), s["items"].alias("items"))

    # Bound step by step, so that no text is parsed more than once, whatever is selected.
    value = F.when(fault.isNull(), parse_json(json_slice(F.col("text"))))
    texts = response_text(responses, keep_columns)
    return texts.select("path", *(keep_columns or []), let(value, judge).alias("v")).select(
        "path", *(keep_columns or []), "v.err", "v.items"
    )


def response_items(responses: DataFrame, mode: str = "default") -> DataFrame:
    """items(path, idx, line, past_any_file, comment, err): one row per array element."""
    return (
        checked_items(responses, mode)
        .select("path", F.posexplode("items").alias("idx", "i"))
        .select("path", "idx", "i.line", "i.past_any_file", "i.comment", "i.err")
    )


def accepted_items(responses: DataFrame, mode: str = "default") -> DataFrame:
    """suggestions(path, idx, line, comment) of responses in which every item is good; ``line`` is NULL
    where the number is past any file."""
    # The test sits inside the explode: a filter would be pushed down and check twice.
    good = F.when(F.col("err").isNull(), F.col("items"))
    return (
        checked_items(responses, mode)
        .select("path", F.posexplode(good).alias("idx", "i"))
        .select("path", F.col("idx").cast("bigint").alias("idx"), "i.line", "i.comment")
    )


def response_errors(responses: DataFrame, mode: str = "default") -> DataFrame:
    """(err, responses): how many responses were rejected, by first error."""
    rejected = F.filter(F.array("err"), lambda e: e.isNotNull())
    return (
        checked_items(responses, mode)
        .select(F.explode(rejected).alias("err"))
        .groupBy("err")
        .agg(F.count("*").alias("responses"))
    )


# -- request log --------------------------------------------------------------------
MAX_ATTEMPTS = 3  # fixed values: attempts per request and the delay before the second
FIRST_DELAY_MS = 1000


def request_outcomes(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """(request_id, attempts_used, outcome, status, error, waited_ms, n_extra).

    attempts(request_id, attempt, status, error), attempt from 0. 2xx is done; 429, 5xx
    and attempts without a status (network, timeout) are tried again while attempts are
    left; any other status is returned as it is. A plain aggregate: partial sums are
    built before the shuffle, so a busy request id is no hot spot. ``n_extra`` counts the
    attempts that do not take part: beyond the limit, or without a number.
    """
    used = F.coalesce(F.col("attempt").between(0, max_attempts - 1), F.lit(False))
    ok = F.col("status").between(200, 299)
    retry = F.col("status").isNull() | (F.col("status") == 429) | F.col("status").between(500, 599)
    seen = F.struct("attempt", "status", "error", ok.alias("ok"), retry.alias("retry"))
    per_request = attempts.groupBy("request_id").agg(
        F.min(F.when(used & ~F.coalesce(retry, F.lit(True)), seen)).alias("final"),
        F.max(F.when(used, seen)).alias("last"),
        F.count_if(~used).alias("n_extra"),
    )
    final, last = F.col("final"), F.col("last")
    end = F.coalesce(final, last)
    # one wait before every attempt that followed another
    waits = end["attempt"]
    return per_request.select(
        "request_id",
        F.coalesce(end["attempt"] + 1, F.lit(0)).cast("bigint").alias("attempts_used"),
        F.when(final["ok"], "done")
        .when(final.isNotNull(), "returned")
        .when(last["attempt"] == max_attempts - 1, "failed")
        .otherwise("pending")
        .alias("outcome"),
        end["status"].alias("status"),
        end["error"].alias("error"),
        (F.lit(FIRST_DELAY_MS) * (F.pow(F.lit(2.0), F.coalesce(waits, F.lit(0))) - 1)).cast("bigint").alias("waited_ms"),
        "n_extra",
    )
