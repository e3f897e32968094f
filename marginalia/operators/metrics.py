"""Comment density, tag inventory and run totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TAG, is_blank
from .lexed import MARKED, with_marked
from .lines import comments, has_comment_start, is_pure_comment, line_array, starts_in_block

# Published comment-to-code ratios by mode.
TARGET_BANDS = {"light": (0.10, 0.20), "default": (0.20, 0.35), "full": (0.60, 1.10)}


def line_counts(files: DataFrame) -> DataFrame:
    """files with n_lines, n_comment, n_code; counted inside the row, without a shuffle.

    A comment line is a visible line that is pure comment; a code line is a visible line
    that is not. Blank lines are neither.
    """

    def kind(p: Column) -> Column:
        text, m = p["text"], p["m"]
        no_marks = ~has_comment_start(m) & ~starts_in_block(m)
        blank = is_blank(text)
        return F.when(text.isNull() | blank, 0).when(no_marks, 2).when(is_pure_comment(text, m), 1).otherwise(2)

    # The entry behind the last line has no text, so no kind.
    kinds = F.transform(line_array(F.col("content"), F.col(MARKED)), kind)
    counted = with_marked(files).withColumn("__kinds", kinds)
    return (
        counted.withColumn("n_lines", (F.size("__kinds") - 1).cast("bigint"))
        .withColumn("n_comment", F.size(F.filter("__kinds", lambda k: k == 1)).cast("bigint"))
        .withColumn("n_code", F.size(F.filter("__kinds", lambda k: k == 2)).cast("bigint"))
        .drop("__kinds", MARKED)
    )


def ratio(n: Column, base: Column) -> Column:
    return F.round(n / F.nullif(base, F.lit(0)), 6)


def density(files: DataFrame) -> DataFrame:
    """(path, ext, n_lines, n_comment, n_code, per_code, per_line) per file."""
    return line_counts(files).select(
        "path",
        "ext",
        "n_lines",
        "n_comment",
        "n_code",
        ratio(F.col("n_comment"), F.col("n_code")).alias("per_code"),
        ratio(F.col("n_comment"), F.col("n_lines")).alias("per_line"),
    )


def density_by(files: DataFrame, *keys: str, totals: bool = True) -> DataFrame:
    """Density by any columns of ``files`` (say ext and mode), with rollup totals.

    (keys..., n_files, n_comment, n_code, per_code, level): ``level`` counts the keys
    that are rolled up; ``per_code`` is the ratio of the sums.
    """
    counted = line_counts(files).select(*keys, "n_comment", "n_code")
    grouped = counted.rollup(*keys) if totals else counted.groupBy(*keys)
    level = sum((F.grouping(k).cast("bigint") for k in keys), F.lit(0).cast("bigint")) if totals else F.lit(0).cast("bigint")
    return grouped.agg(
        F.count("*").alias("n_files"),
        F.sum("n_comment").alias("n_comment"),
        F.sum("n_code").alias("n_code"),
        ratio(F.sum("n_comment"), F.sum("n_code")).alias("per_code"),
        level.alias("level"),
    )


def in_target_band(ratio: Column, mode: Column) -> Column:
    """Whether a comment-to-code ratio lies in the band published for the mode."""
    out = None
    for name, (low, high) in TARGET_BANDS.items():
        test = ratio.between(low, high)
        out = F.when(mode == name, test) if out is None else out.when(mode == name, test)
    return out


def tag_counts(files: DataFrame, tag: str = TAG) -> DataFrame:
    """(ext, n_tagged, n_human): comments by language; ext NULL is the total."""
    return (
        comments(files, tag)
        .rollup("ext")
        .agg(F.count_if("tagged").alias("n_tagged"), F.count_if(~F.col("tagged")).alias("n_human"))
    )


def corpus_totals(files: DataFrame) -> DataFrame:
    """(n_files, n_lines, n_languages)."""
    lf = F.col("content")
    n_lines = F.length(lf) - F.length(F.replace(lf, F.lit("\n"), F.lit(""))) + 1
    return files.agg(
        F.count("*").alias("n_files"),
        F.sum(n_lines.cast("bigint")).alias("n_lines"),
        F.count_distinct("ext").alias("n_languages"),
    )


def run_summary(run_log: DataFrame) -> DataFrame:
    """(n_ok, n_error, n_skipped, failed): failed when nothing worked and something broke."""
    counts = run_log.agg(
        F.count_if(F.col("status") == "ok").alias("n_ok"),
        F.count_if(F.col("status") == "error").alias("n_error"),
        F.count_if(F.col("status") == "skipped_empty").alias("n_skipped"),
    )
    return counts.withColumn("failed", (F.col("n_error") > 0) & (F.col("n_ok") == 0))
