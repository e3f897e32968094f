"""Checks that rewriting a file touched nothing but comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexing
from ..functions.text import TAG, is_blank
from .lexed import MARKED, settled, with_gaps, with_marked
from .lines import is_pure_comment, line_array, starts_in_string
from .reduction import key_bitmaps, made, possibly_in, with_possibly_in
from .splice import rebuilt, splice, splice_merged
from .strip import clean, stripped_array
from .windows import lag_in_buckets


def _source_lines(before: DataFrame, mode: str, tag: str) -> DataFrame:
    """(path, orig_line, source, cut): lines of the originals, and what stripping makes of each."""
    text = F.col("content")
    if mode == "splice":
        source = F.transform(F.split(text, r"\r?\n"), lambda t: F.struct(t.alias("source"), t.alias("cut")))
        lines = before.select("path", F.posexplode(source).alias("pos", "s"))
    else:
        lexed = with_marked(before)
        cut = stripped_array(text, F.col(MARKED), None if mode == "prune" else tag)
        source = F.zip_with(
            F.split(text, r"\r?\n"), cut, lambda t, c: F.struct(t.alias("source"), c.alias("cut"))
        )
        lines = lexed.select("path", F.posexplode(source).alias("pos", "s"))
    return lines.select("path", (F.col("pos") + 1).alias("orig_line"), "s.source", "s.cut")


def _unlike(survivors: DataFrame, lines: DataFrame, text: str, source: str, cut: str) -> DataFrame:
    """Survivors, beside their original lines, that equal neither these nor what stripping makes of them.

    The join is stated: the engine judges the lines by the bytes of the table that the files come from, takes them for few
    and would gather the lines of all files in the driver, to broadcast them.
    """
    unchanged = (F.col(text) == F.col(source)) | (F.col(text) == F.coalesce(cut, source))
    beside = survivors.join(lines.hint("merge"), ["path", "orig_line"], "left")
    return beside.where(~F.coalesce(unchanged, F.lit(False)))


def verify_lines(before: DataFrame, out_lines: DataFrame, mode: str = "splice", tag: str = TAG) -> DataFrame:
    """violations(path, out_line, orig_line, text, source): surviving lines that changed.

    With mode prune or clean a line may also equal its source with the comment cut. Keyed
    by (path, line), so no single file makes a large group. 64-bit digests of lines are compared
    first. Then the texts of lines that are not alike are compared, and no others are shuffled; of files that have
    none, which is what a run should give, nothing is read a second time. The digests are compared when this is called, the
    texts when the result is read.
    """

    def digest(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.xxhash64(name)).alias(name)

    survivors = out_lines.where(F.col("orig_line").isNotNull()).select("path", "out_line", "orig_line", "text")
    unlike = _unlike(
        survivors.select("path", "orig_line", digest("text")),
        _source_lines(before, mode, tag).select("path", "orig_line", digest("source"), digest("cut")),
        "text", "source", "cut",
    ).withColumn("orig_line", F.col("orig_line").cast("bigint"))
    # one table of bitmaps for files and lines, made before it is met four times: the plan would have ten lexers otherwise
    line = ["path", "orig_line"]
    bitmaps = made(key_bitmaps(unlike, ["path"], line))

    def named(rows: DataFrame) -> DataFrame:
        return possibly_in(rows, bitmaps, ["path"])

    def reduced(lines: DataFrame) -> DataFrame:
        return possibly_in(lines.withColumn("orig_line", F.col("orig_line").cast("bigint")), bitmaps, line)

    # both sides are reduced by the same keys: a survivor that came through by chance must meet its source
    found = _unlike(reduced(named(survivors)), reduced(_source_lines(named(before), mode, tag)), "text", "source", "cut")
    orig_line = F.col("orig_line").cast(out_lines.schema["orig_line"].dataType).alias("orig_line")
    return found.select("path", "out_line", orig_line, "text", "source")


def verify_order(out_lines: DataFrame, chunk: int = 4096) -> DataFrame:
    """violations(path, out_line, orig_line, previous): original order not kept.

    Compared in chunks of the output, so that one very long output is many groups.
    """
    kept = out_lines.where(F.col("orig_line").isNotNull()).select("path", "out_line", "orig_line")
    slot = F.floor(F.col("out_line") / chunk)
    compared = lag_in_buckets(kept, "path", ["out_line"], slot, ["orig_line"])
    return compared.where(F.col("orig_line") <= F.col("prev_orig_line")).select(
        "path", "out_line", "orig_line", F.col("prev_orig_line").alias("previous")
    )


def flag_violations(files: DataFrame, violations: DataFrame, flag: str = "bad") -> DataFrame:
    """Files with a column that says whether any violation names them.

    Files that none names stay where they are; only the others are joined.
    """
    bad = violations.select("path").distinct()
    told = with_possibly_in(files, key_bitmaps(bad, ["path"]), ["path"], flag)
    named = told.where(flag).join(bad.withColumn("__named", F.lit(True)), "path", "left")
    named = named.withColumn(flag, F.coalesce("__named", F.lit(False)))
    return told.where(~F.col(flag)).unionByName(named.select(*told.columns))


def quarantine(files: DataFrame, violations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files that may be written, files with a violation). To have both, store ``flag_violations``."""
    flagged = flag_violations(files, violations, "__bad")
    return flagged.where(~F.col("__bad")).drop("__bad"), flagged.where("__bad").drop("__bad")


def verify_roundtrip(before: DataFrame, after: DataFrame, tag: str = TAG) -> DataFrame:
    """(path): files whose cleaned text differs before and after. Only hashes are joined."""

    def digest(files: DataFrame, name: str) -> DataFrame:
        return clean(files, tag).select("path", F.sha2("content", 256).alias(name))

    return (
        digest(before, "was")
        .join(digest(after, "is"), "path", "full")
        .where(~F.col("was").eqNullSafe(F.col("is")))
        .select("path")
    )


def splice_roundtrip(files: DataFrame, suggestions: DataFrame, tag: str = TAG) -> DataFrame:
    """(path): files that splicing changes for ``clean``: what cleaning leaves of them is not what it
    leaves of the spliced text. The original travels in the row, so nothing is joined."""
    kept = files.select("path", "ext", "content", F.col("content").alias("__before"))
    after = clean(splice(kept, suggestions, tag), tag, output="__is")
    both = clean(after, tag, content="__before", output="__was")
    differs = F.filter(F.array(F.struct("__was", "__is")), lambda t: ~t["__was"].eqNullSafe(t["__is"]))
    return both.select("path", F.explode(differs)).select("path")


def lost_code(files: DataFrame, tag: str | None = None) -> DataFrame:
    """(path, line_no, text): lines that compat stripping deletes though they hold code
    or string content."""
    lexed = with_gaps(with_marked(files))
    text = F.col("content")
    lines = F.arrays_zip(
        line_array(text, F.col(MARKED)).alias("line"),
        stripped_array(text, F.col(MARKED), tag).alias("kept"),
        F.split("gaps", "\n").alias("code"),
    )
    m = F.col("z.line.m")
    holds_code = ~is_blank(F.replace(F.col("z.code"), F.lit(lexing.GAP), F.lit("")))
    return (
        lexed.select("path", F.posexplode(lines).alias("pos", "z"))
        .where(F.col("z.line.text").isNotNull() & F.col("z.kept").isNull())
        .where(holds_code | starts_in_string(m))
        .select("path", (F.col("pos") + 1).alias("line_no"), F.col("z.line.text").alias("text"))
    )


def _audited(files: DataFrame, suggestions: DataFrame, tag: str, only_asked: bool) -> DataFrame:
    """Files with ``wrong`` ARRAY<STRING>: at the place of each inserted line that is not comment in the file's language
    its text, else NULL; NULL for a file without inserted lines."""
    merged = settled(splice_merged(files, suggestions, tag, only_asked), "merged")
    # a file without inserted lines has no wrong ones and is not lexed again
    inserted = F.exists("merged", lambda x: x["orig_line"].isNull())
    merged = merged.withColumn("__new", rebuilt(F.col("merged"), F.col("content")))
    lexed = with_marked(merged, "__new", when=inserted)

    def judged(out: Column, text: Column, m: Column) -> Column:
        return F.when(out.isNotNull() & out["orig_line"].isNull() & ~is_pure_comment(text, m), out["text"])

    # the lines of the new text are the merged ones, but for a CR that an inserted line may end with
    new, marked = F.col("__new"), F.col(MARKED)
    wrong = F.when(
        F.contains(new, F.lit("\r")),
        F.zip_with("merged", line_array(new, marked), lambda out, line: judged(out, line["text"], line["m"])),
    ).otherwise(F.zip_with("merged", F.split(marked, "\n"), lambda out, m: judged(out, out["text"], m)))
    return lexed.withColumn("wrong", F.when(inserted, wrong)).drop(MARKED, "__new", "merged")


def payload_audit(files: DataFrame, suggestions: DataFrame, tag: str = TAG) -> DataFrame:
    """(path, out_line, text): inserted lines that are not comment in the file's language."""
    # a file that no suggestion names has no inserted line
    audited = _audited(files, suggestions, tag, only_asked=True)
    numbered = F.transform("wrong", lambda text, i: F.struct((i + 1).alias("out_line"), text.alias("text")))
    audited = audited.select("path", F.filter(numbered, lambda f: f["text"].isNotNull()).alias("found"))
    # settled: what is exploded is filtered for being empty first, which would make the audit twice
    return settled(audited, "found").select("path", F.explode("found").alias("f")).select("path", "f.out_line", "f.text")


def audit_flags(files: DataFrame, suggestions: DataFrame, tag: str = TAG, flag: str = "bad") -> DataFrame:
    """Files with a column that says whether ``payload_audit`` would name them. It is found in the file's row, so
    nothing but the suggestions is joined."""
    audited = _audited(files, suggestions, tag, only_asked=False)
    return audited.withColumn(flag, F.coalesce(F.exists("wrong", lambda text: text.isNotNull()), F.lit(False))).drop("wrong")
