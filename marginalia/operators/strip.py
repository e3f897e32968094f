"""Removing comments: all of them (prune), tagged ones (clean), or strictly by token.

prune and clean follow the compat rules line by line; both are one expression over the
lines of a file, so they plan as a single projection without a shuffle and run on
streams as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexing
from ..functions.arrays import flags_at, let
from ..functions.text import BLANK_NO_LF, TAG, eol_of, is_blank, join_lines, split_lines, trim, trim_end
from .lexed import MARKED, with_gaps, with_marked
from .lines import (
    comment_tail,
    ends_in_block,
    has_comment_start,
    is_lone_comment,
    is_pure_comment,
    is_shebang,
    line_array,
    starts_in_block,
)


_B = rf"[{BLANK_NO_LF}]"


def strip_inline(text: Column, start: Column) -> Column:
    """``text`` without the comment that starts at 0-based column ``start``.

    A block or markup comment that closes on the line is cut out and what follows is
    kept; otherwise everything from ``start`` on goes. Blanks at the end are removed.
    """
    return _without_tail(
        F.substring(text, F.lit(1), start), F.substring(text, start + 1, F.length(text))
    )


def _without_tail(left: Column, tail: Column) -> Column:
    behind = (
        F.when(tail.startswith("/*") & (F.position(F.lit("*/"), tail) > 0), _behind(tail, "*/"))
        .when(tail.startswith("<!--") & (F.position(F.lit("-->"), tail) > 0), _behind(tail, "-->"))
        .otherwise("")
    )
    return trim_end(F.concat(left, behind))


def _behind(tail: Column, close: str) -> Column:
    return F.substring(tail, F.position(F.lit(close), tail) + len(close), F.length(tail))


def mark_tagged_blocks(marked: Column, tag: str) -> Column:
    """Adds the TAGGED mark to the lines of every block run in which the tag occurs.

    A run is a line followed by lines that begin inside a comment; splitting the marked
    text at the other line ends gives exactly those runs.
    """
    def mark(run: Column) -> Column:
        is_block = F.contains(run, F.lit("\n"))
        tagged = is_block & F.contains(lexing.without_marks(run), F.lit(tag))
        return F.when(
            tagged,
            F.concat(F.replace(run, F.lit("\n"), F.lit(lexing.TAGGED + "\n")), F.lit(lexing.TAGGED)),
        ).otherwise(run)

    def marks(text: Column) -> Column:
        runs = F.split(text, rf"\n(?!{lexing.IN_COMMENT})")
        # without a line that begins inside a comment there is no such run
        any_run = F.contains(text, F.lit(lexing.IN_COMMENT))
        return F.when(any_run, F.array_join(F.transform(runs, mark), "\n")).otherwise(text)

    return let(marked, marks)


def in_tagged_block(m: Column) -> Column:
    return F.contains(m, F.lit(lexing.TAGGED))


def stripped_line(text: Column, m: Column, tag: str | None) -> Column:
    """The line after stripping; NULL when it goes. ``tag`` None strips every comment."""
    touched = F.lit(True) if tag is None else in_tagged_block(m) | F.contains(text, F.lit(tag))
    in_block, gone = starts_in_block(m), F.lit(None).cast("string")

    def with_comment(s: Column) -> Column:
        left, tail = s["left"], s["tail"]
        pure = (in_block & ends_in_block(m)) | (~in_block & is_blank(left))
        return F.when(pure, gone).otherwise(_without_tail(left, tail))

    def cut(tail_size: Column) -> Column:
        start = F.length(text) - tail_size
        return F.struct(
            F.substring(text, F.lit(1), start).alias("left"),
            F.substring(text, start + 1, tail_size).alias("tail"),
        )

    # Lines without comment are most of all lines, so they are settled first; empty lines
    # always stay. What a comment line needs repeatedly is bound once.
    return (
        F.when(
            ~has_comment_start(m),
            F.when(touched & (text != "") & (in_block | is_blank(text)) & ~is_shebang(text), gone).otherwise(text),
        )
        .when(~touched | is_shebang(text), text)
        .when(is_lone_comment(m), gone)
        .otherwise(let(let(F.length(comment_tail(m)), cut), with_comment))
    )


def _tagged_marked(marked: Column, tag: str | None) -> Column:
    return marked if tag is None else mark_tagged_blocks(marked, tag)


def stripped_array(content: Column, marked: Column, tag: str | None) -> Column:
    """ARRAY<STRING> aligned with the lines of the file; NULL for deleted lines."""
    # as ``line_array``, but without a pair for each line: whatever a lambda returns is copied
    return F.zip_with(
        split_lines(content),
        F.split(_tagged_marked(marked, tag), "\n"),
        lambda text, m: stripped_line(text, m, tag),
    )


def _whole_lines(content: Column) -> Column:
    """The text with its line ends made uniform and nothing else changed."""
    return F.when(F.contains(content, F.lit("\r\n")), _with_crlf(content)).otherwise(content)


def _with_crlf(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\n"), F.lit("\r\n"))


def strip_with(files: DataFrame, tag: str | None, content: str, output: str) -> DataFrame:
    text = F.col(content)
    # clean leaves a file without the tag as it is, so it need not be lexed
    relevant = None if tag is None else F.contains(text, F.lit(tag))
    lexed = with_marked(files, content, relevant)
    result = join_lines(stripped_array(text, F.col(MARKED), tag), eol_of(text))
    if relevant is not None:
        result = F.when(relevant, result).otherwise(_whole_lines(text))
    return lexed.withColumn(output, result).drop(MARKED)


def prune(
    files: DataFrame, policy: str = "compat", content: str = "content", output: str = "content"
) -> DataFrame:
    """Files without any comment. ``policy='strict'`` removes exactly the comment text."""
    if policy == "strict":
        return strict_prune(files, content, output)
    if policy != "compat":
        raise ValueError(f"unknown policy {policy!r}")
    return strip_with(files, None, content, output)


def clean(
    files: DataFrame, tag: str = TAG, content: str = "content", output: str = "content"
) -> DataFrame:
    """Files without tagged comments."""
    check_tag(tag)
    return strip_with(files, tag, content, output)


def check_tag(tag: str) -> None:
    if not tag or any(c in tag for c in "\n" + lexing.MARKS):
        raise ValueError("the tag has to be visible text on one line")


def stripped_lines(files: DataFrame, tag: str | None = None) -> DataFrame:
    """out_lines(path, out_line, orig_line, text): surviving lines in order."""
    lexed = with_marked(files)
    survivors = F.filter(
        F.transform(
            stripped_array(F.col("content"), F.col(MARKED), tag),
            lambda text, i: F.struct((i + 1).alias("orig_line"), text.alias("text")),
        ),
        lambda line: line["text"].isNotNull(),
    )
    return lexed.select("path", F.posexplode(survivors).alias("pos", "line")).select(
        "path", (F.col("pos") + 1).alias("out_line"), "line.orig_line", "line.text"
    )


# -- strict policy ------------------------------------------------------------------
_GAP = lexing.GAP
_ESCAPES = [(lexing.STAYS, lexing.STAYS + "?"), (_GAP, lexing.STAYS + "!")]


def code_with_gaps(segments: Column) -> Column:
    """The text of ``segments`` with every comment replaced by one gap per line it covers;
    characters of the text that would read as gaps are escaped."""

    def part(s: Column) -> Column:
        code, comment = s["code"], s["comment"]
        for plain, escaped in _ESCAPES:
            code = F.replace(code, F.lit(plain), F.lit(escaped))
        n_lf = F.length(comment) - F.length(F.replace(comment, F.lit("\n"), F.lit("")))
        gap = F.concat(F.lit(_GAP), F.repeat(F.lit("\n" + _GAP), n_lf))
        kept = (comment == "") | F.startswith(comment, F.lit("#!"))
        return F.concat(code, F.when(kept, comment).otherwise(gap))

    return F.array_join(F.transform(segments, part), "")


def _unescaped(text: Column) -> Column:
    for plain, escaped in reversed(_ESCAPES):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def _close_gaps(text: Column) -> Column:
    text = F.concat(F.lit("\n"), text)
    words = r"[\p{L}\p{N}_$]"
    # lines of nothing but comment; blanks in front of a comment that ends its line; a
    # space where a comment kept two words apart
    text = F.regexp_replace(text, rf"\n{_B}*+{_GAP}(?:{_GAP}|{_B})*+(?=\n|\z)", "")
    text = F.regexp_replace(text, rf"(?:{_B}(?<!{_B}{_B}){_B}*+)?+{_GAP}++(?=\n|\z)", "")
    text = F.regexp_replace(text, rf"{_GAP}(?<={words}{_GAP}){_GAP}*+(?={words})", " ")
    text = F.replace(text, F.lit(_GAP), F.lit(""))
    return F.substring(text, F.lit(2), F.length(text))


def strict_prune(files: DataFrame, content: str = "content", output: str = "content") -> DataFrame:
    """Removes exactly the comment text: no code and no string content goes with it.

    Lines on which nothing but comment stood go entirely, blanks in front of a comment
    that ends its line go too, and words that a comment kept apart get a space. Row-local.
    """
    text = F.col(content)
    lexed = with_gaps(files, content)
    # Escaping is for files that hold characters used as marks, and for those only.
    closed = _close_gaps(F.col("gaps"))
    closed = F.when(lexing.has_marks(text), _unescaped(closed)).otherwise(closed)
    crlf = F.replace(closed, F.lit("\n"), F.lit("\r\n"))
    result = F.when(F.contains(text, F.lit("\r\n")), crlf).otherwise(closed)
    return lexed.withColumn(output, result).drop("gaps")


# -- explicit deletions -------------------------------------------------------------
def line_requests(files: DataFrame, requests: DataFrame, past_end: int) -> DataFrame:
    """Requests whose ``line`` exists in their file, up to ``past_end`` lines behind it."""
    sizes = files.select("path", F.size(split_lines(F.col("content"))).alias("__n"))
    return requests.join(sizes, "path").where(F.col("line").between(1, F.col("__n") + past_end)).drop("__n")


def _looks_like_comment(text: Column, m: Column) -> Column:
    """What an explicit deletion may delete (the safety block)."""
    visible = trim(text)
    looks = starts_in_block(m) | is_pure_comment(text, m)
    for opening in ("//", "/*", "*", "#", "<!--", "-->", "--"):  # fixed values
        looks = looks | F.startswith(visible, F.lit(opening))
    return looks | F.endswith(visible, F.lit("*/"))


def apply_deletions(
    files: DataFrame, deletions: DataFrame, tag: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Strips like prune (``tag`` None) or clean, and deletes the requested lines too.

    deletions(path, line). Only lines that look like comment are deleted. Returns the
    files and refused(path, line, text), the requests that would have deleted code.
    """
    # Distinct lines; those a file does not have find no place among its lines.
    asked = (
        deletions.select("path", "line")
        .where(F.col("line").between(1, 2**31 - 1))
        .distinct()
        .groupBy("path")
        .agg(F.collect_list(F.col("line").cast("int")).alias("__asked"))
    )
    text = F.col("content")
    lexed = with_marked(files.join(asked, "path", "left"))
    pairs = line_array(text, _tagged_marked(F.col(MARKED), tag))
    judged = F.zip_with(
        pairs,
        flags_at(F.size(split_lines(text)), F.col("__asked")),
        lambda p, asked_for: F.struct(
            p["text"].alias("text"),
            stripped_line(p["text"], p["m"], tag).alias("kept"),
            (asked_for & (p["text"] != "") & ~is_shebang(p["text"])).alias("asked"),
            _looks_like_comment(p["text"], p["m"]).alias("safe"),
        ),
    )
    judged_files = lexed.withColumn("__judged", judged)
    result = F.transform(
        F.col("__judged"), lambda j: F.when(~F.coalesce(j["asked"] & j["safe"], F.lit(False)), j["kept"])
    )
    out = judged_files.withColumn("content", join_lines(result, eol_of(text)))
    refused = (
        judged_files.where(F.col("__asked").isNotNull())
        .select("path", F.posexplode("__judged").alias("pos", "j"))
        .where(F.col("j.asked") & ~F.col("j.safe"))
        .select("path", (F.col("pos") + 1).alias("line"), "j.text")
    )
    return out.drop(MARKED, "__asked", "__judged"), refused


# -- dry run ------------------------------------------------------------------------
def preview(files: DataFrame, rewrite) -> DataFrame:
    """(path, before, after) of the files a rewrite would change; nothing is written.

    ``rewrite`` maps files to files and adds the new text as column ``after``. The
    comparison sits inside the explode: as a filter it would be pushed below the rewrite
    and run the whole rewrite a second time.
    """
    pair = F.struct(F.col("content").alias("before"), F.col("after"))
    changed = F.filter(F.array(pair), lambda p: p["before"] != p["after"])
    return rewrite(files).select("path", F.explode(changed).alias("p")).select("path", "p.before", "p.after")
