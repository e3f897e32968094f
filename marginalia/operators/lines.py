"""Line and token operators over a table of files (path, ext, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexing
from ..functions.arrays import positions
from ..functions.text import TAG, eol_of, is_blank, numbered, split_lines, trim_start
from .lexed import MARKED, with_marked, with_segments, with_tokens


def to_lines(files: DataFrame) -> DataFrame:
    """lines(path, line_no, text): one row per line, 1-based, trailing empties kept."""
    return files.select("path", F.posexplode(split_lines(F.col("content"))).alias("pos", "text")).select(
        "path", (F.col("pos") + 1).alias("line_no"), "text"
    )


def with_eol(files: DataFrame) -> DataFrame:
    """Adds ``eol``: CRLF when the file has any CRLF, else LF."""
    return files.withColumn("eol", eol_of(F.col("content")))


def number_lines(files: DataFrame) -> DataFrame:
    """listing(path, listing): the text with its line numbers in front."""
    return files.select("path", numbered(F.col("content")).alias("listing"))


def to_tokens(files: DataFrame) -> DataFrame:
    """tokens(path, ext, seq, kind, text); kind is comment, string or code.

    Texts have LF line ends; concatenated in order they give the file back.
    """
    return with_tokens(files).select(
        "path", "ext", F.posexplode("tokens").alias("seq", "t")
    ).select("path", "ext", "seq", "t.kind", "t.text")


def code_runs(files: DataFrame) -> DataFrame:
    """(path, run_no, text): the code before, between and behind the comments and strings of a file.

    Neighbouring code tokens are one run; where two comments or strings meet it is empty.
    """
    cut = lexing.COMMENT  # a noncharacter; where a text holds one itself, it is masked

    def piece(t: Column) -> Column:
        return F.when(t["kind"] == "code", F.translate(t["text"], cut, lexing.MASK)).otherwise(F.lit(cut))

    joined = F.array_join(F.transform("tokens", piece), "")
    return with_tokens(files).select("path", F.posexplode(F.split(joined, cut)).alias("run_no", "text"))


def token_positions(files: DataFrame) -> DataFrame:
    """tokens plus the place where each begins and how many lines it spans.

    Columns: path, ext, seq, kind, text, line_no (1-based), col (0-based), n_lines.
    Positions are running sums inside the row of the file, so nothing is shuffled.
    """
    tokens = with_tokens(files)
    tokens = tokens.withColumn("places", positions(F.transform("tokens", lambda t: t["text"])))
    return tokens.select(
        "path", "ext", F.posexplode(F.arrays_zip("tokens", "places")).alias("seq", "z")
    ).select(
        "path",
        "ext",
        "seq",
        "z.tokens.kind",
        "z.tokens.text",
        (F.col("z.places.line") + 1).alias("line_no"),
        "z.places.col",
        F.size(F.split("z.tokens.text", "\n")).alias("n_lines"),
    )


def line_array(content: Column, marked: Column) -> Column:
    """ARRAY<STRUCT<text, m>>: raw lines next to their marked form.

    One entry more than there are lines; its ``text`` is NULL and its marks tell the
    state behind the last line.
    """
    return F.zip_with(
        split_lines(content),
        F.split(marked, "\n"),
        lambda text, m: F.struct(text.alias("text"), m.alias("m")),
    )


def comment_tail(m: Column) -> Column:
    """Text of a marked line from its last comment start on."""
    tail = F.substring_index(m, lexing.COMMENT, -1)
    marked = F.contains(m, F.lit(lexing.STAYS)) | F.contains(m, F.lit(lexing.TAGGED))
    return F.when(marked, F.rtrim(tail, F.lit(lexing.STAYS + lexing.TAGGED))).otherwise(tail)


def has_comment_start(m: Column) -> Column:
    return F.contains(m, F.lit(lexing.COMMENT))


def starts_in_block(m: Column) -> Column:
    return F.startswith(m, F.lit(lexing.IN_COMMENT))


def ends_in_block(m: Column) -> Column:
    return F.contains(m, F.lit(lexing.STAYS))


def starts_in_string(m: Column) -> Column:
    return F.startswith(m, F.lit(lexing.IN_STRING))


def comment_start(text: Column, m: Column) -> Column:
    """0-based column (in code points) of the last comment that starts on the line."""
    return F.when(has_comment_start(m), F.length(text) - F.length(comment_tail(m)))


def is_lone_comment(m: Column) -> Column:
    """Nothing but one comment, behind spaces or none, begins on the line; most comment lines are like this. What it says of
    others is no matter: they are looked at more closely."""
    return F.startswith(F.ltrim(m), F.lit(lexing.COMMENT)) & (F.substring_index(m, lexing.COMMENT, 2) == m)


def is_pure_comment(text: Column, m: Column) -> Column:
    """Nothing but comment (or blanks) on the line, by the compat rules."""
    start = comment_start(text, m)
    return (
        F.when(is_lone_comment(m) | (starts_in_block(m) & (ends_in_block(m) | ~has_comment_start(m))), F.lit(True))
        .when(start.isNotNull(), is_blank(F.substring(text, F.lit(1), start)))
        .otherwise(is_blank(text))
    )


def is_shebang(text: Column) -> Column:
    """Lines that begin with ``#!`` are never touched, wherever they stand."""
    return F.contains(text, F.lit("#!")) & F.startswith(trim_start(text), F.lit("#!"))


def line_state(files: DataFrame, *extra: str) -> DataFrame:
    """One row per line with everything the lexer knows about it.

    Columns: path, line_no, text, comment_start, starts_in_block, ends_in_block,
    starts_in_string, is_pure_comment, is_shebang. One more row per file, with NULL
    text, stands for the place behind the last line.
    """
    pairs = with_marked(files).select(
        "path",
        *extra,
        F.posexplode(line_array(F.col("content"), F.col(MARKED))).alias("pos", "p"),
    )
    text, m = F.col("text"), F.col("m")
    return pairs.select("path", *extra, (F.col("pos") + 1).alias("line_no"), "p.text", "p.m").select(
        "path",
        *extra,
        "line_no",
        "text",
        comment_start(text, m).alias("comment_start"),
        starts_in_block(m).alias("starts_in_block"),
        ends_in_block(m).alias("ends_in_block"),
        starts_in_string(m).alias("starts_in_string"),
        is_pure_comment(text, m).alias("is_pure_comment"),
        is_shebang(text).alias("is_shebang"),
    )


def comments(files: DataFrame, tag: str = TAG) -> DataFrame:
    """comments(path, ext, seq, line_no, col, text, style, n_lines, own_line, tagged).

    ``seq`` counts the comments of a file from 0, ``style`` is line or block,
    ``own_line`` tells whether only blanks stand before the comment on its line,
    ``tagged`` whether its text carries the tag.
    """
    pieces = with_segments(files).withColumn(
        "places",
        # code and comment alternate, so comment k stands at 2k + 1
        positions(F.flatten(F.transform("segments", lambda s: F.array(s["code"], s["comment"])))),
    )
    placed = F.zip_with(
        "segments",
        F.filter("places", lambda p, i: i % 2 == 1),
        lambda s, p: F.struct(s.alias("s"), p.alias("p")),
    )
    found = pieces.select(
        "path",
        "ext",
        F.posexplode(F.filter(placed, lambda x: x["s"]["comment"] != "")).alias("seq", "x"),
    ).select("path", "ext", "seq", "x.s.code", "x.s.comment", "x.p.line", "x.p.col")
    text = F.col("comment")
    before = F.substring_index("code", "\n", -1)
    return found.select(
        "path",
        "ext",
        "seq",
        (F.col("line") + 1).alias("line_no"),
        "col",
        text.alias("text"),
        F.when(text.startswith("/*") | text.startswith("<!--"), "block").otherwise("line").alias("style"),
        F.size(F.split(text, "\n")).alias("n_lines"),
        (is_blank(before) & (F.length(before) == F.col("col"))).alias("own_line"),
        F.contains(text, F.lit(tag)).alias("tagged"),
    )
