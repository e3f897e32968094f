"""Small text expressions shared by the operators (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

# Fixed value: the characters that count as blank. Spark's own trim() strips only
# U+0020 and a bare \s is ASCII-only, so every trim below uses this class.
BLANK_NO_LF = (
    r"\t\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
)
BLANK = BLANK_NO_LF + r"\n"

# Fixed value: the marker that generated comments carry.
TAG = "[ds]"


_ASCII_BLANKS = " \t\n\r\x0b\x0c"


def _visible(char: Column) -> Column:
    """Whether a text begins with one of the characters ! to DEL, which are no blanks; looked up once."""
    return F.abs(F.ascii(char) - 80) <= 47


# Trimming spaces settles nearly every text, and trimming ASCII blanks, which takes longer, most others; the patterns
# below are for what is left when the trimmed text begins or ends with a character outside ASCII.
def trim_start(col: Column) -> Column:
    short = F.ltrim(col, F.lit(_ASCII_BLANKS))
    return F.when(_visible(F.ltrim(col)), F.ltrim(col)).when(F.ascii(short) < 128, short).otherwise(
        F.regexp_replace(col, rf"\A[{BLANK}]+", "")
    )


def trim_end(col: Column) -> Column:
    short = F.rtrim(col, F.lit(_ASCII_BLANKS))
    # begins at the first blank of a run only, so long runs are not tried again and again
    pattern = rf"[{BLANK}](?<![{BLANK}][{BLANK}])[{BLANK}]*\z"
    settled = _visible(F.right(F.rtrim(col), F.lit(1)))
    return F.when(settled, F.rtrim(col)).when(F.ascii(F.right(short, F.lit(1))) < 128, short).otherwise(
        F.regexp_replace(col, pattern, "")
    )


def trim(col: Column) -> Column:
    return let(trim_end(col), trim_start)


def is_blank(col: Column) -> Column:
    short = F.ltrim(col, F.lit(_ASCII_BLANKS))
    return (
        F.when(_visible(F.ltrim(col)), F.lit(False))
        .when(short == "", F.lit(True))
        .when(F.ascii(short) < 128, F.lit(False))
        .otherwise(~F.rlike(col, F.lit(rf"[^{BLANK}]")))
    )


def eol_of(content: Column) -> Column:
    """CRLF when the file holds at least one CRLF, LF otherwise."""
    return F.when(F.contains(content, F.lit("\r\n")), F.lit("\r\n")).otherwise(F.lit("\n"))


def split_lines(content: Column) -> Column:
    """Lines of a text; LF and CRLF end a line, a lone CR is data."""
    return F.split(F.replace(content, F.lit("\r\n"), F.lit("\n")), "\n")


def numbered(content: Column) -> Column:
    """``1: first line`` / ``2: second line`` ... joined by LF."""
    return F.array_join(
        F.transform(
            split_lines(content),
            lambda line, i: F.concat((i + 1).cast("string"), F.lit(": "), line),
        ),
        "\n",
    )


def join_lines(lines: Column, eol: Column) -> Column:
    """Lines joined by the file's own line end; NULL entries are left out."""
    return F.call_function("array_join", lines, eol)
