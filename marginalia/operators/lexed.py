"""Lexing a table of files: the columns every other operator starts from.

Files whose block comments may nest deeper than the patterns reach are lexed by an expression
of their own, which is not evaluated for any other file. So there is one plan for
all files, each is read once, and no text leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexing
from ..functions.langs import family_of
from .deep_nesting import nested_tokens

_TOKENS = "__tokens"
MARKED = "__marked"


def _lex(files: DataFrame, content: str, output: str, by_pattern, by_tokens, tail: str = "") -> DataFrame:
    files = settled(files, content)
    text, family = F.col(content), family_of(F.col("ext"))
    tokens = F.when(lexing.too_deep(text, family), nested_tokens(text, family, tail))
    exact = F.when(F.col(_TOKENS).isNotNull(), by_tokens(F.col(_TOKENS), family))
    return (
        files.withColumn(_TOKENS, tokens)
        .withColumn(output, exact.otherwise(by_pattern(text, family)))
        .drop(_TOKENS)
    )


def settled(files: DataFrame, *columns: str) -> DataFrame:
    """The same rows with ``columns`` computed here and nowhere else.

    A text may have been lexed and rewritten before it is lexed again: the optimizer would write the
    first rewriting into each use of its result, also where no column function can stand. An
    explode of one element keeps it from that, and from repeating the work.
    """
    for name in columns:
        rest = [c for c in files.columns if c != name]
        files = files.select(*rest, F.explode(F.array(name)).alias(name)).select(*files.columns)
    return files


def with_marked(
    files: DataFrame, content: str = "content", when: Column | None = None
) -> DataFrame:
    """Adds the marked text (see ``functions.lexing``); NULL where ``when`` is false.

    ``when`` saves the lexing of rows whose result is known without it.
    """

    def guarded(build):
        return lambda x, family: build(x, family) if when is None else F.when(when, build(x, family))

    return _lex(
        files,
        content,
        MARKED,
        guarded(lexing.marked_text),
        guarded(lexing.marked_from_tokens),
        tail="\n",
    )


def with_segments(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``segments`` ARRAY<STRUCT<code, comment>>."""
    return _lex(files, content, "segments", lexing.segments, lexing.segments_from_tokens)


def with_gaps(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``gaps``: the text with comments replaced by gaps (escaped if it has marks)."""
    from .strip import code_with_gaps

    def by_pattern(text: Column, family: Column) -> Column:
        return F.when(
            lexing.has_marks(text), code_with_gaps(lexing.segments(text, family))
        ).otherwise(lexing.code_with_gaps(text, family))

    def by_tokens(tokens: Column, family: Column) -> Column:
        return code_with_gaps(lexing.segments_from_tokens(tokens, family))

    return _lex(files, content, "gaps", by_pattern, by_tokens)


def with_tokens(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``tokens`` ARRAY<STRUCT<kind, text>>: the text in order, nothing lost."""

    def typed(tokens: Column, family: Column) -> Column:
        return F.transform(
            tokens,
            lambda t: F.struct(lexing.token_kind(t, family).alias("kind"), t.alias("text")),
        )

    return _lex(
        files,
        content,
        "tokens",
        lambda text, family: typed(lexing.tokens(text, family), family),
        typed,
    )
