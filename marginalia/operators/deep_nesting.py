"""Exact lexing of files whose block comments nest deeper than the patterns reach.

Only rows that ``lexing.too_deep`` selects come here (languages with nesting comments
and more comment openings than the pattern has levels). A pattern that knows what is too deep finds the first such
comment; everything before it is lexed as any text is. From its opening on nothing but openings and closings counts, so
a running depth over these tells where it ends, and the rest of the text is treated the same way. Built-in
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexing
from ..functions.arrays import let
from ..functions.langs import NESTED_FAMILIES

# Set off tokens in a working copy in which these characters are masked.
_OPENS, _CLOSES = lexing.COMMENT, lexing.IN_COMMENT
_EDGES = r"(?s)/\*|\*/|[^/*]++|[/*]"


def _strictly_nested(depth: int) -> str:
    """A block comment of at most ``depth`` levels; one that goes deeper does not match at all."""
    pattern = r"/\*(?:[^*/]++|/(?!\*)|\*(?!/))*+(?:\*/|\z)"
    for _ in range(depth - 1):
        pattern = rf"/\*(?:[^*/]++|{pattern}|/(?!\*)|\*(?!/))*+(?:\*/|\z)"
    return pattern


def _finder(name: str) -> str:
    """Matches the tokens of a text, and the opening of a comment that is too deep."""
    family = lexing.FAMILIES[name]
    rest = [c for c in family.comments if not c.startswith(r"/\*")]
    plain = "(?:" + "|".join(family.plain) + ")++"
    tokens = "|".join([*rest, _strictly_nested(lexing.NEST_LIMIT), *family.strings, plain])
    return rf"(?s)(?<token>{tokens})|(?<deep>/\*)"


def _before_first_deep(text: Column, family: Column) -> Column:
    """How many characters stand before the first comment that is too deep (all, if there is none)."""
    copy = F.translate(text, _OPENS + _CLOSES, lexing.MASK * 2)
    found = None
    for name in NESTED_FAMILIES:
        set_off = F.regexp_replace(copy, F.lit(_finder(name)), F.lit(_OPENS + "${token}" + _CLOSES + "${deep}"))
        found = F.when(family == name, set_off) if found is None else found.when(family == name, set_off)
    # no token is empty: an empty one stands for what is none
    before = F.substring_index(found, _OPENS + _CLOSES, 1)
    return F.length(F.translate(before, _OPENS + _CLOSES, ""))


def _comment_length(text: Column) -> Column:
    """How long the comment is with which the text begins: to where as many are closed as were opened."""

    def step(acc: Column, piece: Column) -> Column:
        turn = F.when(piece == "/*", 1).when(piece == "*/", -1).otherwise(0)
        open_ = (acc["depth"] > 0) | (acc["length"] == 0)
        return F.struct(
            F.when(open_, acc["depth"] + turn).otherwise(acc["depth"]).alias("depth"),
            F.when(open_, acc["length"] + F.length(piece)).otherwise(acc["length"]).alias("length"),
        )

    pieces = F.regexp_extract_all(text, F.lit(_EDGES), F.lit(0))
    return F.aggregate(pieces, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("length")), step)["length"]


def nested_tokens(content: Column, family: Column, tail: str = "") -> Column:
    """ARRAY<STRING>: the tokens of ``content`` + ``tail`` with LF line ends, comments nested to any depth."""
    text = F.concat(F.replace(content, F.lit("\r\n"), F.lit("\n")), F.lit(tail))
    part = "struct<text:string,deep:boolean>"

    def cut(acc: Column) -> Column:
        """Moves the text up to and with the first comment that is too deep from ``rest`` to ``parts``."""

        def at(n: Column) -> Column:
            behind = F.substring(acc["rest"], n + 1, F.length(acc["rest"]))
            return let(F.struct(n.alias("n"), behind.alias("behind")), moved)

        def moved(s: Column) -> Column:
            def ended(length: Column) -> Column:
                shallow = F.struct(F.substring(acc["rest"], F.lit(1), s["n"]).alias("text"), F.lit(False).alias("deep"))
                deep = F.struct(F.substring(s["behind"], F.lit(1), length).alias("text"), F.lit(True).alias("deep"))
                rest = F.substring(s["behind"], length + 1, F.length(s["behind"]))
                return F.struct(F.concat(acc["parts"], F.array(shallow, deep)).alias("parts"), rest.alias("rest"))

            return let(_comment_length(s["behind"]), ended)

        return F.when(acc["rest"] == "", acc).otherwise(let(_before_first_deep(acc["rest"], family), at))

    # a comment that is too deep has more openings than the limit, so there are no more of them than this
    most = F.floor(F.regexp_count(content, F.lit(r"/\*")) / lexing.NEST_LIMIT).cast("int")
    begin = F.struct(F.array().cast(f"array<{part}>").alias("parts"), text.alias("rest"))
    done = F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), begin, lambda acc, _: cut(acc))

    def lexed(acc: Column) -> Column:
        last = F.struct(acc["rest"].alias("text"), F.lit(False).alias("deep"))
        return F.flatten(
            F.transform(
                F.filter(F.concat(acc["parts"], F.array(last)), lambda p: p["text"] != ""),
                lambda p: F.when(p["deep"], F.array(p["text"])).otherwise(_shallow(p["text"], family)),
            )
        )

    return let(done, lexed)


def _shallow(text: Column, family: Column) -> Column:
    out = None
    for name in NESTED_FAMILIES:
        found = F.regexp_extract_all(text, F.lit(lexing.FAMILIES[name].token_pattern), F.lit(0))
        out = F.when(family == name, found) if out is None else out.when(family == name, found)
    return out
