"""Lexing as one regular expression per language family.

Two views of a file are offered, both as plain column expressions:

``tokens(content, family)``
    every piece of the text in order (lossless), fine-grained.

``marked_lines(content, family)``
    the lines of the text in which marks (Unicode noncharacters) show where a comment
    starts and which lines begin inside a comment or inside a string. One entry more
    than the file has lines: the last one tells the state behind the final line.

Everything stays inside the row of the file, so neither view shuffles. Block
comments of the nesting languages are matched up to ``NEST_LIMIT`` levels; a file
with more openings than that is recognised by ``too_deep`` and lexed by
``operators.deep_nesting``, which knows no limit.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let
from .langs import NESTED_FAMILIES, RESET_FAMILIES
from .text import BLANK, BLANK_NO_LF

# Marks. Noncharacters never stand for text; should a file hold one all the same, it
# is masked in the working copy only (see ``working_copy``), never in the output.
COMMENT = "\ufdd0"  # a comment starts here
IN_COMMENT = "\ufdd1"  # this line begins inside a comment
IN_STRING = "\ufdd2"  # this line begins inside a string
STAYS = "\ufdd3"  # this line ends inside a comment
TAGGED = "\ufdd4"  # this line belongs to a tagged comment block
MARKS = COMMENT + IN_COMMENT + IN_STRING + STAYS + TAGGED
MASK = "\ufffd"

NEST_LIMIT = 48

_B = f"[{BLANK_NO_LF}]"

# -- comments ---------------------------------------------------------------------
_SLASH_LINE = r"//[^\n]*+"
_HASH_LINE = r"#[^\n]*+"
_MARKUP = r"<!--(?:[^-]++|-(?!->))*+(?:-->|\z)"
# Inside a block "/*" is consumed as a pair, so the "*/" in "/*/" does not close it.
_BLOCK = r"/\*(?:[^*/]++|/\*?+|\*(?!/))*+(?:\*/|\z)"


def _nested_block(depth: int) -> str:
    pattern = _BLOCK
    for _ in range(depth - 1):
        pattern = rf"/\*(?:[^*/]++|{pattern}|/|\*(?!/))*+(?:\*/|\z)"
    return pattern


# -- strings ----------------------------------------------------------------------
def _one_line(quote: str, opening: str = "") -> str:
    """A string that closes on the line it opens on."""
    return rf"{quote}{opening}(?:\\[^\n]|[^{quote}\\\n]++)*+{quote}"


def _until_eol(quote: str) -> str:
    """A string that ends at its quote or, failing that, with the line."""
    return rf"{quote}(?:\\[^\n]|[^{quote}\\\n]++)*+(?:{quote}|\\?+(?=\n|\z))"


def _until_closed(quote: str, opening: str = "") -> str:
    """A string that runs over lines until its quote, or to the end of the text."""
    return rf"{quote}{opening}(?:\\.|[^{quote}\\]++)*+(?:{quote}|\\?+\z)"


def _triple(quote: str, one_line: bool) -> str:
    q3 = quote * 3
    body = rf"(?:[^{quote}\n]++|(?!{q3}){quote})*+" if one_line else rf"(?:[^{quote}]++|(?!{q3}){quote})*+"
    return rf"{q3}{body}{q3}" if one_line else rf"{q3}{body}(?:{q3}|\z)"


def _raw(name: str, one_line: bool) -> str:
    close = rf"\)\k<{name}>\""
    body = rf"(?:(?!{close}){'[^\\n]' if one_line else '.'})*+"
    opening = rf'R"(?<{name}>[^()\\{BLANK}]{{0,16}})\('
    return rf"{opening}{body}{close}" if one_line else rf"{opening}{body}(?:{close}|\z)"


# A "/" is a regular expression when nothing visible stands before it on the line, or
# one of these characters, or one of these words (fixed values).
_REGEX_AFTER_CHARS = r"=({\[:,;!+*&|?<>\-"
_REGEX_AFTER_WORDS = ("return", "typeof", "yield", "await", "throw")

# Looking back over blanks has to be bounded in a Java pattern. Files with a longer run
# of blanks before a "/", or with blanks outside ASCII, take the "js_wide" patterns,
# which hold the blanks back instead and so look at exactly one place; they are slower.
_LOOK_BACK = 40
_ASCII_B = r"[\t\x0B\f\r ]"
_LONG_BLANKS = rf"{_ASCII_B}{{{_LOOK_BACK}}}/"
_OTHER_BLANKS = r"[\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"

_BEHIND = (
    rf"(?:[{_REGEX_AFTER_CHARS}\n]|" + "|".join(_REGEX_AFTER_WORDS) + rf"){_ASCII_B}{{0,{_LOOK_BACK}}}"
)
_NEAR_REGEX = rf"/(?![/*])(?:(?<={_BEHIND}/)|(?<=\A{_ASCII_B}{{0,{_LOOK_BACK}}}/))"
_NEAR_DIVISION = rf"/(?![/*])(?<!{_BEHIND}/)(?<!\A{_ASCII_B}{{0,{_LOOK_BACK}}}/)"

_WIDE_REGEX = (
    r"(?:(?<![^\n])|(?<=["
    + _REGEX_AFTER_CHARS
    + "])|"
    + "|".join(f"(?<={w})" for w in _REGEX_AFTER_WORDS)
    + rf"){_B}*+/(?![/*])"
)
_WIDE_DIVISION = (
    r"(?<=[^\n"
    + _REGEX_AFTER_CHARS
    + "])"
    + "".join(f"(?<!{w})" for w in _REGEX_AFTER_WORDS)
    + rf"{_B}*+/(?![/*])"
)


def _regex_literal(opening: str, one_line: bool) -> str:
    if one_line:
        return rf"{opening}(?:\\[^\n]|[^/\\\n]++)*+/"
    return rf"{opening}(?:\\.|[^/\\]++)*+(?:/|\\?+\z)"


# -- families ---------------------------------------------------------------------
@dataclass
class Family:
    """Pattern pieces of one language family, in the order they are tried."""

    comments: list[str]
    strings: list[str]  # complete strings, whatever their length
    line_strings: list[str]  # the same strings when they stay on one line
    plain: list[str]  # everything else; never empty, one alternative per special char
    spans: list[str] = field(default_factory=list)  # strings that can cross a line end
    division: str = ""  # a "/" that opens nothing, where that takes a look backwards

    @property
    def token_pattern(self) -> str:
        code = ["(?:" + "|".join(self.plain) + ")++"]
        if self.division:
            # A division sign at the start of a token stands alone, so that how a token
            # begins always tells a regular expression from code.
            first = "|".join(self.plain)
            code = [f"(?:{first})(?:{first}|{self.division})*+", self.division]
        return "(?s)" + "|".join([*self.comments, *self.strings, *code])

    @property
    def segment_pattern(self) -> str:
        """Code with its one-line strings, then a comment or a multi-line string."""
        code = "|".join([*self.line_strings, *self.plain, *filter(None, [self.division])])
        comment, span = "|".join(self.comments), "|".join(self.spans)
        return rf"(?s)(?<code>(?:{code})*+)(?:(?<comment>{comment})|(?<span>{span}))?+"

    @property
    def cut_replacement(self) -> str:
        """The parts of a segment set off by marks. By number: names are looked up again for each match."""
        names = re.findall(r"\(\?<(\w+)>", self.segment_pattern)
        code, comment, span = (f"${names.index(name) + 1}" for name in ("code", "comment", "span"))
        return code + _TO_COMMENT + comment + _TO_SPAN + span + _CUT


_ESCAPE = r"\\[\\\"'`]?+"  # outside strings a backslash hides the quote behind it


def _quoted(quotes: str, reset: bool) -> tuple[list[str], list[str], list[str]]:
    """(complete, one-line, multi-line) patterns for plain quotes and the backtick."""
    full = [_until_eol(q) if reset else _until_closed(q) for q in quotes]
    short = [_until_eol(q) if reset else _one_line(q) for q in quotes]
    long = [] if reset else [_until_closed(q) for q in quotes]
    full.append(_until_closed("`"))
    short.append(_one_line("`"))
    long.append(_until_closed("`"))
    return full, short, long


def _slash_family(name: str, extra_comments=(), special: str = "", plain=()) -> Family:
    block = _nested_block(NEST_LIMIT) if name in NESTED_FAMILIES else _BLOCK
    full, short, long = _quoted("\"'", name in RESET_FAMILIES)
    return Family(
        comments=[_SLASH_LINE, block, *extra_comments],
        strings=full,
        line_strings=short,
        plain=[rf"[^/\\\"'`{special}]++", r"/(?![/*])", *plain, _ESCAPE],
        spans=long,
    )


def _build() -> dict[str, Family]:
    fam = {
        "cstyle": _slash_family("cstyle"),
        "swift": _slash_family("swift"),
        "rust": _slash_family("rust"),
        "css": _slash_family("css"),
        "php": _slash_family("php", extra_comments=[_HASH_LINE], special="#"),
        "html": _slash_family(
            "html", extra_comments=[_MARKUP], special="<", plain=[r"<(?!!--)"]
        ),
    }

    full, short, long = _quoted("\"'", True)
    no_raw_here = rf'R(?!"[^()\\{BLANK}]{{0,16}}\()'
    fam["c"] = Family(
        comments=[_SLASH_LINE, _BLOCK],
        strings=[_raw("delim", False), *full],
        line_strings=[_raw("short", True), *short],
        plain=[r"[^/\\\"'`R]++", no_raw_here, r"/(?![/*])", _ESCAPE],
        spans=[_raw("long", False), *long],
    )

    js_code = {
        "js": (_NEAR_REGEX, _NEAR_DIVISION, [r"[^/\\\"'`]++"]),
        "js_wide": (
            _WIDE_REGEX,
            _WIDE_DIVISION,
            [rf"[^/\\\"'`{BLANK}]++", r"\n", rf"{_B}++(?!/(?![/*]))"],
        ),
    }
    for name, (opening, division, plain) in js_code.items():
        fam[name] = Family(
            comments=[_SLASH_LINE, _BLOCK],
            strings=[_regex_literal(opening, False), *full],
            line_strings=[_regex_literal(opening, True), *short],
            plain=[*plain, _ESCAPE],
            division=division,
            spans=[_regex_literal(opening, False), *long],
        )

    full, short, long = _quoted("\"'", False)
    fam["hash"] = Family(
        comments=[_HASH_LINE],
        strings=full,
        line_strings=short,
        plain=[r"[^#\\\"'`]++", _ESCAPE],
        spans=long,
    )

    not_triple = {'"': '(?!"")', "'": "(?!'')"}
    fam["python"] = Family(
        comments=[_HASH_LINE],
        strings=[_triple(q, False) for q in "\"'"] + [_until_closed(q, not_triple[q]) for q in "\"'"],
        line_strings=[_triple(q, True) for q in "\"'"] + [_one_line(q, not_triple[q]) for q in "\"'"],
        plain=[r"[^#\\\"']++", r"\\(?:\\|\"(?!\"\")|'(?!''))?+"],
        spans=[_triple(q, False) for q in "\"'"] + [_until_closed(q, not_triple[q]) for q in "\"'"],
    )
    return fam


FAMILIES = _build()


def _per_family(content: Column, family: Column, build) -> Column:
    """CASE over the families; each branch has a literal pattern, compiled once."""
    not_ascii = F.length(content) < F.octet_length(content)
    wide = F.rlike(content, F.lit(_LONG_BLANKS)) | (
        not_ascii & F.rlike(content, F.lit(_OTHER_BLANKS))
    )
    out = F.when((family == "js") & wide, build(FAMILIES["js_wide"]))
    for name, fam in FAMILIES.items():
        if name != "js_wide":
            out = out.when(family == name, build(fam))
    return out


# -- tokens -----------------------------------------------------------------------
def tokens(content: Column, family: Column) -> Column:
    """ARRAY<STRING>: the text cut into comments, strings and code, nothing lost."""
    text = F.replace(content, F.lit("\r\n"), F.lit("\n"))
    return _per_family(
        content, family, lambda fam: F.regexp_extract_all(text, F.lit(fam.token_pattern), F.lit(0))
    )


def token_kind(token: Column, family: Column) -> Column:
    """``comment`` / ``string`` / ``code`` from how a token begins (family at hand)."""
    line_hash = family.isin("python", "hash", "php") & token.startswith("#")
    slash = ~family.isin("python", "hash") & (token.startswith("//") | token.startswith("/*"))
    markup = (family == "html") & token.startswith("<!--")
    quote = token.startswith('"') | token.startswith("'") | (
        (family != "python") & token.startswith("`")
    )
    raw = (family == "c") & token.startswith('R"')
    # A "/", with blanks before it or not, opens a regular expression unless that is all.
    regex = (family == "js") & F.rlike(token, F.lit(rf"\A{_B}*+/[^/*]"))
    return (
        F.when(line_hash | slash | markup, F.lit("comment"))
        .when(quote | raw | regex, F.lit("string"))
        .otherwise(F.lit("code"))
    )


# -- marked text ------------------------------------------------------------------
def has_marks(text: Column) -> Column:
    found = F.contains(text, F.lit(COMMENT))
    for mark in MARKS[1:]:
        found = found | F.contains(text, F.lit(mark))
    return (F.length(text) < F.octet_length(text)) & found


def _masked(text: Column) -> Column:
    return F.translate(text, MARKS, MASK * len(MARKS))


def working_copy(content: Column) -> Column:
    """LF line ends, marks masked, and one LF added so that the state behind the last
    line becomes visible as one more line."""
    text = F.replace(content, F.lit("\r\n"), F.lit("\n"))
    # translate() looks at every character, so it runs only where there is work for it
    return F.concat(F.when(has_marks(content), _masked(text)).otherwise(text), F.lit("\n"))


def _mark_comment(comment: Column) -> Column:
    inner = F.replace(comment, F.lit("\n"), F.lit(STAYS + "\n" + IN_COMMENT))
    return F.concat(F.lit(COMMENT), inner)


def _mark_string(string: Column) -> Column:
    return F.replace(string, F.lit("\n"), F.lit("\n" + IN_STRING))


# A segment is: code, then a comment or nothing, then a multi-line string or nothing.
_TO_COMMENT, _TO_SPAN, _CUT = COMMENT, IN_STRING, STAYS


def _cut_text(text: Column, content: Column, family: Column) -> Column:
    """A text free of marks with the parts of its segments set off by marks; where no
    comment and no multi-line string follows, the marks are left out."""
    cut = _per_family(
        content,
        family,
        lambda fam: F.regexp_replace(
            text,
            F.lit(fam.segment_pattern),
            F.lit(fam.cut_replacement),
        ),
    )
    return F.replace(cut, F.lit(_TO_COMMENT + _TO_SPAN + _CUT), F.lit(""))


def _segment_parts(segment: Column) -> tuple[Column, Column, Column]:
    code_comment = F.substring_index(segment, _TO_SPAN, 1)
    comment = F.substring_index(code_comment, _TO_COMMENT, -1)
    code = F.substring(
        code_comment, F.lit(1), F.length(code_comment) - F.length(comment) - 1
    )
    return code, comment, F.substring_index(segment, _TO_SPAN, -1)


# A line end inside a comment of a text that is cut: the first one, or one behind the last that was found.
_COMMENT_LF = rf"({_TO_COMMENT}[^\n{_TO_SPAN}]*+|(?!\A)\G[^\n{_TO_SPAN}]*+)\n"


def marked_text(content: Column, family: Column) -> Column:
    """The working copy of a text with marks inserted."""

    def mark(segment: Column) -> Column:
        code, comment, span = _segment_parts(segment)
        marked = F.concat(
            code, F.when(comment == "", F.lit("")).otherwise(_mark_comment(comment)), _mark_string(span)
        )
        return F.when(F.contains(segment, F.lit(_TO_SPAN)), marked).otherwise(segment)

    def marks(cut: Column) -> Column:
        # Without strings over several lines nothing but comments is set off, so only their ends
        # have to go, and only line ends inside them to be marked; no segment is looked at by itself.
        over_lines = F.regexp_replace(cut, _COMMENT_LF, f"$1{STAYS}\n{IN_COMMENT}")
        block = F.contains(cut, F.lit(_TO_COMMENT + "/*")) | F.contains(cut, F.lit(_TO_COMMENT + "<!--"))
        comments = F.replace(F.when(block, over_lines).otherwise(cut), F.lit(_TO_SPAN + _CUT), F.lit(""))
        spans = F.contains(cut, F.lit(_TO_COMMENT + _TO_SPAN))
        return F.when(spans, F.array_join(F.transform(F.split(cut, _CUT), mark), "")).otherwise(comments)

    return let(_cut_text(working_copy(content), content, family), marks)


def segments(content: Column, family: Column) -> Column:
    """ARRAY<STRUCT<code, comment>>: comments with the code in front of each."""

    def parts(segment: Column) -> Column:
        code, comment, span = _segment_parts(segment)
        whole = F.struct(F.concat(code, span).alias("code"), comment.alias("comment"))
        rest = F.struct(segment.alias("code"), F.lit("").alias("comment"))
        return F.when(F.contains(segment, F.lit(_TO_SPAN)), whole).otherwise(rest)

    text = F.replace(content, F.lit("\r\n"), F.lit("\n"))
    return F.when(
        has_marks(content), segments_from_tokens(tokens(content, family), family)
    ).otherwise(F.transform(F.split(_cut_text(text, content, family), _CUT), parts))


# Stands for removed comment text, one per line the comment was on.
GAP = TAGGED


def code_with_gaps(content: Column, family: Column) -> Column:
    """LF text with every comment replaced by gaps. For content free of marks."""
    text = F.replace(content, F.lit("\r\n"), F.lit("\n"))
    cut = _cut_text(text, content, family)
    # comments on one line, except that a "#!" line stays as it is
    cut = F.regexp_replace(cut, rf"{_TO_COMMENT}(#![^\n{_TO_SPAN}]*+){_TO_SPAN}", "$1")
    cut = F.regexp_replace(cut, rf"{_TO_COMMENT}[^\n{_TO_SPAN}]++{_TO_SPAN}", GAP)
    cut = F.replace(F.replace(cut, F.lit(_TO_COMMENT + _TO_SPAN), F.lit("")), F.lit(_CUT), F.lit(""))

    # what is still set off begins with a comment over several lines
    def gaps(piece: Column) -> Column:
        comment = F.substring_index(piece, _TO_SPAN, 1)
        n_lf = F.length(comment) - F.length(F.replace(comment, F.lit("\n"), F.lit("")))
        behind = F.substring(piece, F.length(comment) + 2, F.length(piece))
        filled = F.concat(F.lit(GAP), F.repeat(F.lit("\n" + GAP), n_lf), behind)
        return F.when(F.contains(piece, F.lit(_TO_SPAN)), filled).otherwise(piece)

    return F.array_join(F.transform(F.split(cut, _TO_COMMENT), gaps), "")


def segments_from_tokens(content_tokens: Column, family: Column) -> Column:
    def parts(token: Column) -> Column:
        comment = token_kind(token, family) == "comment"
        return F.struct(
            F.when(comment, F.lit("")).otherwise(token).alias("code"),
            F.when(comment, token).otherwise(F.lit("")).alias("comment"),
        )

    return F.transform(content_tokens, parts)


def marked_from_tokens(content_tokens: Column, family: Column) -> Column:
    """The same marked text, built from the tokens of a text that ends with the added LF."""

    def mark(token: Column) -> Column:
        kind = token_kind(token, family)
        clean = F.when(has_marks(token), _masked(token)).otherwise(token)
        return (
            F.when(kind == "comment", _mark_comment(clean))
            .when(kind == "string", _mark_string(clean))
            .otherwise(clean)
        )

    return F.array_join(F.transform(content_tokens, mark), "")


# Nothing but strings in double quotes that end on their line, and no other quotes or backslashes. None is empty, so
# three quotes never meet, and none holds what may end a comment, so none begins inside one and ends behind it.
_CLOSED_QUOTES = r"""\A(?:[^"'`\\]++|"[^"'`\\\n*>]++")*+\z"""


def strings_may_cross(content: Column, family: Column) -> Column:
    """False only for files without a string that runs over a line end, as can be told without lexing."""
    ticks = F.contains(content, F.lit("`"))
    return (
        F.when(family.isin("cstyle", "swift"), ticks)
        .when(family == "c", ticks | F.contains(content, F.lit('R"')))
        .when(family == "js", F.lit(True))  # regular expressions too may
        .otherwise(~F.rlike(content, F.lit(_CLOSED_QUOTES)))
    )


def without_marks(text: Column) -> Column:
    return F.translate(text, MARKS, "")


def too_deep(content: Column, family: Column) -> Column:
    """True when nested comments of this file may exceed the pattern's depth."""
    return family.isin(*NESTED_FAMILIES) & (
        F.regexp_count(content, F.lit(r"/\*")) > NEST_LIMIT
    )
