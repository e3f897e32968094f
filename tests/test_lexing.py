"""The two patterns of a family, and an independent scanner, have to agree."""

import random
import re

from pyspark.sql import functions as F

from marginalia.functions import lexing
from marginalia.functions.arrays import positions
from marginalia.functions.langs import LANGUAGES, RESET_FAMILIES

ALPHABET = ['"', "'", "`", "/", "*", "#", "<!--", "-->", "\\", "\n", " ", "a", "(", "R\"x(", ")x\"", "=", "//", "/*", "*/", '"""', "return "]


def scan(text, family):
    """(offset, kind) of every comment and string, by searching from opening to closing.

    Covers the families without regular expressions, nesting and raw strings.
    """
    hash_only = family in ("python", "hash")
    found, at = [], 0
    opening = {
        "python": r"#|\"\"\"|'''|\"|'",
        "hash": r"#|\"|'|`",
        "php": r"#|//|/\*|\"|'|`",
        "html": r"<!--|//|/\*|\"|'|`",
    }.get(family, r"//|/\*|\"|'|`")
    while match := re.compile(opening).search(text, at):
        start, what = match.start(), match.group()
        end = None
        if what in ("#", "//"):
            kind, stop = "comment", text.find("\n", start)
            end = len(text) if stop < 0 else stop
        elif what == "/*":
            kind, pos = "comment", start + 2
            while True:
                edge = re.compile(r"/\*|\*/").search(text, pos)
                if edge is None or edge.group() == "*/":
                    end = len(text) if edge is None else edge.end()
                    break
                pos = edge.end()
        elif what == "<!--":
            kind, stop = "comment", text.find("-->", start + 4)
            end = len(text) if stop < 0 else stop + 3
        elif len(what) == 3:
            kind, stop = "string", text.find(what, start + 3)
            end = len(text) if stop < 0 else stop + 3
        else:
            slashes = len(re.search(r"\\*\Z", text[:start]).group())
            if slashes % 2:
                at = start + 1
                continue
            kind, pos = "string", start + 1
            limit = len(text)
            if family in RESET_FAMILIES and what != "`" and "\n" in text[start:]:
                limit = text.index("\n", start)
            while True:
                stop = text.find(what, pos, limit)
                if stop < 0:
                    end = limit
                    break
                body = text[start + 1 : stop].rpartition("\n")[2]
                if len(re.search(r"\\*\Z", body).group()) % 2 == 0:
                    end = stop + 1
                    break
                pos = stop + 1
        found.append((start, kind))
        at = max(end, start + 1)
    return found


def test_patterns_agree_with_each_other_and_with_a_scanner(spark):
    rng = random.Random(7)
    families = sorted({family for _, family, _ in LANGUAGES})
    rows = [
        (family, "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))))
        for family in families
        for _ in range(400)
    ]
    text, family = F.col("content"), F.col("family")
    tail = F.concat(text, F.lit("\n"))
    df = spark.createDataFrame(rows, "family string, content string").select(
        "*",
        lexing.tokens(text, family).alias("tokens"),
        F.transform(lexing.tokens(text, family), lambda t: lexing.token_kind(t, family)).alias("kinds"),
        lexing.marked_text(text, family).alias("marked"),
        lexing.marked_from_tokens(lexing.tokens(tail, family), family).alias("from_tokens"),
        F.transform(
            lexing.segments(text, family), lambda s: F.concat(s["code"], s["comment"])
        ).alias("segments"),
    )
    for row in df.collect():
        assert "".join(row.tokens) == row.content
        assert "".join(row.segments) == row.content
        assert row.marked == row.from_tokens, (row.family, row.content)
        assert row.marked.translate({ord(m): None for m in lexing.MARKS}) == row.content + "\n"
        raw = row.family == "c" and 'R"' in row.content
        if row.family not in ("js", "rust", "swift") and not raw:
            at, found = 0, []
            for token, kind in zip(row.tokens, row.kinds):
                if kind != "code":
                    found.append((at, kind))
                at += len(token)
            assert found == scan(row.content, row.family), (row.family, row.content)


def test_positions_over_several_blocks(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab\n") for _ in range(rng.randint(0, 4))) for _ in range(1000)]
    got = spark.createDataFrame([(texts,)], "t array<string>").select(positions(F.col("t")).alias("p")).first().p
    done = ""
    for text, place in zip(texts, got):
        assert (place.line, place.col) == (done.count("\n"), len(done.rpartition("\n")[2]))
        done += text
    empty = spark.createDataFrame([([],)], "t array<string>").select(positions(F.col("t")).alias("p"))
    assert empty.first().p == []


def test_long_texts_do_not_overflow_the_stack(spark):
    big = 'x = "' + "a\\n" * 300_000 + '"; /* ' + "b " * 300_000 + "*/ y // c"
    row = (
        spark.createDataFrame([(big, "js"), (big, "rust")], "content string, family string")
        .select(F.size(lexing.tokens(F.col("content"), F.col("family"))).alias("n"))
        .collect()
    )
    assert [r.n for r in row] == [6, 6]


def test_very_many_comments_in_one_file(spark):
    from marginalia.operators import lines

    n = 200_000
    text = "\n".join(f"x{i}(); // {i}" for i in range(n))
    files = spark.createDataFrame([("a.js", ".js", text)], "path string, ext string, content string")
    last = lines.comments(files).orderBy(F.desc("seq")).first()
    assert (last.seq, last.line_no, last.col, last.text) == (n - 1, n, len(f"x{n - 1}(); "), f"// {n - 1}")


# -- comments nested to any depth ---------------------------------------------------------
# What can begin outside a comment, for the two nesting families.
_STARTS = {
    "swift": re.compile(
        r"""(?sx) (?P<line> //[^\n]*+ ) | (?P<open> /\* )
        | (?P<string> "(?:\\[^\n]|[^"\\\n])*+(?:"|\\?(?=\n|\Z))
                    | '(?:\\[^\n]|[^'\\\n])*+(?:'|\\?(?=\n|\Z))
                    | `(?:\\.|[^`\\])*+(?:`|\\?\Z) )
        | (?P<code> (?: [^/\\"'`] | /(?![/*]) | \\[\\"'`]? )++ )"""
    ),
    "rust": re.compile(
        r"""(?sx) (?P<line> //[^\n]*+ ) | (?P<open> /\* )
        | (?P<string> "(?:\\.|[^"\\])*+(?:"|\\?\Z)
                    | '(?:\\.|[^'\\])*+(?:'|\\?\Z)
                    | `(?:\\.|[^`\\])*+(?:`|\\?\Z) )
        | (?P<code> (?: [^/\\"'`] | /(?![/*]) | \\[\\"'`]? )++ )"""
    ),
}
_EDGE = re.compile(r"/\*|\*/")


def nested_tokens(text: str, family: str) -> list[str]:
    """Tokens of one text, match by match; block comments nest to any depth."""
    out, at = [], 0
    while at < len(text):
        match = _STARTS[family].match(text, at)
        end = match.end()
        if match.lastgroup == "open":
            depth = 1
            while depth:
                edge = _EDGE.search(text, end)
                if edge is None:
                    end = len(text)
                    break
                depth += 1 if edge.group() == "/*" else -1
                end = edge.end()
        out.append(text[at:end])
        at = end
    return out


def deep_texts():
    rng = random.Random(5)
    pieces = ["/*"] * 12 + ["*/"] * 10 + ["/", "*", '"', "'", "`", "\\", "//", "\n", "a b ", " x", "*/*", "/*/", "\ufdd0\ufdd1", "\r\n"]
    for kind in range(150):
        if kind % 3 == 0:
            yield "".join(rng.choice(pieces) for _ in range(rng.randrange(400)))
        elif kind % 3 == 1:
            text = ""
            for _ in range(rng.randrange(1, 4)):
                d = rng.choice([3, 47, 48, 49, 50, 60, 120])
                text += rng.choice(['x = "/* no";\n', "'a' ", "`t\n/*` ", "// /* l\n", "y ", ""]) + "/* i " * d
                text += rng.choice(['"', "'q", "", "//"]) + " */" * rng.choice([d, d, d, d - 1]) + rng.choice([" z()", " // c\n", '"s"'])
            yield text
        else:
            yield "/*" * rng.randrange(200) + "*/" * rng.randrange(200) + ' a "/*" */ b'


def test_nested_comments_of_any_depth(spark):
    from marginalia.operators.deep_nesting import nested_tokens as in_the_plan

    rows = spark.createDataFrame([(t, f) for t in deep_texts() for f in ("swift", "rust")], "t string, f string").repartition(4)
    for tail in ("", "\n"):
        for r in rows.select("t", "f", in_the_plan(F.col("t"), F.col("f"), tail).alias("got")).collect():
            assert r.got == nested_tokens(r.t.replace("\r\n", "\n") + tail, r.f), (r.f, r.t)


def test_no_text_leaves_the_jvm(spark, files_of):
    from marginalia.operators import lines, metrics, strip

    files = files_of([("a.rs", ".rs", "x /* " + "/* " * 90 + "*/ " * 90 + "*/ y // z"), ("b.js", ".js", "a // b")])
    for out in (strip.prune(files), strip.prune(files, policy="strict"), strip.clean(files), lines.comments(files), metrics.density(files)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    got = {r.path: r.content for r in strip.prune(files, policy="strict").collect()}
    assert got == {"a.rs": "x  y", "b.js": "a"}


def test_files_that_are_not_lexed_have_no_string_over_lines(spark):
    rng = random.Random(31)
    pieces = ['"', '"a"', "'", "`", "\\", "/*", "*/", "//", "#", "<!--", "-->", "\n", "\n", "x ", 'R"(', ")", '"""', '""', "/", "\r\n"]
    texts = {"".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(1500)}
    texts |= {"".join(rng.choice(['"u#//h" ', "x\n", "# c\n", "// d\n", "/* e\n */\n", '"f"']) for _ in range(8)) for _ in range(100)}
    families = sorted({family for _, family, _ in LANGUAGES})
    rows = spark.createDataFrame([(t, f) for t in texts for f in families], "t string, f string").repartition(4)
    marked = F.split(lexing.marked_text(F.col("t"), F.col("f")), "\n")
    found = rows.select(
        "t", "f", lexing.strings_may_cross(F.col("t"), F.col("f")).alias("may"),
        F.exists(marked, lambda m: F.startswith(m, F.lit(lexing.IN_STRING))).alias("does"),
    ).collect()
    assert [(r.f, r.t) for r in found if r.does and not r.may] == []
    assert sum(not r.may for r in found) > 1000 and sum(r.does for r in found) > 1000


def test_comments_are_marked_without_looking_at_each_segment(spark):
    """Line ends inside block comments, next to each other and to line comments, at the beginning and at the end."""
    rng = random.Random(37)
    pieces = ["/* a\n b */", "/*\n\n*/", "// c\n", "/* d */", "x", "\n", "/* e\n", "*/", "\r\n", " "]
    texts = {"".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(400)} | {"/*\n", "\n/*\n*/\n"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    family = F.lit("cstyle")
    by_tokens = lexing.marked_from_tokens(lexing.tokens(F.concat("t", F.lit("\n")), family), family)
    for r in rows.select("t", lexing.marked_text(F.col("t"), family).alias("got"), by_tokens.alias("want")).collect():
        assert r.got == r.want, r.t
