"""Golden and quirk cases of stripping."""

from pyspark.sql import functions as F

from marginalia.operators import lines, strip

DEEP = "a " + "/* " * 60 + 'x // y " ' + "*/ " * 60

PRUNE = [
    ("block end with code", ".js", "/* a\n*/ code();\nx();", "x();"),
    ("block end, code, comment", ".js", "/* a\n*/ code(); // x", "*/ code();"),
    ("comment before code", ".js", "/* a */ code();\nx();", "x();"),
    ("only the last comment is cut", ".js", "x /* a */ y // b", "x /* a */ y"),
    ("only the last block is cut", ".js", "x /* a */ y /* b */ z", "x /* a */ y  z"),
    ("closing tag opens a regex", ".jsx", "<b></b>\nx // c", "<b></b>\nx // c"),
    ("blank but not empty lines go", ".js", "a\n   \n\nb", "a\n\nb"),
    ("shell count variable", ".sh", "echo $# args", "echo $"),
    ("nested comment cut at first end", ".rs", "x /* a /* b */ c */ y", "x  c */ y"),
    ("shebang anywhere", ".js", "x\n#!keep // c", "x\n#!keep // c"),
    ("mixed line ends", ".js", "a\r\nb\n", "a\r\nb\r\n"),
    ("pair inside a block", ".js", "/* x /*/ code */ y", ""),
    ("deeper than the pattern", ".rs", DEEP + "b // c", DEEP + "b"),
    ("deep, open at the end", ".swift", "a\n" + "/* " * 60 + "\nb", "a"),
    ("marks in the text", ".js", "a \ufdd0\ufdd4 b // c\n\ufdd1", "a \ufdd0\ufdd4 b\n\ufdd1"),
    ("unicode blanks", ".js", "a\u00a0 // c\n\u2003\nb", "a\nb"),
    ("regex after unicode blank", ".js", "x =\u00a0/'/; // c", "x =\u00a0/'/;"),
    ("regex after many blanks", ".js", "x =" + " " * 80 + "/'/; // c", "x =" + " " * 80 + "/'/;"),
    ("division after many blanks", ".js", "x" + " " * 80 + "/ '/' // c", "x" + " " * 80 + "/ '/'"),
    ("unknown extension", "", "x // c", "x"),
    ("apostrophe in markup", ".html", "don't <!-- a -->\nwon't <!-- b -->", "don't <!-- a -->\nwon't"),
    ("php", ".php", "# c\n// d\n/* e */\nt # f", "t"),
    (
        "whole program",
        ".ts",
        "/* Money in cents,\n   never floats. */\nlet total = 0;\nfor (const item of cart) {\n"
        "  // gifts are free\n  if (!item.gift) total += item.price; // no tax\n}\n\nbill(total);",
        "let total = 0;\nfor (const item of cart) {\n  if (!item.gift) total += item.price;\n}\n\nbill(total);",
    ),
]

CLEAN = [
    (
        "whole program",
        ".ts",
        "// ours: cents\nlet total = 0;\n/* [ds] Sums\n   the cart */\nfor (const item of cart) {\n  // ours: gifts\n"
        "  // skip gifts [ds]\n  if (!item.gift) total += item.price; // [ds] add\n}\nbill(total); // ours",
        "// ours: cents\nlet total = 0;\nfor (const item of cart) {\n  // ours: gifts\n"
        "  if (!item.gift) total += item.price;\n}\nbill(total); // ours",
    ),
    ("tag in a string", ".js", 'const x = "[ds]"; // human', 'const x = "[ds]";'),
    ("a quote that never closes", ".py", "label = 'half\n# gone? [ds]", "label = 'half\n# gone? [ds]"),
    ("text over lines", ".sh", "mail \"dear\n# list [ds]\nbye\"", "mail \"dear\n# list [ds]\nbye\""),
    ("no tag, mixed line ends", ".js", "a // x\r\nb\n", "a // x\r\nb\r\n"),
    ("tag marks the whole human block", ".js", "/* mine\n// x [ds]\n more */\na", "a"),
]

STRICT = [
    ("code after a block end", ".js", "/* a\n*/ code();\nx();", " code();\nx();"),
    ("all comments of a line", ".js", "x /* a */ y // b", "x  y"),
    ("nested", ".rs", "x /* a /* b */ c */ y", "x  y"),
    ("words kept apart", ".js", "return/* a */x", "return x"),
    ("string with blank line", ".js", "a = `\n   \n`; // c", "a = `\n   \n`;"),
    ("shebang", ".sh", "#!/bin/sh\n# c\nx", "#!/bin/sh\nx"),
    ("only comments", ".js", "// a\n/* b\n*/", ""),
    ("marks in the text", ".js", "\ufdd4 \ufdd3! b // c", "\ufdd4 \ufdd3! b"),
    ("deep", ".rs", DEEP + "b // c", "a  b"),
    ("crlf", ".js", "a // b\r\n// c\r\nd", "a\r\nd"),
]


def check(spark, cases, rewrite):
    rows = [(name, ext, content, want) for name, ext, content, want in cases]
    files = spark.createDataFrame(rows, "path string, ext string, content string, want string")
    got = {r.path: r.got for r in rewrite(files).collect()}
    assert got == {name: want for name, _, _, want in cases}


def test_prune(spark):
    check(spark, PRUNE, lambda f: strip.prune(f, output="got"))


def test_clean(spark):
    check(spark, CLEAN, lambda f: strip.clean(f, output="got"))


def test_strict(spark):
    check(spark, STRICT, lambda f: strip.prune(f, policy="strict", output="got"))


def test_explicit_deletions_and_refusal(spark, files_of):
    files = files_of([("a", ".js", "open();\n// wait\nclose();")])
    asked = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 9)], "path string, line bigint")
    out, refused = strip.apply_deletions(files, asked)
    assert out.first().content == "open();\nclose();"
    assert [tuple(r) for r in refused.collect()] == [("a", 1, "open();")]


def test_tokens_lose_nothing(spark):
    cases = PRUNE + [(f"c{i}", *c[1:]) for i, c in enumerate(CLEAN)]
    files = spark.createDataFrame(cases, "path string, ext string, content string, want string")
    joined = (
        lines.to_tokens(files)
        .groupBy("path")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("t"))
        .select("path", F.array_join(F.transform("t", lambda x: x["text"]), "").alias("joined"))
    )
    for row in joined.join(files, "path").collect():
        assert row.joined == row.content.replace("\r\n", "\n")


def test_prune_twice_changes_nothing_more(spark):
    stable = [c for c in PRUNE if c[0] not in ("block end, code, comment", "only the last comment is cut",
              "only the last block is cut", "nested comment cut at first end", "deeper than the pattern")]
    files = spark.createDataFrame(stable, "path string, ext string, content string, want string")
    once = strip.prune(files)
    assert strip.prune(once, output="again").where("again != content").count() == 0
