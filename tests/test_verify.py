"""Checks of rewritten files against plain comparisons."""

import random

from marginalia.operators import lines, reduction, splice, strip, verify
from marginalia.operators.reduction import key_bitmaps, possibly_in, with_possibly_in

FILES = "path string, ext string, content string"
LINES = "path string, out_line int, orig_line int, text string"


def brute_violations(files, out):
    """Lines of mode splice, one against one."""
    source = {path: content.replace("\r\n", "\n").split("\n") for path, _, content in files}
    found = []
    for path, out_line, orig_line, text in out:
        lines = source.get(path, [])
        was = lines[orig_line - 1] if orig_line and 1 <= orig_line <= len(lines) else None
        if orig_line is not None and (text is None or text != was):
            found.append((path, out_line, orig_line, text, was))
    return sorted(found, key=repr)


def test_changed_lines_are_those_of_a_plain_comparison(spark):
    rng = random.Random(5)
    files = [(f"f{i}", ".js", "\r\n".join(rng.choice(["a", "", "é", "x" * 3000]) for _ in range(i % 9 + 1))) for i in range(30)]
    out = []
    for path, _, content in files:
        lines = content.split("\r\n")
        for n, text in enumerate(lines, 1):
            out.append((path, n, n, rng.choice([text] * 9 + [text + "!", None, ""])))
    out += [("f1", 90, 90, "beyond"), ("gone", 1, 1, "a"), (None, 1, 1, "a"), ("f2", 7, None, "inserted")]
    out += [("f3", 8, 1, "twice"), ("f3", 8, 1, "twice")]
    got = verify.verify_lines(spark.createDataFrame(files, FILES), spark.createDataFrame(out, LINES))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_violations(files, out)


def test_clean_lines_may_lose_their_comment(spark):
    files = spark.createDataFrame([("f", ".js", "a(); // [ds] b\nc(); // d")], FILES)
    kept = strip.stripped_lines(files, tag="[ds]")
    assert verify.verify_lines(files, kept, mode="clean").count() == 0
    out = spark.createDataFrame([("f", 1, 1, "a();"), ("f", 2, 2, "c();")], LINES)
    assert [r.out_line for r in verify.verify_lines(files, out, mode="clean").collect()] == [2]
    assert verify.verify_lines(files, out, mode="prune").count() == 0


def test_no_line_text_is_shuffled_unless_it_is_a_violation(spark):
    """One wrong line among many long ones: what crosses the shuffles is digests and that line."""
    n = 20_000
    lines = spark.range(1, n + 1).selectExpr("id", "concat(id, repeat(uuid(), 5)) AS text").collect()
    content = "\n".join(r.text for r in lines)
    files = spark.createDataFrame([("f", ".js", content)], FILES)
    out = spark.createDataFrame([("f", i, i, r.text + "!" * (i == 777)) for i, r in enumerate(lines, 1)], LINES)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = verify.verify_lines(files, out)
        assert [(r.out_line, r.source) for r in found.collect()] == [(777, lines[776].text)]
        sizes, plans = [], [found._jdf.queryExecution().executedPlan()]
        while plans:
            plan = plans.pop()
            plans += [plan.children().apply(i) for i in range(plan.children().size())]
            if plan.nodeName().endswith("AdaptiveSparkPlan"):
                plans.append(plan.executedPlan())
            if plan.nodeName().endswith("QueryStage"):
                plans.append(plan.plan())
            if plan.nodeName() == "Exchange":
                sizes.append(plan.metrics().apply("dataSize").value())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # digests take 100 bytes a line at most, on either side; the lines have 180 characters and more
    assert sizes and sum(sizes) < 2 * n * 100


def test_lines_are_not_gathered_in_the_driver_nor_their_making_repeated(spark, monkeypatch):
    """Files of a table of few bytes have many lines: the engine takes them for few, and would broadcast them."""
    n, unlike, key_bitmaps = 3000, [], verify.key_bitmaps

    def seen(rows, *keys):
        unlike.append(rows)
        return key_bitmaps(rows, *keys)

    monkeypatch.setattr(verify, "key_bitmaps", seen)
    files = spark.range(n).selectExpr("concat('f', id) AS path", "'.js' AS ext", "repeat('a();\n', 20) AS content")
    out = strip.stripped_lines(files).selectExpr(
        "path", "out_line", "orig_line", "CASE WHEN path = 'f7' AND orig_line = 3 THEN 'b' ELSE text END AS text"
    )
    found = verify.verify_lines(files, out, mode="prune")
    plans = [found._jdf.queryExecution(), unlike[0]._jdf.queryExecution()]
    assert "Broadcast" not in plans[1].executedPlan().toString()
    for plan in plans:
        joins = [line for line in plan.executedPlan().toString().split("\n") if "Join" in line]
        assert [line for line in joins if "orig_line" in line.partition("[")[2].partition("]")[0] and "SortMerge" in line]
        # either side is lexed once in a plan
        assert plan.optimizedPlan().toString().count("Range (") == 2
    assert [tuple(r) for r in found.collect()] == [("f7", 3, 3, "b", "a();")]


def test_without_wrong_lines_nothing_is_read_again(spark):
    files = spark.createDataFrame([("f", ".js", "a(); // b\n\nc();"), (None, ".js", "d();"), ("n", ".js", None)], FILES)
    out = strip.stripped_lines(files).where("path IS NOT NULL")
    found = verify.verify_lines(files, out, mode="prune")
    assert found.schema.simpleString() == "struct<path:string,out_line:int,orig_line:int,text:string,source:string>"
    assert "ExistingRDD" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.collect() == []


def test_flags_of_files_in_the_row_and_by_join(spark):
    files = spark.createDataFrame(
        [("bad", ".py", "x = 1"), ("good", ".py", "x = 1"), ("unnamed", ".py", ""), ("empty", ".py", "")], FILES
    )
    asked = [("bad", 0, 1, "# a\nboom()"), ("good", 0, 1, "# a"), ("empty", 0, 1, "# a"), ("none", 0, 1, "boom()")]
    suggestions = spark.createDataFrame(asked, "path string, idx bigint, line bigint, comment string")
    want = [("bad", True), ("empty", False), ("good", False), ("unnamed", False)]
    found = verify.payload_audit(files, suggestions)
    for flagged in (verify.audit_flags(files, suggestions), verify.flag_violations(files, found)):
        assert flagged.columns == [*files.columns, "bad"]
        assert sorted((r.path, r.bad) for r in flagged.collect()) == want
    good, bad = verify.quarantine(files, found)
    assert [r.path for r in bad.collect()] == ["bad"] and good.count() == 3


def test_no_filter_repeats_the_audit_or_the_merge(spark):
    files = spark.createDataFrame([("a", ".py", "x = 1")], FILES)
    suggestions = spark.createDataFrame([("a", 0, 1, "# a\nboom()")], "path string, idx bigint, line bigint, comment string")
    for rows in (verify.payload_audit(files, suggestions), splice.spliced_lines(files, suggestions)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString().split("\n")
        assert any("zip_with(" in line for line in plan)
        assert not [line for line in plan if "Filter" in line and "zip_with(" in line]
    assert [r.text for r in verify.payload_audit(files, suggestions).collect()] == ["boom()"]


def test_reduction_loses_no_partner(spark):
    rng = random.Random(9)
    left = [(rng.choice(["a", "b", None]), rng.choice([None, *range(500)])) for _ in range(2000)]
    right = [(rng.choice(["a", "b", None]), rng.choice([None, *range(40)])) for _ in range(60)]
    rows = spark.createDataFrame(left, "p string, n bigint").coalesce(1)
    bitmaps = key_bitmaps(spark.createDataFrame(right, "p string, n bigint"), ["p", "n"])
    got = [tuple(r) for r in possibly_in(rows, bitmaps, ["p", "n"]).collect()]
    wanted = [r for r in left if r in set(right)]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)  # 60 keys in 2^25 places: no other row, as it happens
    flags = with_possibly_in(rows, bitmaps, ["p", "n"], "may").collect()
    assert len(flags) == len(left) and sorted(((r.p, r.n) for r in flags if r.may), key=repr) == sorted(wanted, key=repr)
    none = key_bitmaps(rows.limit(0), ["p", "n"])
    assert possibly_in(rows, none, ["p", "n"]).count() == 0
    assert with_possibly_in(rows, none, ["p", "n"], "may").where("may").count() == 0


def test_lines_that_come_through_the_bitmaps_by_chance(spark, monkeypatch):
    """With one small bitmap many lines of good files are taken for violations at first, and their files are not."""
    monkeypatch.setattr(reduction, "BITMAPS", 1)
    n = 3000
    files = spark.range(2 * n).selectExpr("concat('f', id) AS path", "'.js' AS ext", "repeat('a\\n', 10) AS content")
    lines = files.selectExpr("path", "posexplode(split(content, '\\n')) AS (pos, text)")
    bad = "pos = 3 AND int(substr(path, 2)) % 2 = 0"
    out = lines.selectExpr("path", "pos + 1 AS out_line", "pos + 1 AS orig_line", f"CASE WHEN {bad} THEN 'b' ELSE text END AS text")
    found = verify.verify_lines(files, out).collect()
    assert len(found) == n and {(r.orig_line, r.text, r.source) for r in found} == {(4, "b", "a")}


def test_audit_agrees_with_the_lines_of_the_new_text(spark):
    """Also where an inserted line ends with a CR, which is part of its line end in the new text."""
    bodies = ["// a", "/*\r\r\n b\r\r\n*/", "x()\r\r\ny()", "# c", "/* d\n\n*/ e()", "/* f", "// g\r\r\n// h"]
    cases = [(f"{i}{ext}{len(eol)}", ext, f"a();{eol}  b = '{eol}';", body)
             for i, body in enumerate(bodies) for ext in (".js", ".py", ".java") for eol in ("\n", "\r\n")]
    files = spark.createDataFrame([c[:3] for c in cases], "path string, ext string, content string")
    rows = [(c[0], 0, line, c[3]) for c in cases for line in (1, 2)]
    suggestions = spark.createDataFrame(rows, "path string, idx bigint, line bigint, comment string")
    state = lines.line_state(splice.splice(files, suggestions)).where("text IS NOT NULL AND NOT is_pure_comment")
    new = splice.spliced_lines(files, suggestions).where("orig_line IS NULL").withColumnRenamed("out_line", "line_no")
    want = {(r.path, r.line_no) for r in new.join(state, ["path", "line_no"]).collect()}
    got = {(r.path, r.out_line) for r in verify.payload_audit(files, suggestions).collect()}
    assert got == want and len(want) > 10
    assert {r.path for r in verify.audit_flags(files, suggestions).where("bad").collect()} == {p for p, _ in want}
