import datetime as dt
import json

from pyspark.sql import functions as F

from marginalia.plans.registry import QUERIES
from marginalia.operators import changes, metrics, prompts, responses


def envelope(provider, text):
    if provider == "gemini":
        return json.dumps({"candidates": [{"content": {"parts": [{"text": text}]}}]})
    if provider == "claude":
        return json.dumps({"content": [{"text": text}]})
    return json.dumps({"choices": [{"message": {"content": text}}]})


def test_verdicts(spark):
    good = '{"line": 1, "comment": "// a"}'
    cases = {
        "parts": ("gemini", envelope("gemini", '[{"line": 3, "comment": "// opens the valve"}]'), None, 1),
        "choices": ("groq", envelope("groq", '[{"line": 8, "comment": "/* litres */"}, {"line": 1, "comment": "# top"}]'), None, 2),
        "falsy errors": ("groq", envelope("groq", "[]")[:-1] + ', "error": ""}', None, 0),
        "zero error": ("groq", envelope("groq", "[]")[:-1] + ', "error": 0}', None, 0),
        "false error": ("groq", envelope("groq", "[]")[:-1] + ', "error": false}', None, 0),
        "true error": ("groq", envelope("groq", "[]")[:-1] + ', "error": true}', "api_error", 0),
        "empty object error": ("groq", envelope("groq", "[]")[:-1] + ', "error": {}}', "api_error", 0),
        "a key twice": ("groq", envelope("groq", '[{"line": 0, "line": 2, "comment": "x", "comment": "// a"}]'), None, 1),
        "claude fenced": ("claude", envelope("claude", f"```json\n[{good}]\n```"), None, 1),
        "empty": ("groq", envelope("groq", "[]"), None, 0),
        "whole decimal": ("groq", envelope("groq", '[{"line": 4.0, "comment": "# a"}]'), None, 1),
        "exponent": ("groq", envelope("groq", '[{"line": 1e2, "comment": "-- a"}]'), None, 1),
        "huge": ("groq", envelope("groq", '[{"line": 1e300, "comment": "-- a"}]'), None, 1),
        "error wins": ("groq", '{"error": {"message": "quota"}}', "api_error", 0),
        "null error": ("groq", envelope("groq", f"[{good}]")[:-1] + ', "error": null}', None, 1),
        "no text": ("gemini", envelope("groq", "[]"), "no_text", 0),
        "broken envelope": ("groq", "{", "bad_envelope", 0),
        "prose bracket": ("groq", envelope("groq", f"see [1]: [{good}]"), "not_json", 0),
        "object": ("groq", envelope("groq", good), "not_array", 0),
        "number element": ("groq", envelope("groq", f"[{good}, 7]"), "not_object", 0),
        "array element": ("groq", envelope("groq", "[[1]]"), "bad_line", 0),
        "text line": ("groq", envelope("groq", '[{"line": "3", "comment": "// a"}]'), "bad_line", 0),
        "fraction": ("groq", envelope("groq", '[{"line": 1.5, "comment": "// a"}]'), "bad_line", 0),
        "first error counts": ("groq", envelope("groq", '[{"line": 1}, {"line": 0, "comment": "// a"}]'), "bad_comment", 0),
        "no marker": ("groq", envelope("groq", '[{"line": 1, "comment": "a"}]'), "bad_marker", 0),
    }
    rows = [(name, provider, body) for name, (provider, body, _, _) in cases.items()]
    df = spark.createDataFrame(rows, "path string, provider string, body string")
    got = {r.path: r.err for r in responses.checked_items(df).collect()}
    assert got == {name: c[2] for name, c in cases.items()}
    far = responses.accepted_items(df).where("path = 'huge'").first()
    assert far.line is None and responses.response_items(df).where("past_any_file").count() == 1
    taken = {r.path: r.n for r in responses.accepted_items(df).groupBy("path").agg(F.count("*").alias("n")).collect()}
    assert taken == {name: c[3] for name, c in cases.items() if c[3]}


def test_delete_action_in_clean_mode(spark):
    rows = [("a", "x", envelope("x", '[{"line": 2, "action": "delete"}]')), ("b", "x", envelope("x", '[{"line": 2, "comment": "// a"}]'))]
    df = spark.createDataFrame(rows, "path string, provider string, body string")
    got = {r.path: r.err for r in responses.checked_items(df, "clean").collect()}
    assert got == {"a": None, "b": "bad_action"}


def test_request_outcomes(spark):
    log = [
        (1, 0, 200, None), (2, 0, 503, "busy"), (2, 1, None, "timeout"), (2, 2, 429, "slow"),
        (3, 0, 500, "x"), (3, 1, 404, "gone"), (4, 0, 429, "slow"), (5, 0, 200, None), (5, 1, 500, "late"),
        (6, 3, 200, None), (6, None, 200, None), (2, 7, 200, None),
    ]
    df = spark.createDataFrame(log, "request_id bigint, attempt int, status int, error string")
    got = {r.request_id: (r.attempts_used, r.outcome, r.status, r.waited_ms, r.n_extra) for r in responses.request_outcomes(df).collect()}
    assert got == {
        1: (1, "done", 200, 0, 0),
        2: (3, "failed", 429, 3000, 1),
        3: (2, "returned", 404, 1000, 0),
        4: (1, "pending", 429, 0, 0),
        5: (1, "done", 200, 0, 0),
        6: (0, "pending", None, 0, 2),
    }


def test_change_kinds(spark):
    day = dt.datetime(2024, 1, 1)
    texts = ["a(); // x", "a(); // y", "b();", "", "b();", "b();\n", "b();"]
    rows = [("p", ".js", i, day + dt.timedelta(hours=i * 13), "m", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "path string, ext string, commit_id bigint, commit_ts timestamp, message string, content string")
    kinds = [r.kind for r in changes.change_kind(df).orderBy("commit_id").collect()]
    assert kinds == ["new", "comment_only", "code", "code", "code", "code", "code"]
    assert changes.change_kind(df, force=True).where("skipped").count() == 0
    # bucket width must not matter
    for seconds in (1, 3600, 10**9):
        lagged = changes.with_previous(df, ["content"], seconds).orderBy("commit_id").collect()
        assert [r.prev_content for r in lagged] == [None, *texts[:-1]]


def test_run_summary_fails_only_without_success(spark):
    for statuses, failed in ((["ok", "error"], False), (["error"], True), (["skipped_empty"], False)):
        log = spark.createDataFrame([("p", s) for s in statuses], "path string, status string")
        assert metrics.run_summary(log).first().failed is failed


def test_target_bands(spark):
    row = spark.range(1).select(
        metrics.in_target_band(F.lit(0.15), F.lit("light")).alias("a"),
        metrics.in_target_band(F.lit(0.5), F.lit("default")).alias("b"),
    ).first()
    assert (row.a, row.b) == (True, False)


def test_commit_selection(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [
        ("a/B.PY", "x", 1, day, "m", "a()"), ("a/b.js", ".js", 1, day, "m", "a()"), ("a/b.js", ".js", 2, day + dt.timedelta(days=3), "m", None),
        ("a/b.js", ".js", 3, day + dt.timedelta(days=9), "m", "a()"), ("a/B.PY", "x", 3, day + dt.timedelta(days=9), "m", "a() # c"),
    ]
    rows += [rows[0], rows[3], rows[3], rows[4]]  # delivered again
    df = spark.createDataFrame(rows, "path string, ext string, commit_id bigint, commit_ts timestamp, message string, content string").repartition(3)
    found = [((r.path, r.commit_id), r.kind) for r in changes.to_annotate(df).collect()]
    kinds = dict(found)
    assert len(found) == len(kinds) and kinds == {("a/B.PY", 1): "new", ("a/b.js", 1): "new", ("a/b.js", 3): "new"}
    for commit in (None, 3):
        got = changes.changed_files(df, commit).collect()
        assert len(got) == (2 if commit else 5)
        want = {("a/b.js", 3): None, ("a/B.PY", 3): "a()"}
        if commit is None:
            want |= {("a/B.PY", 1): None, ("a/b.js", 1): None, ("a/b.js", 2): "a()"}
        assert {(r.path, r.commit_id): r.prev_content for r in got} == want


def scans_and_exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    return plan.count("FileScan parquet"), plan.count("Exchange hashpartitioning"), plan


def test_tables_are_read_once(spark):
    """The history is a union of three selections of one table, suggestions of two."""
    scans, _, _ = scans_and_exchanges(QUERIES["changed_files"](spark, "/root/testdata/sf0.001"))
    assert scans == 3
    scans, _, plan = scans_and_exchanges(QUERIES["insertable_suggestions"](spark, "/root/testdata/sf0.001"))
    assert scans == 3


def test_the_text_of_a_prompt_is_made_once(spark, files_of):
    built = prompts.build_prompts(files_of([("a.js", ".js", "x\ny")]))
    plan = built.select("prompt")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Suggest comments for the source file") <= 1
    assert built.first().prompt.endswith("1: x\n2: y")
