import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from marginalia.operators import metrics
from marginalia.plans import annotate
from marginalia.sources import files as io
from marginalia.sources import ignore
from marginalia.sources.corpora import corpus
from marginalia.streaming import revisions


@pytest.fixture
def tree(tmp_path):
    content = {
        "a/x.js": b"x // c\n",
        "a/B.PY": b"# c\nok\xff\n",
        "a/note.md": b"# no\n",
        "a/.js": b"no\n",
        "a/node_modules/y.js": b"y\n",
        "a/blank.go": b" \n",
        "a/gen_skip.ts": b"z\n",
    }
    for name, data in content.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / "ignore.txt").write_text("# ours\n *_skip.ts \n")
    return tmp_path


def test_scan_write_back_and_summary(spark, tree):
    found = io.scan_source_tree(spark, str(tree / "a"), str(tree / "ignore.txt"))
    names = {r.path.rsplit("/", 1)[1]: r.content for r in found.collect()}
    assert names == {"x.js": "x // c\n", "B.PY": "# c\nok\ufffd\n"}
    changed = annotate.annotate_files(found, annotate.offline_annotator)
    summary = metrics.run_summary(io.write_tree(changed)).first()
    assert (summary.n_ok, summary.n_error) == (2, 0)
    assert (tree / "a/x.js").read_text() == "// 2 lines [ds]\nx // c\n"
    assert not list((tree / "a").glob("*.tmp"))
    io.write_files(found, str(tree / "v1"))
    first = {r.path: r.content for r in spark.read.parquet(str(tree / "v1")).collect()}
    one = found.where("path LIKE '%x.js'").selectExpr("path", "ext", "'new' AS content")
    io.write_files(one, str(tree / "v2"), previous=str(tree / "v1"))
    second = {r.path: r.content for r in spark.read.parquet(str(tree / "v2")).collect()}
    assert second == {path: "new" if path.endswith("x.js") else text for path, text in first.items()}


def test_a_root_below_an_ignored_name_in_any_form(spark, tmp_path):
    (tmp_path / "build" / "src").mkdir(parents=True)
    (tmp_path / "build" / "src" / "a.js").write_text("a")
    for root in (str(tmp_path / "build" / "src"), f"file://{tmp_path}/build/src", f"file:{tmp_path}/build/src/"):
        assert io.scan_source_tree(spark, root).count() == 1


def test_ignore_rule(spark, files_of):
    paths = ["r/dist/a.js", "r/src/a.min.js", "r/src/a.js", "r/x\\/a.js", "/abs/out/a.js", "/abs/ok/a.js"]
    files = files_of([(p, ".js", "x") for p in paths])
    user = spark.createDataFrame([("*.min.js",), ("src2/",)], "value string")
    patterns = ignore.ignore_patterns(spark, user)
    kept = sorted(r.path for r in ignore.drop_ignored(files, patterns).collect())
    assert kept == sorted(["r/src/a.js", "r/x\\/a.js", "/abs/ok/a.js"])
    assert ignore.drop_ignored(files_of([(None, ".js", "x")]), patterns).count() == 1


def test_every_file_is_asked_about_once_and_faults_stay_out(spark, files_of):
    asked = spark.sparkContext.accumulator(0)

    def annotator(prompts):
        asked.add(len(prompts))
        return ['{"error": {"message": "no"}}' if "bad" in p.split("\n")[0] else annotate.offline_annotator([p])[0] for p in prompts]

    files = files_of([(f"f{i}.rs", ".rs", "a /* /* b */ */ c") for i in range(20)] + [("bad.js", ".js", "a // c")])
    out = annotate.annotate_files(files, annotator)
    rows = {r.path: r for r in out.collect()}
    assert asked.value == 21
    assert rows["bad.js"].err == "api_error" and rows["bad.js"].content == "a // c"
    assert rows["f3.rs"].content == "// 1 lines [ds]\na /* /* b */ */ c"
    assert annotate.accepted(out).count() == 20


def told(spark, tmp_path, waves, **how):
    """{commit_id: kind} of waves of (commit_id, hours, text or None[, path])."""
    day = dt.datetime(2024, 1, 1)
    for wave in waves:
        rows = [(*(p or ["p"]), ".js", c, day + dt.timedelta(hours=h), "m", t) for c, h, t, *p in wave]
        spark.createDataFrame(rows, io.REVISIONS_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = revisions.revision_stream(spark, str(tmp_path / "in"))
        revisions.drain_change_kinds(stream, str(tmp_path / "out"), str(tmp_path / "work"), **how)
    rows = revisions.read_change_kinds(spark, str(tmp_path / "out")).collect()
    assert len({r.commit_id for r in rows}) == len(rows)
    return {r.commit_id: r.kind for r in rows}


def test_late_revisions_and_return_to_old_code(spark, tmp_path):
    batches = [[(1, 1, "a();"), (2, 2, "b();")], [(3, 3, "a();"), (4, 4, "a(); // c")], [(5, 2, "z();")]]
    assert told(spark, tmp_path, batches) == {1: "new", 2: "code", 3: "code", 4: "comment_only", 5: "late"}


def test_a_batch_that_is_late_in_part(spark, tmp_path):
    """The one before the first revision in time is the newest seen, not a late one of the same batch."""
    batches = [
        [(1, 5, "a();"), (1, 5, "a();"), (2, 6, "b();"), (20, 1, "q();", "q")],
        [(3, 1, "c();"), (4, 7, "b(); // same"), (5, 2, "c();"), (6, 8, None), (7, 9, ""), (8, 10, "")],
        [(9, 10, "x();"), (21, 1, "q(); // more", "q"), (22, 1, "r();", "r")],
    ]
    want = {1: "new", 2: "code", 20: "new", 3: "late", 5: "late", 4: "comment_only", 6: "deleted", 7: "new", 8: "code"}
    assert told(spark, tmp_path, batches) == want | {9: "code", 21: "comment_only", 22: "new"}


def test_idle_paths_leave_the_state_and_come_back_as_new(spark, tmp_path):
    day = 24
    batches = [
        [(1, 0, "a();"), (2, 1, "a(); // c"), (10, 0, "b();", "q")],
        [(3, 31 * day + 2, "a();"), (11, 29 * day, "b(); // c", "q")],  # p was idle for longer than 30 days, q not
        [(4, 80 * day, "a();"), (5, 81 * day, "a(); // d")],
        [(12, 82 * day, "b();", "q"), (13, 5 * day, "z();", "z")],  # q is gone by now; z is far behind all others
        [(6, 82 * day, "a();"), (14, 83 * day, "b(); // e", "q")],
    ]
    got = told(spark, tmp_path, batches, ttl="30 days", delay="1 day")
    want = {1: "new", 2: "comment_only", 10: "new", 3: "new", 11: "comment_only", 4: "new", 5: "comment_only"}
    assert got == want | {12: "new", 13: "late", 6: "comment_only", 14: "comment_only"}
    late = revisions.late_counts(revisions.read_change_kinds(spark, str(tmp_path / "out"))).where("n_late > 0").collect()
    assert [(r.day, r.n_revisions, r.n_late) for r in late] == [(dt.datetime(2024, 1, 6), 1, 1)]


def test_a_hot_path_is_spread_over_tasks(spark, tmp_path):
    """One path holds nearly all revisions of a micro-batch; one row of it meets the state."""
    n = 100_000
    rows = spark.range(n).selectExpr(
        "CASE WHEN id % 50 = 49 THEN concat('q', id) ELSE 'p' END AS path", "'.js' AS ext", "id AS commit_id",
        "timestamp_seconds(id * 30) AS commit_ts", "'m' AS message",
        "CASE WHEN id % 10 = 9 THEN NULL ELSE concat('a', id DIV 5, '(); // ', id) END AS content",
    )
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = revisions.revision_stream(spark, str(tmp_path / "in"))
    revisions.drain_change_kinds(stream, str(tmp_path / "out"), str(tmp_path / "work"))
    hot = revisions.read_change_kinds(spark, str(tmp_path / "out")).where("path = 'p'")
    got = {r.kind: r.n for r in hot.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    # of ten in a row: new after a deletion, four comments, other code, three comments, a deletion, which is
    # missing in every fifth ten: then the next, if there is one, is other code
    tens, missing = n // 10, n // 50
    assert got == {"new": tens - missing + 1, "comment_only": 7 * tens, "code": tens + missing - 1, "deleted": tens - missing}
    edges = spark.read.parquet(str(tmp_path / "work" / "edges" / "*"))
    assert edges.where("path = 'p'").count() == 1 and edges.count() == n // 50 + 1
    # the lag runs in groups of an hour of commits: 120 rows at most
    plan = revisions._in_order(spark.read.parquet(str(tmp_path / "in")))._jdf.queryExecution().executedPlan().toString()
    assert "__slot" in plan and "__group" in plan


def test_what_is_known_of_paths_is_not_broadcast(spark):
    """There may be as many paths as rows, and compressed files tell little of their size."""
    rows = spark.createDataFrame(
        [("p", ".js", 1, dt.datetime(2024, 1, 1), "m", "d", False)],
        "path string, ext string, commit_id bigint, commit_ts timestamp, message string, digest string, is_empty boolean",
    )
    known = spark.createDataFrame([("p", None, None, True)], revisions._NEWEST)
    plan = revisions._kinds(revisions._in_order(rows), known, None)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "Generate" not in plan


def test_files_made_of_a_small_table_are_spread_over_tasks(spark):
    """20,000 rows of one small file are files that two tasks lex."""
    assert corpus(spark, "/root/testdata/sf0.1", "src_part").rdd.getNumPartitions() == 2


def test_only_what_is_looked_at_is_opened(spark, tree):
    """Paths are filtered before any file is opened, and no content is shuffled."""
    (tree / "a" / "dist").mkdir()
    (tree / "a" / "dist" / "gone.js").symlink_to(tree / "a" / "x.js")
    (tree / "a" / "with blank #%20.js").write_text("kept")
    found = io.scan_source_tree(spark, str(tree / "a"), str(tree / "ignore.txt"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan[plan.index("ReadSchema") :].split("\n")[0] and "Exchange hash" not in plan
    for path in (tree / "a").rglob("*.*"):
        os.utime(path, (0, path.stat().st_mtime))  # reading sets the time of access
    names = {r.path.rsplit("/", 1)[1]: r.content for r in found.collect()}
    assert names == {"x.js": "x // c\n", "B.PY": "# c\nok\ufffd\n", "with blank #%20.js": "kept"}
    opened = {path.name for path in (tree / "a").rglob("*.*") if path.stat().st_atime > 0}
    assert opened <= {*names, "blank.go", "gone.js"}  # the last one is a link to x.js


@pytest.mark.parametrize("max_in_row", [10_000, 2])
def test_ignore_rule_in_the_row_and_by_joins(spark, files_of, max_in_row):
    paths = ["r/dist/a.js", "r/src/a.min.js", "r/a.js", "r/x/a.js", "/abs/out/a.js", "q/y\\/a.js", "é*/a.js", "", None, "dist"]
    files = files_of([(p, ".js", "x") for p in paths])
    for lines, kept in [
        (["dist/", "out\\/", "*.min.js", "x"], ["r/a.js", "q/y\\/a.js", "é*/a.js", "", None]),
        (["y\\", "y\\/", "*", "zz"], [None]),
        (["/", "\\/", "é*", "dist"], ["r/src/a.min.js", "r/a.js", "r/x/a.js", "/abs/out/a.js", "q/y\\/a.js", "", None]),
        ([], paths),
    ]:
        patterns = spark.createDataFrame([(x,) for x in lines], "pattern string")
        got = [r.path for r in ignore.drop_ignored(files, patterns, max_in_row=max_in_row).collect()]
        assert sorted(got, key=str) == sorted(kept, key=str), lines


def test_requests_are_tried_again_and_fail_by_themselves(spark):
    calls = spark.sparkContext.accumulator(0)
    seen = {}

    def annotator(texts):
        calls.add(len(texts))
        if len(texts) > 1:
            raise ValueError("too many")  # any error of a batch: each prompt is asked by itself
        (text,) = texts
        seen[text] = seen.get(text, 0) + 1
        if text == "refused":
            raise annotate.Refused(400, "no")
        if text.startswith("busy") and seen[text] < int(text[-1]):
            raise annotate.Refused(429)
        if text == "silent":
            return [None]
        if text == "broken":
            raise OSError("connection lost")
        return [f"answer to {text}"]

    texts = ["fine", "refused", "busy2", "busy3", "busy4", "silent", "broken", None]
    rows = spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], "path string, prompt string").coalesce(1)
    got = {r.path: r for r in annotate.ask(rows, annotator, retry=annotate.Retry(3, 1)).collect()}
    told = {t: (got[f"p{i}"].body, [a.status for a in got[f"p{i}"].attempts], got[f"p{i}"].error) for i, t in enumerate(texts)}
    assert told["fine"] == ("answer to fine", [200], None) and told[None][0] == "answer to "
    assert told["refused"] == (None, [400], "no")
    assert told["busy2"][:2] == ("answer to busy2", [429, 200]) and told["busy3"][:2] == ("answer to busy3", [429, 429, 200])
    assert told["busy4"] == (None, [429] * 3, "Refused")
    assert told["silent"] == (None, [None] * 3, "no answer") and told["broken"] == (None, [None] * 3, "connection lost")


def test_a_second_run_asks_only_what_has_no_answer(spark, files_of, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def failing(names):
        def annotator(texts):
            if any(f"source file {name}." in t for t in texts for name in names):
                raise annotate.Refused(500, "down")
            asked.add(len(texts))
            return annotate.offline_annotator(texts)

        return annotator

    cases = [(f"d/f{i}.js", ".js", f"a({i});") for i in range(30)] + [("other/f1.js", ".js", "a(1);"), ("third/f1.js", ".js", "a(1);")]
    files, retry, ledger = files_of(cases).repartition(4), annotate.Retry(2, 1), str(tmp_path / "ledger")
    down = [f"f{i}.js" for i in range(0, 30, 4)]
    plan = annotate.annotate_files(files, failing(down), retry=retry, ledger=ledger)
    first = {r.path: r for r in plan.collect()}
    assert {p for p, r in first.items() if r.err == "request_failed"} == {f"d/{n}" for n in down}
    assert asked.value == 22  # equal prompts once, and an action on the result asks nothing
    plan.count()
    second = annotate.annotate_files(files, failing([]), retry=retry, ledger=ledger)
    assert asked.value == 30 and second.where("err IS NOT NULL").count() == 0
    plain = annotate.annotate_files(files, annotate.offline_annotator)
    assert sorted(map(tuple, second.collect())) == sorted(map(tuple, plain.collect()))
    third = annotate.annotate_files(files, failing([n for _, n in []] + ["f1.js"]), retry=retry, ledger=ledger)
    assert third.where("err IS NOT NULL").count() == 0 and asked.value == 30


def test_answers_outlive_a_run_that_breaks_off(spark, tmp_path, monkeypatch):
    """Waves of prompts are put down one by one; the next run asks for the rest."""
    prompts = spark.createDataFrame([(str(i), f"p{i}") for i in range(50)], "path string, prompt string")
    ledger, real, waves = str(tmp_path / "ledger"), annotate.ask, []

    def breaking(*args):
        if len(waves) == 2:
            raise RuntimeError("driver lost")
        waves.append(1)
        return real(*args)

    upper = lambda texts: [t.upper() for t in texts]
    monkeypatch.setattr(annotate, "ask", breaking)
    with pytest.raises(RuntimeError):
        annotate.ask_once(prompts, upper, ledger, wave=7)
    monkeypatch.setattr(annotate, "ask", real)
    kept = annotate.ledger_answers(spark, ledger).count()
    assert 0 < kept < 50
    out = annotate.ask_once(prompts, upper, ledger, wave=7)
    assert {r.path: r.body for r in out.collect()} == {str(i): f"P{i}" for i in range(50)}
    assert annotate.read_ledger(spark, ledger).count() == 50
    assert annotate.ask_once(prompts.limit(0), upper, str(tmp_path / "none")).count() == 0


def test_a_file_that_cannot_be_written_is_logged(spark, tmp_path):
    (tmp_path / "folder").mkdir()
    rows = [(f"{tmp_path}/a/ok.js", "x"), (f"file:{tmp_path}/ü 1.js", "é"), (f"{tmp_path}/none.js", None), (None, "x")]
    rows += [("nowhere://bucket/a.js", "x"), ("s3x:relative", "x"), ("a/relative.js", "x"), (f"{tmp_path}/folder", "x")]
    log = {r.path: r for r in io.write_tree(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert len(log) == len(rows)
    assert {p for p, r in log.items() if r.status == "ok"} == {rows[0][0], rows[1][0]}
    assert all(r.error for r in log.values() if r.status == "error")
    assert (tmp_path / "a/ok.js").read_text() == "x" and (tmp_path / "ü 1.js").read_text() == "é"
    assert not list(tmp_path.rglob("*.tmp"))


def test_versions_are_whole(spark, files_of, tmp_path, monkeypatch):
    table = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        io.read_version(spark, table)
    whole = lambda v=None: {r.path: r.content for r in io.read_version(spark, table, v).collect()}
    assert io.write_version(files_of([("a.js", ".js", "1"), ("b.py", ".py", "1"), ("n.js", ".js", None)]), table) == 1
    reader = io.read_version(spark, table)
    assert io.write_version(files_of([("b.py", ".py", "2"), ("c.js", ".js", "2")]), table) == 2
    assert whole() == {"a.js": "1", "b.py": "2", "c.js": "2", "n.js": None}
    assert {r.path for r in reader.collect()} == {"a.js", "b.py", "n.js"} and whole(1) == {"a.js": "1", "b.py": "1", "n.js": None}
    # a writer that fails, or comes second, leaves the table as it is
    boom = F.raise_error(F.lit("boom"))
    with pytest.raises(Exception, match="boom"):
        io.write_version(files_of([("d.js", ".js", "3")]).withColumn("content", boom.cast("string")), table)
    now = io._current(spark, table)
    monkeypatch.setattr(io, "_current", lambda *_: (1, f"{table}/{now[1].rpartition('/')[2]}"))
    with pytest.raises(Exception, match="(?i)exist"):
        io.write_version(files_of([("e.js", ".js", "3")]), table)
    monkeypatch.undo()
    assert whole() == {"a.js": "1", "b.py": "2", "c.js": "2", "n.js": None}


def test_merged_table_does_not_grow_with_micro_batches(spark, tmp_path):
    schema = "path string, ext string, commit_id bigint, commit_ts timestamp, message string, content string"
    day = dt.datetime(2024, 5, 1, 12)
    arriving, out, work = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "work")
    with pytest.raises(FileNotFoundError):
        revisions.merged(spark, out)
    rows, sizes = [], []
    for i in range(7):
        new = [(f"f{i}.js", ".js", i, day, "m", "a(); // b\n"), (f"f{i}.py", ".py", i, day + dt.timedelta(days=i % 3), "m", "# c\nd()")]
        rows += new
        spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(arriving)
        stream = revisions.revision_stream(spark, arriving, max_files=1)
        revisions.drain_merged(revisions.density_stream(stream), out, work, "day", "ext")
        got = {(str(r.day), r.ext): (r.n_files, r.n_comment, r.n_code) for r in revisions.merged(spark, out).collect()}
        batch = revisions.density_stream(spark.createDataFrame(rows, schema)).collect()
        assert got == {(str(r.day), r.ext): (r.n_files, r.n_comment, r.n_code) for r in batch}
        sizes.append(len(list((tmp_path / "out").iterdir())))
    assert max(sizes) <= 2
    # what a writer left unfinished is not read
    last = max(int(p.name.rpartition("=")[2]) for p in (tmp_path / "out").iterdir())
    (tmp_path / f"out/batch={last + 1}").mkdir()
    assert {(str(r.day), r.ext) for r in revisions.merged(spark, out).collect()} == set(got)


def test_prose_without_text_is_an_empty_file(spark, tmp_path):
    rows = [(4, None), (5, ""), (6, "// a")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus(spark, str(tmp_path), "docs_text").collect()
    assert sorted((r.path, r.content) for r in found) == [("doc_4.py", ""), ("doc_5.rb", ""), ("doc_6.php", "// a")]


def test_rows_of_a_micro_batch_are_dealt_over_tasks(spark, tmp_path):
    rows = corpus(spark, "/root/testdata/sf0.001", "rev_part").coalesce(1)
    rows.write.parquet(str(tmp_path / "in"))
    stream = revisions.revision_stream(spark, str(tmp_path / "in"), max_files=2, tasks=3)
    seen = []
    stripped = revisions.strip_stream(stream, "prune").writeStream.trigger(availableNow=True)
    count = lambda batch, _: seen.append((batch.rdd.getNumPartitions(), batch.count()))
    stripped.option("checkpointLocation", str(tmp_path / "work")).foreachBatch(count).start().awaitTermination()
    assert seen == [(3, rows.count())]


def test_a_tree_of_many_small_files_is_listed_by_tasks_and_read_by_few(spark, tmp_path):
    for i in range(600):
        at = tmp_path / "a" / f"f{i % 7}" / ("deep/er" if i % 5 == 0 else "")
        at.mkdir(parents=True, exist_ok=True)
        (at / f"x{i}.py").write_text(f"a{i}")
    for name in (".git/x.py", "_old/x.py", "f0/_x.py", "f0/.x.py", "f0/x.txt", "_k=v/y.PY", "f0/_metadata.py", "f 1/é%20.py"):
        at = tmp_path / "a" / name
        at.parent.mkdir(exist_ok=True)
        at.write_text("b")
    (tmp_path / "a" / "empty").mkdir()
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", io.ACCEPTED_GLOB)
    listed = io.list_files(spark, str(tmp_path / "a"))
    told = sorted((r["path"], r["length"]) for r in listed.collect())
    assert told == sorted((r["path"], r["length"]) for r in reader.load(str(tmp_path / "a")).select("path", "length").collect())
    assert len(told) == 602
    assert io.with_contents(listed).rdd.getNumPartitions() == 1  # 32 files a task before
    one = io.list_files(spark, str(tmp_path / "a" / "f1" / "x1.py")).collect()
    assert [(r["path"], r["ext"]) for r in one] == [(f"file:{tmp_path}/a/f1/x1.py", ".py")]
