"""Source-code corpora derived from the given tables.

The tables hold no source code, so the corpora are written from their rows in plain SQL
that Spark and DuckDB read the same way (``||``, ``chr``, ``CASE``). Every corpus is
row-local: one file, response or revision per row of its table and no grouping, so its
size and its cost follow the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.langs import EXTENSIONS

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

LF = "chr(10)"
_HASH = "('.py', '.rb', '.sh')"
_MARKUP = "('.html', '.vue', '.svelte')"


def _lines(*parts: str) -> str:
    return f" || {LF} || ".join(f"({p})" for p in parts)


def _cases(expr: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {expr} {whens} END"


PAGES_HTML = """
SELECT 'page_' || CAST(page_id AS STRING) || '.html' AS path, '.html' AS ext, html AS content
FROM pages
"""

_EXT = _cases(f"k % {len(EXTENSIONS)}", [f"'{e}'" for e in EXTENSIONS])
_DIR = "CASE k % 8 WHEN 0 THEN 'node_modules' WHEN 1 THEN 'tests' WHEN 2 THEN 'dist' WHEN 3 THEN 'mytests' ELSE 'src' END"


def _part_source(edit: str = "''") -> str:
    """Text of a part's file; ``edit`` is an SQL string that varies its comments."""
    say = f"CASE WHEN ext IN {_HASH} THEN '# ' WHEN ext IN {_MARKUP} THEN '<!-- ' ELSE '// ' END"
    end = f"CASE WHEN ext IN {_MARKUP} THEN ' -->' ELSE '' END"
    size = "CAST(p_size AS STRING)"
    block = (
        f"CASE WHEN ext IN {_HASH} THEN "
        + _lines("'# [ds]'", "'# Generated for ' || p_name", "'# end'")
        + f" WHEN ext IN {_MARKUP} THEN "
        + _lines("'<!-- [ds]'", "' Generated for ' || p_name", "'-->'")
        + " ELSE "
        + _lines("'/** [ds]'", "' * Generated for ' || p_name", "' */'")
        + " END"
    )
    human = (
        f"CASE WHEN ext = '.py' THEN "
        + _lines("'doc = \"\"\"'", "'# not a comment'", "'\"\"\"'")
        + f" WHEN ext IN {_HASH} OR ext IN {_MARKUP} THEN 'keep();'"
        + " ELSE "
        + _lines("'/* first ' || p_brand", "'   second'", "'*/ after();'", "'last(); /* done */'")
        + " END"
    )
    return _lines(
        f"{say} || p_type || ' module' || {edit} || {end}",
        block,
        f"'const name = \"' || p_name || ' ' || {say} || 'not a comment\";'",
        "''",
        f"'  price = ' || {size} || '; ' || {say} || 'unit price' || {end}",
        f"'  size = ' || {size} || '; ' || {say} || 'scaled [ds]' || {end}",
        "CASE WHEN k % 3 = 0 THEN '   ' ELSE '' END",
        human,
        "CASE WHEN ext IN ('.js', '.go', '.kt', '.rb') THEN 'tpl = `a' || chr(10) || '  // inside' || chr(10) || '`;' ELSE 'one();' END",
        "'end();'",
    )


_PART_ROWS = f"""
SELECT *, 'repo' || CAST(p_size % 7 AS STRING) || '/' || {_DIR} || '/part_' || CAST(k AS STRING) || ext AS path
FROM (SELECT *, {_EXT} AS ext FROM (SELECT *, p_partkey AS k FROM part) AS a) AS b
"""

SRC_PART = f"""
SELECT path, ext, CASE
  WHEN k % 97 = 0 THEN '   ' || {LF}
  WHEN k % 10 = 0 THEN replace(body, {LF}, chr(13) || {LF})
  ELSE body END AS content, k
FROM (SELECT *, {_part_source()} AS body FROM ({_PART_ROWS}) AS c) AS d
"""

# Orders: between one and six steps each, in six languages.
_ORDER_EXT = _cases("k % 6", ["'.java'", "'.go'", "'.dart'", "'.py'", "'.scss'", "'.php'"])
_ORDER_TOKEN = "CASE WHEN ext = '.py' THEN '# ' ELSE '// ' END"


def _order_step(i: int) -> str:
    code = f"'    step{i}(' || CAST(k AS STRING) || ');'"
    block = (
        "CASE WHEN ext = '.py' THEN "
        + _lines(f"'    # step {i}'", "'    # of ' || o_orderpriority")
        + " ELSE "
        + _lines(f"'    /* step {i}'", "'     * of ' || o_orderpriority", "'     */'")
        + " END"
    )
    forms = [
        code,
        f"{code} || ' ' || {_ORDER_TOKEN} || 'status ' || o_orderstatus",
        _lines(f"'    ' || {_ORDER_TOKEN} || 'scaled step [ds]'", code),
        _lines(block, code),
    ]
    step = _cases(f"(k + {i}) % 4", forms)
    return f"CASE WHEN o_custkey % 6 >= {i} THEN {LF} || {step} ELSE '' END"


SRC_ORDER = f"""
SELECT 'order_' || CAST(k AS STRING) || ext AS path, ext,
  'url = "http://shop/o#' || CAST(k AS STRING) || '";' || {" || ".join(_order_step(i) for i in range(6))} AS content
FROM (SELECT *, {_ORDER_EXT} AS ext FROM (SELECT *, o_orderkey AS k FROM orders) AS a) AS b
"""

# Suggestions: one per lineitem, some for lines that do not exist, some for one line.
_SUGGESTED = _cases(
    "l_partkey % 6",
    [
        f"{_ORDER_TOKEN} || 'quantity ' || CAST(CAST(l_quantity AS INT) AS STRING)",
        "'/* flag ' || l_returnflag || ' */'",
        _lines("'/**'", "' * Ships as ' || l_linestatus", "' * @step ' || CAST(l_linenumber AS STRING)", "' */'"),
        _lines(f"{_ORDER_TOKEN} || 'first'", f"'  ' || {_ORDER_TOKEN} || 'second'"),
        _lines(f"{_ORDER_TOKEN} || 'above'", "'  '", f"{_ORDER_TOKEN} || 'below'"),
        _lines(f"{_ORDER_TOKEN} || 'call'", "'extra();'"),
    ],
)

SUGG_ORDER = f"""
SELECT 'order_' || CAST(k AS STRING) || ext AS path,
  l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey AS idx,
  CAST(l_linenumber + l_suppkey % 5 - 2 AS BIGINT) AS line, {_SUGGESTED} AS comment
FROM (SELECT *, {_ORDER_EXT} AS ext FROM (SELECT *, l_orderkey AS k FROM lineitem) AS a) AS b
"""

# Deletion requests for the part files: spread over code, comment and missing lines.
DEL_PART = f"""
SELECT path, CAST(1 + (k * 7) % 23 AS BIGINT) AS line FROM ({_PART_ROWS}) AS c
UNION ALL
SELECT path, CAST(1 + (k * 3) % 11 AS BIGINT) AS line FROM ({_PART_ROWS}) AS d
"""

# Responses: one per order, with the faults a model can make.
_Q = "chr(34)"  # a double quote


def _item(line: str, comment: str) -> str:
    return f"'{{' || {_Q} || 'line' || {_Q} || ': ' || {line} || ', ' || {_Q} || 'comment' || {_Q} || ': ' || {comment} || '}}'"


_LINE = "CAST(1 + k % 5 AS STRING)"
_GOOD = _item(_LINE, f"{_Q} || '// status ' || o_orderstatus || {_Q}")
_MORE = _item("'2'", f"{_Q} || '/* priority ' || o_orderpriority || ' */' || {_Q}")
_ANSWER = _cases(
    "k % 12",
    [
        f"'```json' || {LF} || '[' || {_GOOD} || ', ' || {_MORE} || ']' || {LF} || '```'",
        f"'Here it is: [' || {_GOOD} || '] as asked.'",
        f"'[' || {_GOOD} || ', {{' || {_Q} || 'line'",
        _GOOD,
        f"'[' || {_GOOD} || ', 7]'",
        "'[' || " + _item("'0'", f"{_Q} || '// zero' || {_Q}") + " || ']'",
        "'[' || " + _item(f"{_Q} || {_LINE} || {_Q}", f"{_Q} || '// text' || {_Q}") + " || ']'",
        f"'[{{' || {_Q} || 'line' || {_Q} || ': 3}}]'",
        f"'[' || {_GOOD} || ', ' || " + _item("'4'", f"{_Q} || 'no marker' || {_Q}") + " || ']'",
        "'[' || " + _item("'4.0'", f"{_Q} || '// four' || {_Q}") + " || ']'",
        "'[]'",
        f"'[' || {_GOOD} || ', ' || {_MORE} || ']'",
    ],
)
_ESCAPED = f"replace(replace(answer, {_Q}, chr(92) || {_Q}), {LF}, chr(92) || 'n')"


def _json(template: str) -> str:
    """SQL string for a JSON template with single-letter words and %s for the text."""
    head, tail = template.split("%s")
    head, tail = (t.replace('"', f"' || {_Q} || '") for t in (head, tail))
    return f"'{head}' || {_ESCAPED} || '{tail}'"


_ENVELOPES = _cases(
    "o_custkey % 3",
    [
        _json('{"candidates": [{"content": {"parts": [{"text": "%s"}]}}]}'),
        _json('{"content": [{"type": "text", "text": "%s"}]}'),
        _json('{"choices": [{"message": {"content": "%s"}}]}'),
    ],
)

RESP_ORDER = f"""
SELECT path, provider, CASE WHEN k % 101 = 0
  THEN '{{' || {_Q} || 'error' || {_Q} || ': {{' || {_Q} || 'message' || {_Q} || ': ' || {_Q} || 'quota ' || o_orderpriority || {_Q} || '}}}}'
  ELSE {_ENVELOPES} END AS body
FROM (
  SELECT *, 'order_' || CAST(k AS STRING) AS path,
    CASE o_custkey % 3 WHEN 0 THEN 'gemini' WHEN 1 THEN 'claude' ELSE 'openai' END AS provider,
    {_ANSWER} AS answer
  FROM (SELECT *, o_orderkey AS k FROM orders) AS a) AS b
"""

# Revisions: three per part; the second changes comments, code, nothing or line ends.
_BODY = "CASE WHEN k % 10 = 0 THEN replace({0}, chr(10), chr(13) || chr(10)) ELSE {0} END"
_SECOND = f"""CASE k % 4
  WHEN 0 THEN {_BODY.format("edited")}
  WHEN 1 THEN {_BODY.format("body")} || {LF} || 'more();'
  WHEN 2 THEN {_BODY.format("body")}
  ELSE CASE WHEN k % 10 = 0 THEN body ELSE replace(body, {LF}, chr(13) || {LF}) END END"""


def _revision(n: int, more: str = "") -> str:
    content = _SECOND if n == 2 else _BODY.format("body")
    commit = f"(k % 50 * 3 + {n})"
    return f"""
SELECT path, ext, CAST({commit} AS BIGINT) AS commit_id,
  TIMESTAMP '2024-01-01 00:00:00' + {commit} * INTERVAL '1' HOUR AS commit_ts,
  CASE WHEN {commit} % 7 = 0 THEN 'docs: auto-generated comments' ELSE 'change ' || CAST({commit} AS STRING) END AS message,
  {content} AS content{more}
FROM (SELECT *, {_part_source()} AS body, {_part_source("' (edited)'")} AS edited FROM ({_PART_ROWS}) AS c) AS d
"""


# What a commit touches as it is listed: the last revision may be a deletion, a path may have an
# extension in capitals, with which ``ext`` does not tell the language, and some second revisions are delivered twice.
def _listed() -> str:
    return f"""
SELECT CASE WHEN p % 6 = 0 THEN upper(path) ELSE path END AS path, CASE WHEN p % 6 = 0 THEN upper(ext) ELSE ext END AS ext,
  commit_id, commit_ts, message, CASE WHEN p % 5 = 0 AND n = 3 THEN NULL ELSE content END AS content
FROM (SELECT *, CASE WHEN n = 2 AND p % 4 = 1 THEN 2 ELSE 1 END AS times
  FROM ({"UNION ALL".join(_revision(n, f", k AS p, {n} AS n") for n in (1, 2, 3))}) AS q) AS r
CROSS JOIN (SELECT 1 AS delivery UNION ALL SELECT 2 AS delivery) AS d
WHERE delivery <= times
"""


REV_PART = "UNION ALL".join(_revision(n) for n in (1, 2, 3))
REV_LISTED = _listed()

# Request attempts: every event is one, and four events in a row are one request, so the
# fourth attempt is one more than a request may have.
ATTEMPTS_EVENTS = """
SELECT CAST(floor(event_id / 4.0) AS BIGINT) AS request_id, CAST(event_id % 4 AS INT) AS attempt,
  CASE event_type WHEN 'error' THEN 429 WHEN 'signup' THEN 503 WHEN 'click' THEN 400 ELSE 200 END AS status,
  CASE event_type WHEN 'error' THEN 'slow down' WHEN 'signup' THEN 'unavailable' END AS error
FROM events
"""

RUN_LOG_EVENTS = """
SELECT 'f' || CAST(event_id AS STRING) AS path,
  CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 19 = 0 THEN 'skipped_empty' ELSE 'ok' END AS status
FROM events
"""

# Files whose lexing takes look-behind, back-references or nesting, and what has to be
# left (``expected``) once comments are gone, written from the same row without lexing.
_DEPTH = "CAST(1 + p_size + p_size % 3 * 20 AS INT)"
_NESTED = f"repeat('/* in ', {_DEPTH}) || p_name || {LF} || repeat(' out */', {_DEPTH})"
_RAW = f"'s = R\"d' || d || '(// ' || p_name || {LF} || ')\" /* raw */ )d' || d || '\";'"
_CALL = "'r = a / b + /[\"]+/.exec(x);'"
_MATCH = "'  return /' || chr(39) || chr(92) || '/*/.test(y) '"
HARD_PART = f"""
SELECT 'hard_' || CAST(k AS STRING) || ext AS path, ext, p_name, p_type, nested, k,
  CASE WHEN k % 4 < 2 THEN 'a(); ' || nested || ' b();'
    WHEN k % 4 = 2 THEN {_RAW} || ' // ' || p_type
    ELSE {_CALL} || ' // ' || p_name || {LF} || {_MATCH} || '/* ' || p_type || ' */;' END AS content,
  CASE WHEN k % 4 < 2 THEN 'a();' || {LF} || ' b();'
    WHEN k % 4 = 2 THEN {_RAW}
    ELSE {_CALL} || {LF} || {_MATCH} || ';' END AS expected
FROM (
  SELECT *, CAST(k % 10 AS STRING) AS d, {_NESTED} AS nested,
    CASE k % 4 WHEN 0 THEN '.rs' WHEN 1 THEN '.swift' WHEN 2 THEN '.cpp' ELSE '.ts' END AS ext
  FROM (SELECT *, p_partkey AS k FROM part) AS a) AS b
"""

# Rules that hang on one line: quotes that end with it, ``#`` in .php, ``#!`` lines. What has to
# be left is written from the same row without lexing.
_OPEN_QUOTE = "'s = ' || chr(34) || 'open ' || p_name"
QUIRK_PART = f"""
SELECT 'quirk_' || CAST(k AS STRING) || ext AS path, ext, k, p_type,
  CASE k % 4 WHEN 0 THEN {_lines(_OPEN_QUOTE, "'call(); // ' || p_type")}
    WHEN 1 THEN {_lines("'$x = ' || CAST(p_size AS STRING) || '; # ' || p_type", "'go();'")}
    WHEN 2 THEN {_lines("'#!/bin/sh'", "'# ' || p_type", "'run ' || p_name")}
    ELSE {_lines("'c = ' || chr(39) || p_name || ' /* not a comment'", "'/* ' || p_type || ' */ call();'")} END AS content,
  CASE k % 4 WHEN 0 THEN {_lines(_OPEN_QUOTE, "'call();'")}
    WHEN 1 THEN {_lines("'$x = ' || CAST(p_size AS STRING) || ';'", "'go();'")}
    WHEN 2 THEN {_lines("'#!/bin/sh'", "'run ' || p_name")}
    ELSE {_lines("'c = ' || chr(39) || p_name || ' /* not a comment'", "' call();'")} END AS expected
FROM (SELECT *, CASE k % 4 WHEN 0 THEN '.java' WHEN 1 THEN '.php' WHEN 2 THEN '.sh' ELSE '.go' END AS ext
  FROM (SELECT *, p_partkey AS k FROM part) AS a) AS b
"""

# Prose read as if it were source, so quotes and slashes come as they come in text.
DOCS_TEXT = """
SELECT 'doc_' || CAST(doc_id AS STRING) || ext AS path, ext, coalesce(text, '') AS content
FROM (SELECT *, CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.rb' WHEN 2 THEN '.php' ELSE '.scss' END AS ext
  FROM documents) AS a
"""

# Answers of a clean run: deletions, and what is no deletion.
_DELETE = f"{_Q} || 'action' || {_Q} || ': ' || {_Q} || 'delete' || {_Q}"
RESP_CLEAN = f"""
SELECT path, provider, {_json('{"choices": [{"message": {"content": "%s"}}]}')} AS body
FROM (SELECT 'order_' || CAST(o_orderkey AS STRING) AS path, 'openai' AS provider, {_cases("o_orderkey % 4", [
    f"'[{{' || {_Q} || 'line' || {_Q} || ': ' || CAST(1 + o_custkey % 9 AS STRING) || ', ' || {_DELETE} || '}}]'",
    f"'[{{' || {_Q} || 'line' || {_Q} || ': 2, ' || {_Q} || 'comment' || {_Q} || ': ' || {_Q} || '// a' || {_Q} || '}}]'",
    f"'[{{' || {_Q} || 'line' || {_Q} || ': 1, ' || {_DELETE} || '}}, {{' || {_Q} || 'line' || {_Q} || ': 3, ' || {_DELETE} || '}}]'",
    f"'[{{' || {_Q} || 'line' || {_Q} || ': 0, ' || {_DELETE} || '}}]'",
  ])} AS answer FROM orders) AS a
"""

CORPORA = {
    "pages_html": (PAGES_HTML, "pages"),
    "src_part": (SRC_PART, "part"),
    "src_order": (SRC_ORDER, "orders"),
    "sugg_order": (SUGG_ORDER, "lineitem"),
    "del_part": (DEL_PART, "part"),
    "resp_order": (RESP_ORDER, "orders"),
    "rev_part": (REV_PART, "part"),
    "rev_listed": (REV_LISTED, "part"),
    "attempts_events": (ATTEMPTS_EVENTS, "events"),
    "run_log_events": (RUN_LOG_EVENTS, "events"),
    "hard_part": (HARD_PART, "part"),
    "quirk_part": (QUIRK_PART, "part"),
    "docs_text": (DOCS_TEXT, "documents"),
    "resp_clean": (RESP_CLEAN, "orders"),
}


#: Tables whose rows become files, and how many of their rows one task writes and lexes.
_SPREAD = {"part": 10_000, "orders": 30_000}


def _spread(source: DataFrame, rows_a_task: int) -> DataFrame:
    """The same rows in tasks of about ``rows_a_task``. A row of a few bytes becomes a file that is lexed, so
    the bytes of the table, by which Spark cuts it, say nothing of the work."""
    tasks = -(-source.count() // rows_a_task)  # counted from the footers of the files
    return source if tasks < 2 else source.repartition(tasks)


def corpus(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A corpus over the parquet tables in ``sf_dir``."""
    sql, table = CORPORA[name]
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if table in _SPREAD and "AS content" in sql:
        source = _spread(source, _SPREAD[table])
    sql = sql.replace("{", "{{").replace("}", "}}")  # braces here are text, not fields
    df = spark.sql(f"WITH {table} AS (SELECT * FROM {{source}}) {sql}", source=source)
    if "content" not in df.columns:
        return df
    # The explode keeps the long expression for the text in one place; otherwise filters
    # on the text would repeat it.
    rest = [c for c in df.columns if c != "content"]
    return df.select(*rest, F.explode(F.array("content")).alias("content")).select(*df.columns)
