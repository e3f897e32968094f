"""DuckDB formulations of the registered queries.

They are written independently of the Spark side: tokens come from RE2 patterns, line
states from windows over exploded tokens, stripping and splicing from joins, windows and
ordered string aggregation. The corpora are the same SQL text on both sides.
"""

from __future__ import annotations

from marginalia.functions.langs import EXTENSIONS
from marginalia.sources.corpora import CORPORA

_STRINGS = r'''"(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?|`(?:\\.|[^`\\])*`?'''
_BLOCK = r"/\*(?:[^*]|\*+[^*/])*\*+/"
_ANY = r"""[^/"'`#<]+|."""
_PATTERNS = {
    "python": rf'#[^\n]*|""".*?"""|{_STRINGS}|{_ANY}',
    "hash": rf"#[^\n]*|{_STRINGS}|{_ANY}",
    "php": rf"//[^\n]*|{_BLOCK}|#[^\n]*|{_STRINGS}|{_ANY}",
    "html": rf"<!--.*?-->|//[^\n]*|{_BLOCK}|{_STRINGS}|{_ANY}",
    "slash": rf"//[^\n]*|{_BLOCK}|{_STRINGS}|{_ANY}",
}
_STYLE = """CASE WHEN ext = '.py' THEN 'python' WHEN ext IN ('.rb', '.sh') THEN 'hash'
  WHEN ext = '.php' THEN 'php' WHEN ext IN ('.html', '.vue', '.svelte') THEN 'html' ELSE 'slash' END"""
_CR = "chr(13) || chr(10)"


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def corpus(name: str, alias: str = "files") -> str:
    return f"{alias} AS ({CORPORA[name][0]})"


def lexed(p: str = "", source: str = "files") -> str:
    """CTEs <p>ls (lines with states) and <p>pc (token pieces) of a table of files."""
    tokens = " ".join(
        f"WHEN '{style}' THEN regexp_extract_all(lf, {_lit('(?s)' + pattern)})"
        for style, pattern in _PATTERNS.items()
    )
    return f"""
{p}lf AS (SELECT *, replace({source}.content, {_CR}, chr(10)) AS lf, {_STYLE} AS style,
  CASE WHEN contains({source}.content, {_CR}) THEN {_CR} ELSE chr(10) END AS eol FROM {source}),
{p}tk AS (SELECT path, ext, style, eol, unnest(toks) AS t, generate_subscripts(toks, 1) AS seq
  FROM (SELECT *, CASE style {tokens} END AS toks FROM {p}lf) AS x),
{p}kd AS (SELECT *, string_split(t, chr(10)) AS parts, CASE
  WHEN style IN ('python', 'hash', 'php') AND t LIKE '#%' THEN 'comment'
  WHEN style NOT IN ('python', 'hash') AND (t LIKE '//%' OR t LIKE '/*%') THEN 'comment'
  WHEN style = 'html' AND t LIKE '<!--%' THEN 'comment'
  WHEN t LIKE '"%' OR t LIKE '''%' OR (style <> 'python' AND t LIKE '`%') THEN 'string'
  ELSE 'code' END AS kind FROM {p}tk),
{p}px AS (SELECT path, ext, eol, seq, t, kind, len(parts) AS n_parts, unnest(parts) AS piece,
  generate_subscripts(parts, 1) - 1 AS pno FROM {p}kd),
{p}pl AS (SELECT *, 1 + sum(CASE WHEN pno > 0 THEN 1 ELSE 0 END)
  OVER (PARTITION BY path ORDER BY seq, pno ROWS UNBOUNDED PRECEDING) AS line_no FROM {p}px),
{p}pc AS (SELECT *, sum(length(piece)) OVER (PARTITION BY path, line_no ORDER BY seq, pno
  ROWS UNBOUNDED PRECEDING) - length(piece) AS col FROM {p}pl),
{p}l0 AS (SELECT path, any_value(ext) AS ext, any_value(eol) AS eol, CAST(line_no AS BIGINT) AS line_no,
  string_agg(piece, '' ORDER BY seq, pno) AS text,
  string_agg(CASE WHEN kind = 'comment' THEN '' ELSE piece END, '' ORDER BY seq, pno) AS code,
  bool_or(kind = 'comment') AS has_comment,
  CAST(max(CASE WHEN kind = 'comment' AND pno = 0 THEN col END) AS BIGINT) AS comment_start,
  bool_or(kind = 'comment' AND pno > 0) AS sib, bool_or(kind = 'comment' AND pno < n_parts - 1) AS eib,
  bool_or(kind = 'string' AND pno > 0) AS sis FROM {p}pc GROUP BY path, line_no),
{p}l1 AS (SELECT *, CASE WHEN sib AND (eib OR comment_start IS NULL) THEN true
    WHEN comment_start IS NOT NULL THEN trim(substr(text, 1, comment_start)) = ''
    ELSE trim(text) = '' END AS pure,
  sum(CASE WHEN sib THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY line_no) AS run,
  substr(text, 1, comment_start) AS lhs, substr(text, comment_start + 1) AS rest FROM {p}l0),
{p}ls AS (SELECT *, bool_or(sib) OVER w AND bool_or(contains(text, '[ds]')) OVER w AS ds_block,
  rtrim(CASE WHEN rest LIKE '/*%' AND contains(rest, '*/') THEN lhs || substr(rest, strpos(rest, '*/') + 2)
    WHEN rest LIKE '<!--%' AND contains(rest, '-->') THEN lhs || substr(rest, strpos(rest, '-->') + 3)
    ELSE lhs END) AS cut FROM {p}l1 WINDOW w AS (PARTITION BY path, run))"""


_TOUCHED = {"prune": "true", "clean": "(ds_block OR contains(text, '[ds]'))"}


def stripped(mode: str, p: str = "") -> str:
    """CTE <p>st: every line with ``kept``, its text after stripping (NULL: deleted)."""
    touched = _TOUCHED[mode]
    return f"""{p}st AS (SELECT *, CASE WHEN NOT {touched} OR text = '' OR starts_with(trim(text), '#!') THEN text
  WHEN pure THEN NULL WHEN comment_start IS NOT NULL THEN cut ELSE text END AS kept FROM {p}ls)"""


def rebuilt(p: str = "", name: str = "out", column: str = "kept") -> str:
    return f"""{p}{name} AS (SELECT path, any_value(ext) AS ext,
  coalesce(replace(string_agg({column}, chr(10) ORDER BY line_no), chr(10), eol), '') AS content
  FROM {p}st GROUP BY path, eol)"""


def strip_sql(name: str, mode: str, where: str = "") -> str:
    return f"""WITH {corpus(name)}, {lexed()}, {stripped(mode)}, {rebuilt()}
SELECT path, content FROM out {where}"""


def strict_sql(source: str) -> str:
    return f"""WITH {source}, {lexed()}, st AS (SELECT *, CASE WHEN NOT has_comment THEN text
  WHEN trim(code) = '' THEN NULL ELSE rtrim(code) END AS kept FROM ls), {rebuilt()}
SELECT path, content FROM out"""


def comments_sql(name: str) -> str:
    return f"""WITH {corpus(name)}, {lexed()}
SELECT c.path, c.ext, row_number() OVER (PARTITION BY c.path ORDER BY seq) - 1 AS seq,
  CAST(c.line_no AS BIGINT) AS line_no, CAST(col AS BIGINT) AS col, t AS text,
  CASE WHEN t LIKE '/*%' OR t LIKE '<!--%' THEN 'block' ELSE 'line' END AS style,
  CAST(n_parts AS BIGINT) AS n_lines, trim(substr(l.text, 1, CAST(col AS BIGINT))) = '' AS own_line,
  contains(t, '[ds]') AS tagged
FROM pc AS c JOIN ls AS l ON c.path = l.path AND c.line_no = l.line_no
WHERE kind = 'comment' AND pno = 0"""


_COUNTS = """path, any_value(ext) AS ext, count(*) AS n_lines,
  count(*) FILTER (WHERE trim(text) <> '' AND pure) AS n_comment,
  count(*) FILTER (WHERE trim(text) <> '' AND NOT pure) AS n_code"""


def density_sql(name: str) -> str:
    return f"""WITH {corpus(name)}, {lexed()}
SELECT *, round(n_comment / nullif(n_code, 0), 6) AS per_code, round(n_comment / n_lines, 6) AS per_line
FROM (SELECT {_COUNTS} FROM ls GROUP BY path) AS c"""


def density_by_sql(name: str, keys: list[str], extra: str = "") -> str:
    cols = ", ".join(keys)
    level = " + ".join(f"grouping({k})" for k in keys)
    return f"""WITH {corpus(name)}, {lexed()}, counts AS (SELECT {_COUNTS} FROM ls GROUP BY path)
SELECT {cols}, count(*) AS n_files, CAST(sum(n_comment) AS BIGINT) AS n_comment, CAST(sum(n_code) AS BIGINT) AS n_code,
  round(sum(n_comment) / nullif(sum(n_code), 0), 6) AS per_code, CAST({level} AS BIGINT) AS level
FROM (SELECT *{extra} FROM counts) AS c GROUP BY ROLLUP ({cols})"""


_SPLIT = f"string_split(replace(content, {_CR}, chr(10)), chr(10))"
_EOL = f"CASE WHEN contains(content, {_CR}) THEN {_CR} ELSE chr(10) END"

# Paths that put the extension rule to the test.
ODD_PATHS = """SELECT CASE k % 5 WHEN 0 THEN upper(path) WHEN 1 THEN path || '.md'
  WHEN 2 THEN 'repo/' || CAST(k AS STRING) || '/' || ext WHEN 3 THEN path || '.' ELSE path END AS path, content
FROM ({inner}) AS q"""

# -- splicing -----------------------------------------------------------------------
_SIZES = "sizes AS (SELECT path, len(" + _SPLIT + ") AS n FROM files)"
_VALID = "valid AS (SELECT s.* FROM sugg AS s JOIN sizes USING (path) WHERE line BETWEEN 1 AND n + 1)"
_EXPANDED = f"""ex0 AS (SELECT path, idx, line, tie, unnest(parts) AS raw, generate_subscripts(parts, 1) - 1 AS sub_line
  FROM (SELECT *, string_split(comment, chr(10)) AS parts,
    row_number() OVER (PARTITION BY path, line, idx ORDER BY comment) AS tie FROM sugg) AS v),
ex1 AS (SELECT *, ltrim(raw) AS body FROM ex0),
ex2 AS (SELECT *, CASE WHEN body = '' THEN ''
  WHEN body LIKE '//%' OR body LIKE '#%' OR body LIKE '--%' THEN body || ' [ds]'
  WHEN sub_line = 0 AND body LIKE '%*/' THEN left(body, length(body) - 2) || '[ds] */'
  WHEN sub_line = 0 AND body LIKE '%-->' THEN left(body, length(body) - 3) || '[ds] -->'
  WHEN sub_line = 0 THEN body || ' [ds]' ELSE body END AS tagged FROM ex1),
ex AS (SELECT path, idx, line, tie, CAST(sub_line AS BIGINT) AS sub_line,
  CASE WHEN tagged LIKE '*%' AND tagged NOT LIKE '*/%' THEN ' ' || tagged ELSE tagged END AS text FROM ex2)"""


def _merged(source: str = "files", p: str = "") -> str:
    """CTE merged: lines of ``source`` and inserted lines in output order."""
    return f"""{p}sizes AS (SELECT path, max(line_no) AS n FROM {p}ls GROUP BY path),
{p}tail AS (SELECT path, any_value(ext) AS ext, any_value(eol) AS eol FROM {p}ls GROUP BY path),
{p}ins AS (SELECT ex.path, ex.line, ex.idx, ex.tie, ex.sub_line,
    CASE WHEN ex.text = '' THEN '' ELSE coalesce(regexp_extract(l.text, '^[ \\t]*'), '') || ex.text END AS text
  FROM ex JOIN {p}sizes AS z ON z.path = ex.path AND ex.line BETWEEN 1 AND z.n + 1
  LEFT JOIN {p}ls AS l ON l.path = ex.path AND l.line_no = ex.line WHERE NOT coalesce(l.sis, false)),
{p}mg AS (SELECT path, line_no AS line, 1 AS is_code, 0 AS o, 0 AS tie, 0 AS sub_line, line_no AS orig_line, text FROM {p}ls
  UNION ALL SELECT path, line, 0, -idx, tie, sub_line, NULL, text FROM {p}ins),
{p}merged AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line, is_code, o, tie, sub_line) AS out_line FROM {p}mg),
{p}spliced AS (SELECT m.path, any_value(t.ext) AS ext, replace(string_agg(m.text, chr(10) ORDER BY out_line), chr(10), t.eol) AS content
  FROM {p}merged AS m JOIN {p}tail AS t ON t.path = m.path GROUP BY m.path, t.eol)"""


def _splice_parts() -> str:
    return f"{corpus('src_order')}, {corpus('sugg_order', 'sugg')}, {_EXPANDED}"


def annotate_sql(mode: str) -> str:
    return f"""WITH {corpus('src_order')}, {corpus('sugg_order', 'sugg')}, {_EXPANDED}, {lexed()}, {stripped(mode)},
{rebuilt()}, {lexed('b_', 'out')}, {_merged('out', 'b_')}
SELECT path, content FROM b_spliced"""


# -- responses ----------------------------------------------------------------------
_TEXT = """CASE provider WHEN 'gemini' THEN (body ->> '$.candidates[0].content.parts[0].text')
  WHEN 'claude' THEN (body ->> '$.content[0].text') ELSE (body ->> '$.choices[0].message.content') END"""
_TEXTS = f"""texts AS (SELECT path, provider, CASE WHEN (body -> '$.error') IS NULL THEN ({_TEXT}) END AS text,
  CASE WHEN (body -> '$.error') IS NOT NULL THEN 'api_error' WHEN ({_TEXT}) IS NULL THEN 'no_text' END AS err,
  (body ->> '$.error.message') AS message FROM files)"""
_ITEMS = f"""{_TEXTS},
sliced AS (SELECT *, CASE WHEN regexp_matches(text, '(?s)\\[.*\\]') THEN regexp_extract(text, '(?s)\\[.*\\]') ELSE trim(text) END AS js FROM texts),
parsed AS (SELECT *, CASE WHEN json_valid(js) THEN js END AS v FROM sliced),
arrays AS (SELECT *, CASE WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[*]') END AS els FROM parsed),
els AS (SELECT path, unnest(els) AS e, generate_subscripts(els, 1) - 1 AS idx FROM arrays),
el2 AS (SELECT *, json_type(e) AS ty, json_type(e, '$.line') AS lt, json_extract_string(e, '$.line') AS lv,
  json_type(e, '$.comment') AS ct, json_extract_string(e, '$.comment') AS cv FROM els),
el3 AS (SELECT *, coalesce(lt IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND TRY_CAST(lv AS DOUBLE) > 0
  AND TRY_CAST(lv AS DOUBLE) = floor(TRY_CAST(lv AS DOUBLE)), false) AS whole FROM el2),
items AS (SELECT path, CAST(idx AS BIGINT) AS idx, CASE WHEN whole THEN TRY_CAST(TRY_CAST(lv AS DOUBLE) AS BIGINT) END AS line,
  whole AND TRY_CAST(TRY_CAST(lv AS DOUBLE) AS BIGINT) IS NULL AS past_any_file,
  CASE WHEN ct = 'VARCHAR' THEN cv END AS comment,
  CASE WHEN ty NOT IN ('OBJECT', 'ARRAY') THEN 'not_object' WHEN NOT whole THEN 'bad_line'
    WHEN coalesce(ct, '') <> 'VARCHAR' THEN 'bad_comment'
    WHEN NOT regexp_matches(trim(cv), '^(//|/\\*|#|<!--|--)') THEN 'bad_marker' END AS err FROM el3),
first_bad AS (SELECT path, min_by(err, idx) AS err FROM items WHERE err IS NOT NULL GROUP BY path),
verdict AS (SELECT a.path, coalesce(a.err, CASE WHEN v IS NULL THEN 'not_json' WHEN els IS NULL THEN 'not_array' END, f.err) AS err
  FROM arrays AS a LEFT JOIN first_bad AS f ON f.path = a.path)"""

# -- changes ------------------------------------------------------------------------
_COMMIT_OK = "NOT (contains(path, 'node_modules/') OR contains(path, 'tests/') OR contains(path, '__tests__/') OR contains(path, 'fixtures/'))"
_OWN = "'docs: auto-generated comments'"


def _change_parts(where: str = "true", source: str = "rev_part") -> str:
    # One row per revision, so the revision number joins the path while lexing.
    return f"""{corpus(source, 'deliveries')}, revs AS (SELECT DISTINCT * FROM deliveries),
files AS (SELECT path || '@' || CAST(commit_id AS STRING) AS path, path AS real, lower(ext) AS ext, commit_id, commit_ts, message, content FROM revs WHERE {where}),
{lexed()}, {stripped('prune')}, {rebuilt()},
kinds AS (SELECT f.real AS path, f.ext, f.commit_id, f.commit_ts, f.message, o.content AS code, f.content AS whole,
  lag(o.content) OVER w AS prev_code, lag(f.content) OVER w AS prev_whole
  FROM files AS f LEFT JOIN out AS o ON o.path = f.path WINDOW w AS (PARTITION BY f.real ORDER BY commit_ts, commit_id)),
changes AS (SELECT path, ext, commit_id, commit_ts, message, CASE WHEN whole IS NULL THEN 'deleted' WHEN prev_code IS NULL THEN 'new'
  WHEN code = prev_code AND prev_whole <> '' THEN 'comment_only' ELSE 'code' END AS kind FROM kinds)"""


def _prompt_sql() -> str:
    from marginalia.operators.prompts import INSTRUCTIONS

    token = """CASE WHEN ext IN ('.py', '.rb', '.sh', '.php') THEN '#' WHEN ext IN ('.html', '.vue', '.svelte') THEN '<!--' ELSE '//' END"""
    return f"""WITH {corpus('src_part')}, t AS (SELECT *, {token} AS tok, CASE WHEN ext IN ('.html', '.vue', '.svelte') THEN ' -->' ELSE '' END AS fin,
  string_split(path, '/')[-1] AS name, {_SPLIT} AS ls FROM files)
SELECT path, 'full' AS mode, tok AS comment_token, trim('Suggest comments for the source file ' || name || '. Its lines are numbered.' || chr(10) || {_lit(INSTRUCTIONS['full'])} || chr(10)
  || 'Answer with one JSON array and nothing around it. Each element is an object with' || chr(10)
  || '"line", the number of the line to comment above, and "comment", the comment text.' || chr(10)
  || 'Answer [] when nothing needs a comment. Never repeat code. Begin comments with ' || tok
  || ' and never use string literals as comments.' || chr(10) || 'Example: [{{"line": 3, "comment": "'
  || CASE WHEN tok = '//' THEN '/** Adds up the order lines */' ELSE tok || ' Adds up the order lines' || fin END
  || '"}}, {{"line": 9, "comment": "' || tok || ' Skip empty lines' || fin || '"}}]' || chr(10) || chr(10)
  || array_to_string(list_transform(ls, lambda x, i: CAST(i AS VARCHAR) || ': ' || x), chr(10)), ' ' || chr(10)) AS prompt
FROM t"""


_LINE_NO = "CAST(line_no AS BIGINT) AS line_no"

ORACLES: dict[str, str] = {
    "page_tokens": f"""WITH {corpus('pages_html')}, {lexed()}
SELECT path, kind, CAST(line_no AS BIGINT) AS line_no, CAST(col AS BIGINT) AS col, CAST(n_parts AS BIGINT) AS n_lines, t AS text
FROM pc WHERE pno = 0 AND kind <> 'code'""",
    "page_comments": comments_sql("pages_html"),
    "page_prune": strip_sql("pages_html", "prune"),
    "page_density": density_sql("pages_html"),
    "split_lines": f"""WITH {corpus('src_part')}
SELECT path, unnest(ls) AS text, generate_subscripts(ls, 1) AS line_no FROM (SELECT path, {_SPLIT} AS ls FROM files) AS x""",
    "eol_style": f"WITH {corpus('src_part')} SELECT path, {_EOL} AS eol FROM files",
    "numbered_listing": f"""WITH {corpus('src_part')}
SELECT path, string_agg(CAST(i AS VARCHAR) || ': ' || x, chr(10) ORDER BY i) AS listing
FROM (SELECT path, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM (SELECT path, {_SPLIT} AS ls FROM files) AS x) AS y GROUP BY path""",
    "part_tokens": f"""WITH {corpus('src_part')}, {lexed()}
SELECT path, kind, CAST(line_no AS BIGINT) AS line_no, CAST(col AS BIGINT) AS col, CAST(n_parts AS BIGINT) AS n_lines, t AS text
FROM pc WHERE pno = 0 AND kind <> 'code'""",
    "part_comments": comments_sql("src_part"),
    "accepted_files": f"""SELECT path, ext FROM (SELECT path, lower(regexp_extract(string_split(path, '/')[-1], '^.+(\\.[^.]*)$', 1)) AS ext
FROM ({ODD_PATHS.format(inner=CORPORA['src_part'][0])}) AS a) AS b WHERE ext IN ({', '.join(f"'{e}'" for e in EXTENSIONS)})""",
    "ignored_scan": f"""WITH {corpus('src_part')}, parts AS (SELECT path, unnest(string_split(path, '/')) AS part FROM files)
SELECT path FROM files WHERE path NOT IN (SELECT path FROM parts
  WHERE part IN ('node_modules', 'tests', 'dist', 'repo3', 'part_7.html') OR part LIKE '%9.py' OR part LIKE '%.kt')""",
    "ignored_commit": f"WITH {corpus('src_part')} SELECT path FROM files WHERE {_COMMIT_OK}",
    "skip_empty": f"WITH {corpus('src_part')} SELECT path FROM files WHERE trim(replace(content, chr(10), '')) <> ''",
    "line_state": f"""WITH {corpus('src_part')}, {lexed()}
SELECT path, line_no, text, comment_start, sib AS starts_in_block, eib AS ends_in_block, sis AS starts_in_string,
  pure AS is_pure_comment, starts_with(trim(text), '#!') AS is_shebang FROM ls""",
    "starts_in_string": f"""WITH {corpus('src_part')}, {lexed()}
SELECT path, line_no FROM ls WHERE sis""",
    "prune": strip_sql("src_part", "prune"),
    "clean": strip_sql("src_part", "clean"),
    "strict_prune": strict_sql(corpus("src_part")),
    "dry_run": f"""WITH {corpus('src_part')}, {lexed()}, {stripped('clean')}, {rebuilt()}
SELECT f.path, f.content AS before, o.content AS after FROM files AS f JOIN out AS o USING (path) WHERE f.content <> o.content""",
    "explicit_deletions": f"""WITH {corpus('src_part')}, {corpus('del_part', 'dels')}, {lexed()}, {stripped('clean', '')},
asked AS (SELECT DISTINCT path, line FROM dels),
st2 AS (SELECT st.* REPLACE (CASE WHEN a.line IS NOT NULL AND text <> '' AND {{safe}} THEN NULL ELSE kept END AS kept)
  FROM st LEFT JOIN asked AS a ON a.path = st.path AND a.line = st.line_no)
SELECT path, coalesce(replace(string_agg(kept, chr(10) ORDER BY line_no), chr(10), eol), '') AS content FROM st2 GROUP BY path, eol""",
    "refused_deletions": f"""WITH {corpus('src_part')}, {corpus('del_part', 'dels')}, {lexed()},
asked AS (SELECT DISTINCT path, line FROM dels)
SELECT a.path, a.line, text FROM ls JOIN asked AS a ON a.path = ls.path AND a.line = ls.line_no WHERE text <> '' AND NOT {{safe}}""",
    "prune_bulk": strip_sql("src_order", "prune"),
    "density_bulk": density_by_sql("src_order", ["ext"]),
    "valid_suggestions": f"WITH {corpus('src_order')}, {corpus('sugg_order', 'sugg')}, {_SIZES}, {_VALID} SELECT path, idx, line, comment FROM valid",
    "expanded_comments": f"WITH {corpus('sugg_order', 'sugg')}, {_EXPANDED} SELECT path, idx, line, sub_line, text FROM ex",
    "splice": f"WITH {_splice_parts()}, {lexed()}, {_merged()} SELECT path, content FROM spliced",
    "spliced_lines": f"WITH {_splice_parts()}, {lexed()}, {_merged()} SELECT path, out_line, orig_line, text FROM merged",
    "annotate_overwrite": annotate_sql("prune"),
    "annotate_keep": annotate_sql("clean"),
    "prompts": _prompt_sql().replace("{{", "{").replace("}}", "}"),
    "response_text": f"WITH {corpus('resp_order')}, {_TEXTS} SELECT * FROM texts",
    "response_items": f"WITH {corpus('resp_order')}, {_ITEMS} SELECT path, idx, line, past_any_file, comment, err FROM items",
    "response_errors": f"WITH {corpus('resp_order')}, {_ITEMS} SELECT err, count(*) AS responses FROM verdict WHERE err IS NOT NULL GROUP BY err",
    "accepted_items": f"WITH {corpus('resp_order')}, {_ITEMS} SELECT i.path, i.idx, i.line, i.comment FROM items AS i JOIN verdict AS v ON v.path = i.path WHERE v.err IS NULL",
    "request_outcomes": f"""WITH {corpus('attempts_events')},
final AS (SELECT request_id, min(attempt) AS a FROM files WHERE attempt <= 2 AND status IS NOT NULL AND status <> 429 AND status NOT BETWEEN 500 AND 599 GROUP BY request_id),
last AS (SELECT request_id, max(attempt) FILTER (WHERE attempt <= 2) AS a, count(*) FILTER (WHERE attempt > 2) AS n_extra FROM files GROUP BY request_id),
ends AS (SELECT l.request_id, l.n_extra, coalesce(f.a, l.a) AS a, f.a IS NOT NULL AS is_final FROM last AS l LEFT JOIN final AS f USING (request_id))
SELECT request_id, CAST(a + 1 AS BIGINT) AS attempts_used,
  CASE WHEN is_final AND status BETWEEN 200 AND 299 THEN 'done' WHEN is_final THEN 'returned' WHEN a = 2 THEN 'failed' ELSE 'pending' END AS outcome,
  CAST(status AS BIGINT) AS status, error, CAST(CASE a WHEN 0 THEN 0 WHEN 1 THEN 1000 ELSE 3000 END AS BIGINT) AS waited_ms, n_extra
FROM ends JOIN files USING (request_id) WHERE attempt = a""",
    "quirk_strict_prune": f"WITH {corpus('quirk_part')} SELECT path, expected AS content FROM files",
    "quirk_comments": f"""WITH {corpus('quirk_part')}
SELECT path, CAST(CASE WHEN k % 4 = 2 THEN 1 ELSE 0 END AS BIGINT) AS seq, CASE k % 4 WHEN 0 THEN '// ' || p_type WHEN 3 THEN '/* ' || p_type || ' */' ELSE '# ' || p_type END AS text FROM files
UNION ALL SELECT path, 0, '#!/bin/sh' FROM files WHERE k % 4 = 2""",
    "doc_prune": strip_sql("docs_text", "prune"),
    "doc_density": density_sql("docs_text"),
    "insertable_suggestions": f"""WITH {corpus('src_part')}, {corpus('del_part', 'sugg')}, {lexed()},
sizes AS (SELECT path, max(line_no) AS n FROM ls GROUP BY path)
SELECT s.path, s.line FROM sugg AS s JOIN sizes USING (path) LEFT JOIN ls ON ls.path = s.path AND ls.line_no = s.line
WHERE s.line BETWEEN 1 AND n + 1 AND NOT coalesce(sis, false)""",
    "accepted_deletions": f"""WITH {corpus('resp_clean')}, els AS (
  SELECT path, json_extract(body ->> '$.choices[0].message.content', '$[*]') AS els FROM files),
el AS (SELECT path, unnest(els) AS e, generate_subscripts(els, 1) - 1 AS idx FROM els),
bad AS (SELECT path FROM el WHERE NOT coalesce(CAST(e ->> '$.line' AS BIGINT) > 0 AND (e ->> '$.action') = 'delete', false))
SELECT path, CAST(idx AS BIGINT) AS idx, CAST(e ->> '$.line' AS BIGINT) AS line FROM el WHERE path NOT IN (SELECT path FROM bad)""",
    "changed_files": f"""WITH {corpus('rev_listed', 'deliveries')}, files AS (SELECT DISTINCT * FROM deliveries)
SELECT path, commit_id, sha256(content) AS content, sha256(lag(content) OVER (PARTITION BY path ORDER BY commit_ts, commit_id)) AS prev_content FROM files""",
    "change_kind": f"WITH {_change_parts()} SELECT * FROM changes",
    "to_annotate": f"""WITH {_change_parts(_COMMIT_OK, 'rev_listed')}
SELECT path, lower(ext) AS ext, commit_id, commit_ts, message, kind FROM changes WHERE message <> {_OWN} AND kind NOT IN ('comment_only', 'deleted')""",
    "files_per_commit": f"WITH {corpus('rev_listed')} SELECT commit_id, count(DISTINCT path) AS n_files FROM files WHERE {_COMMIT_OK} GROUP BY commit_id",
    "density_by_language": density_by_sql("src_part", ["ext", "mode"], ", CASE length(path) % 3 WHEN 0 THEN 'light' WHEN 1 THEN 'default' ELSE 'full' END AS mode"),
    "tag_counts": f"""WITH {corpus('src_part')}, {lexed()}
SELECT ext, count(*) FILTER (WHERE contains(t, '[ds]')) AS n_tagged, count(*) FILTER (WHERE NOT contains(t, '[ds]')) AS n_human
FROM kd WHERE kind = 'comment' GROUP BY ROLLUP (ext)""",
    "corpus_totals": f"""WITH {corpus('src_part')} SELECT count(*) AS n_files,
  CAST(sum(len(string_split(content, chr(10)))) AS BIGINT) AS n_lines, count(DISTINCT ext) AS n_languages FROM files""",
    "run_summary": f"""WITH {corpus('run_log_events')} SELECT count(*) FILTER (WHERE status = 'ok') AS n_ok,
  count(*) FILTER (WHERE status = 'error') AS n_error, count(*) FILTER (WHERE status = 'skipped_empty') AS n_skipped,
  count(*) FILTER (WHERE status = 'error') > 0 AND count(*) FILTER (WHERE status = 'ok') = 0 AS failed FROM files""",
    "verify_lines": f"""WITH {corpus('src_part')}, {lexed()}, {stripped('prune')},
k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_no) AS out_line FROM st WHERE kept IS NOT NULL)
SELECT path, out_line, line_no AS orig_line, kept || '!' AS text, text AS source FROM k WHERE line_no % 5 = 0""",
    "verify_order": f"""WITH {corpus('src_part')}, {lexed()}, {stripped('prune')},
k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line_no) AS out_line FROM st WHERE kept IS NOT NULL),
t AS (SELECT path, out_line, CASE WHEN out_line % 4 = 0 THEN line_no - 3 ELSE line_no END AS orig_line FROM k),
p AS (SELECT *, lag(orig_line) OVER (PARTITION BY path ORDER BY out_line) AS previous FROM t)
SELECT path, out_line, orig_line, previous FROM p WHERE orig_line <= previous""",
    "verify_roundtrip": f"""WITH {_splice_parts()}, {lexed()}, {_merged()}, {lexed('b_', 'spliced')},
{stripped('clean')}, {rebuilt()}, {stripped('clean', 'b_')}, {rebuilt('b_')}
SELECT o.path FROM out AS o JOIN b_out AS b ON b.path = o.path WHERE o.content <> b.content""",
    "lost_code": f"""WITH {corpus('src_part')}, {lexed()}, {stripped('prune')}
SELECT path, line_no, text FROM st WHERE kept IS NULL AND (trim(code) <> '' OR sis)""",
    # The lines are used several times over; only files into which something is inserted have to be lexed again.
    "payload_audit": f"""WITH {_splice_parts()}, {lexed()}, {_merged()}, changed AS (
  SELECT * FROM spliced WHERE path IN (SELECT path FROM ins)), {lexed('b_', 'changed')}
SELECT m.path, m.out_line, m.text FROM merged AS m JOIN b_ls AS b ON b.path = m.path AND b.line_no = m.out_line
WHERE m.orig_line IS NULL AND NOT b.pure""".replace("\nls AS (", "\nls AS MATERIALIZED (").replace("\nmerged AS (", "\nmerged AS MATERIALIZED (").replace("\nins AS (", "\nins AS MATERIALIZED ("),
    "quarantine": f"""WITH {_splice_parts()}, {lexed()}, {_merged()}, {lexed('b_', 'spliced')},
bad AS (SELECT m.path FROM merged AS m JOIN b_ls AS b ON b.path = m.path AND b.line_no = m.out_line WHERE m.orig_line IS NULL AND NOT b.pure)
SELECT path, path IN (SELECT path FROM bad) AS bad FROM files""",
    "refused_suggestions": f"""WITH {corpus('src_part')}, {corpus('del_part', 'sugg')}, {lexed()}
SELECT s.path, s.line FROM sugg AS s JOIN ls ON ls.path = s.path AND ls.line_no = s.line WHERE sis""",
    "hard_comments": f"""WITH {corpus('hard_part')}, x AS (
  SELECT path, 0 AS seq, CASE WHEN k % 4 < 2 THEN nested WHEN k % 4 = 2 THEN '// ' || p_type ELSE '// ' || p_name END AS text FROM files
  UNION ALL SELECT path, 1, '/* ' || p_type || ' */' FROM files WHERE k % 4 = 3)
SELECT path, CAST(seq AS BIGINT) AS seq, text FROM x""",
    "hard_strict_prune": f"WITH {corpus('hard_part')} SELECT path, expected AS content FROM files",
}

_SAFE = """(pure OR sib OR regexp_matches(trim(text), '^(//|/\\*|\\*|#|<!--|-->|--)') OR trim(text) LIKE '%*/')"""
for _key in ("explicit_deletions", "refused_deletions"):
    ORACLES[_key] = ORACLES[_key].replace("{safe}", _SAFE)
ORACLES["quarantine_join"] = ORACLES["quarantine"]
ORACLES["stream_change_kind"] = ORACLES["change_kind"]
ORACLES["stream_late"] = f"""WITH {_change_parts("commit_id % 3 <> 1")} SELECT * FROM changes
UNION ALL SELECT path, ext, commit_id, commit_ts, message, 'late' FROM revs WHERE commit_id % 3 = 1"""
# Three waves: two revisions, a third (every other path 60 days later), and the first ones again. The watermark is
# 10 days behind the newest revision, so in the last wave paths whose newest is 60 days later are late, and the others are
# older than their own third revision.
_IDLE = f"""{corpus("rev_part", "revs0")},
revs AS (SELECT path, ext, commit_id, CASE WHEN commit_id % 3 = 0 AND length(path) % 2 = 0 THEN commit_ts + INTERVAL 60 DAY ELSE commit_ts END AS commit_ts, message, content FROM revs0),
files AS (SELECT path || '@' || CAST(commit_id AS STRING) AS path, path AS real, lower(ext) AS ext, commit_id, commit_ts, message, content FROM revs),
{lexed()}, {stripped('prune')}, {rebuilt()},
kinds AS (SELECT f.real AS path, f.ext, f.commit_id, f.commit_ts, f.message, o.content AS code, f.content AS whole,
  lag(o.content) OVER w AS prev_code, lag(f.content) OVER w AS prev_whole, lag(f.commit_ts) OVER w AS prev_ts
  FROM files AS f LEFT JOIN out AS o ON o.path = f.path WINDOW w AS (PARTITION BY f.real ORDER BY commit_ts, commit_id)),
told AS (SELECT path, ext, commit_id, commit_ts, message,
    CASE WHEN prev_code IS NULL OR commit_ts - prev_ts > INTERVAL 30 DAY THEN 'new' WHEN code = prev_code AND prev_whole <> '' THEN 'comment_only' ELSE 'code' END AS kind
  FROM kinds
  UNION ALL SELECT path, ext, commit_id + 1000, commit_ts, message, 'late' FROM revs WHERE commit_id % 3 = 1)"""
ORACLES["stream_idle"] = f"WITH {_IDLE} SELECT * FROM told"
ORACLES["stream_late_counts"] = f"""WITH {_IDLE}
SELECT date_trunc('day', commit_ts) AS day, count(*) AS n_revisions, count(*) FILTER (WHERE kind = 'late') AS n_late FROM told GROUP BY 1"""
ORACLES["stream_density"] = f"""WITH {_change_parts()}, counts AS (SELECT {_COUNTS} FROM ls GROUP BY path)
SELECT date_trunc('day', commit_ts) AS day, f.ext, count(*) AS n_files, CAST(sum(n_comment) AS BIGINT) AS n_comment, CAST(sum(n_code) AS BIGINT) AS n_code,
  round(sum(n_comment) / nullif(sum(n_code), 0), 6) AS per_code
FROM files AS f JOIN counts AS c ON c.path = f.path GROUP BY ALL"""
ORACLES["stream_strict_prune"] = strict_sql(
    corpus("rev_part", "revs")
    + ", files AS (SELECT path || '@' || CAST(commit_id AS STRING) AS path, ext, content FROM revs)"
)
ORACLES["stream_prune"] = f"WITH {_change_parts()} SELECT path, content FROM out"

_TOK = "CASE WHEN ext IN ('.py', '.rb', '.sh', '.php') THEN '#' WHEN ext IN ('.html', '.vue', '.svelte') THEN '<!--' ELSE '//' END"
# The stand-in annotator puts one comment, with the number of lines, above line 1.
_ANNOTATED = f"""SELECT path, ext, {_TOK} || ' ' || CAST(len(string_split(content, chr(10))) AS VARCHAR) || ' lines'
  || CASE WHEN {_TOK} = '<!--' THEN ' [ds] -->' ELSE ' [ds]' END
  || {_EOL} || content AS content, CAST(NULL AS VARCHAR) AS err
FROM out WHERE trim(replace(content, chr(10), '')) <> ''"""
ORACLES["annotate_offline"] = f"WITH {corpus('src_part')}, {lexed()}, {stripped('clean')}, {rebuilt()} {_ANNOTATED}"

ORACLES["annotate_resumed"] = ORACLES["annotate_offline"]
ORACLES["request_log"] = f"""WITH {corpus('src_part')}, r AS (
  SELECT path, k, CASE WHEN k % 5 = 0 THEN 1 ELSE least(k % 4 + 1, 3) END AS used, k % 5 = 0 AS bad, k % 5 <> 0 AND k % 4 = 3 AS failed
  FROM files WHERE trim(replace(content, chr(10), '')) <> '')
SELECT path, CAST(used AS BIGINT) AS attempts_used, CASE WHEN bad THEN 'returned' WHEN failed THEN 'failed' ELSE 'done' END AS outcome,
  CAST(CASE WHEN bad THEN 400 WHEN NOT failed THEN 200 WHEN k % 2 = 1 THEN 429 ELSE 503 END AS BIGINT) AS status,
  CASE WHEN bad THEN 'bad request' WHEN failed THEN 'later' END AS error,
  CAST(CASE used WHEN 1 THEN 0 WHEN 2 THEN 1000 ELSE 3000 END AS BIGINT) AS waited_ms, CAST(0 AS BIGINT) AS n_extra
FROM r"""

# The sink holds every file: annotated ones (every third that is not empty), and the others as they were.
ORACLES["written_version"] = f"""WITH {corpus("src_part", "all_files")}, files AS (SELECT * FROM all_files WHERE k % 3 = 0),
{lexed()}, {stripped('clean')}, {rebuilt()}, new AS ({_ANNOTATED})
SELECT path, content FROM new
UNION ALL SELECT path, content FROM all_files WHERE path NOT IN (SELECT path FROM new)"""

_CODE_RUNS = """, joined AS (SELECT path, string_agg(CASE WHEN kind = 'code' THEN t ELSE chr(64976) END, '' ORDER BY seq) AS j FROM kd GROUP BY path)
SELECT path, unnest(r) AS text, CAST(generate_subscripts(r, 1) - 1 AS BIGINT) AS run_no FROM (SELECT path, string_split(j, chr(64976)) AS r FROM joined) AS x
UNION ALL SELECT path, '', 0 FROM files WHERE content = ''"""
ORACLES["current_version"] = ORACLES["written_version"]
ORACLES["tree_log"] = f"""WITH {corpus('src_part')}
SELECT CASE WHEN k % 7 = 2 THEN 'src' ELSE string_split(path, '/')[-1] END AS name,
  CASE WHEN k % 7 IN (1, 2, 3) THEN 'error' ELSE 'ok' END AS status, count(*) AS n FROM files GROUP BY ALL"""
ORACLES["part_code"] = f"WITH {corpus('src_part')}, {lexed()}{_CODE_RUNS}"
ORACLES["doc_code"] = f"WITH {corpus('docs_text')}, {lexed()}{_CODE_RUNS}"
ORACLES["stored_responses"] = ORACLES["response_errors"]
ORACLES["stored_suggestions"] = ORACLES["expanded_comments"]
ORACLES["target_bands"] = f"""WITH {corpus('src_part')}, {lexed()}, counts AS (SELECT {_COUNTS} FROM ls GROUP BY path),
d AS (SELECT path, round(n_comment / nullif(n_code, 0), 6) AS r, CASE length(path) % 3 WHEN 0 THEN 'light' WHEN 1 THEN 'default' ELSE 'full' END AS mode FROM counts)
SELECT path, mode, CASE mode WHEN 'light' THEN r BETWEEN 0.10 AND 0.20 WHEN 'default' THEN r BETWEEN 0.20 AND 0.35 ELSE r BETWEEN 0.60 AND 1.10 END AS in_band FROM d"""
ORACLES["scanned_tree"] = f"""WITH {corpus('src_part')}
SELECT path, ext, content FROM files WHERE trim(replace(content, chr(10), '')) <> ''
  AND path NOT LIKE '%/node_modules/%' AND path NOT LIKE '%/tests/%' AND path NOT LIKE '%/dist/%'"""

# What the longer queries read several times is computed once.
for _key, _sql in ORACLES.items():
    for _cte in ("ls", "pc", "b_ls", "merged", "b_merged", "spliced", "out"):
        _sql = _sql.replace(f"\n{_cte} AS (", f"\n{_cte} AS MATERIALIZED (").replace(f", {_cte} AS (", f", {_cte} AS MATERIALIZED (")
    ORACLES[_key] = _sql
