"""DuckDB SQL for the queries of this subpackage that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op1_chat_formatting"] = r"""
WITH whole AS MATERIALIZED (
  SELECT conv_id, list({'p': turn - first, 'r': role, 't': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns
  FROM (SELECT DISTINCT conv_id, turn, role, text, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations)
  GROUP BY conv_id),
one AS MATERIALIZED (SELECT turns, min(conv_id) AS conv_id, count(*) AS n_equal FROM whole GROUP BY turns),
parts AS (
  SELECT DISTINCT turns[1:i] AS turns
  FROM (SELECT turns, unnest(range(1, len(turns))) AS i FROM one)),
kept AS (SELECT * FROM one WHERE turns NOT IN (SELECT turns FROM parts)),
turn_rows AS (
  SELECT conv_id, n_equal, unnest(range(1, len(turns) + 1)) AS i, unnest(turns) AS t FROM kept)
SELECT conv_id, ((i - 1) // 256)::BIGINT AS part, count(*) AS n_turns, n_equal,
  string_agg('<|im_start|>' || coalesce(t.r, 'unknown') || chr(10) || coalesce(t.t, '') || '<|im_end|>' || chr(10), '' ORDER BY i) AS text
FROM turn_rows GROUP BY conv_id, part, n_equal
"""

ORACLES["op2_ngram_join"] = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]))
    WHEN len(w) > 0 THEN [w] ELSE [] END AS s FROM w),
t AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
common AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS shared
  FROM t AS a JOIN t AS b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common WHERE 100 * shared >= 90 * (na + nb - shared)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS other FROM s
  UNION SELECT reach.node, edges.b FROM reach JOIN edges ON reach.other = edges.a)
SELECT s.doc_id, len(s.s) AS n_shingles, r.component_id
FROM s JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) AS r ON r.node = s.doc_id
"""

ORACLES["op6_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW same AS (PARTITION BY t)
"""


def _level(name: str, rows: str) -> str:
    """CTEs for one level of the reputation: the strength of its prior, and its posterior."""
    return f"""
{name}_in AS MATERIALIZED ({rows}),
{name}_rho AS (
  SELECT CASE WHEN sum(n) > count(*) THEN (sum(n * (k / n - r) * (k / n - r) / (r * (1 - r))) - count(*)) / (sum(n) - count(*)) ELSE 0.5 END AS rho
  FROM (SELECT n::DOUBLE AS n, k::DOUBLE AS k, greatest(least(prior, 1 - 1e-6), 1e-6) AS r FROM {name}_in WHERE n > 0)),
{name}_s AS (SELECT coalesce(1 / greatest(least(rho, 0.99), 0.001) - 1, 1.0) AS s FROM {name}_rho),
{name}_p AS MATERIALIZED (SELECT *, k + s * prior AS a, n - k + s * (1 - prior) AS b FROM {name}_in, {name}_s)"""


ORACLES["op5_url_filter"] = f"""
WITH p AS MATERIALIZED (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
good AS (SELECT doc_id AS page_id, bool_and(quality = 1 AND toxic = 0) AS good FROM labels GROUP BY doc_id),
h0 AS (SELECT host, count(good) AS n, coalesce(sum(good::INT), 0)::BIGINT AS k FROM p LEFT JOIN good USING (page_id) GROUP BY host),
h1 AS (SELECT *, string_split(host, '.') AS l FROM h0),
h2 AS (SELECT *, CASE WHEN array_to_string(l[-2:], '.') IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.nz', 'co.in') AND len(l) > 2
  THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix FROM h1),
h AS MATERIALIZED (SELECT host, n, k, suffix, CASE WHEN len(l) <= len(string_split(suffix, '.')) THEN host
  ELSE array_to_string(l[-(len(string_split(suffix, '.')) + 1):], '.') END AS domain FROM h2),
d AS MATERIALIZED (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM h GROUP BY ALL),
{_level("s", "SELECT suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k, (SELECT (sum(k) + 1.0) / (sum(n) + 2.0) FROM h) AS prior FROM d GROUP BY suffix")},
{_level("d", "SELECT d.*, a / (a + b) AS prior FROM d JOIN (SELECT suffix, a, b FROM s_p) USING (suffix)")},
{_level("h", "SELECT h.*, a / (a + b) AS prior FROM h JOIN (SELECT domain, a, b FROM d_p) USING (domain)")},
bound AS (SELECT host, greatest(a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 0.0) AS bound FROM h_p),
r AS (SELECT *, CASE
  WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM p JOIN bound USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN bound >= 0.5 THEN 'allow' ELSE 'block' END AS verdict, round(bound, 8) AS bound FROM r
"""

ORACLES["op13_fill_in_middle"] = r"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (
  SELECT doc_id, t, n, [('0x' || h[8 * i + 1:8 * i + 8])::BIGINT FOR i IN range(4)] AS h FROM h),
c AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
      WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1, n - b) || '<M>' || substr(t, a + 1, b - a)
    ELSE '<S>' || substr(t, b + 1, n - b) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END AS output
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(output) AS output_sha256, sha256(t) AS restored_sha256
FROM o
"""

ORACLES["op12_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (
  SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, max(page_id) OVER same AS top,
    row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) = 1 AS first
  FROM p WINDOW same AS (PARTITION BY html)),
v AS (SELECT *, [('0x' || h[5 * g + 1:5 * g + 5])::BIGINT FOR g IN range(8)] AS v FROM s)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN NOT first THEN top END AS refers_to
FROM v
"""

_CODES = """
b{r} AS MATERIALIZED (
  SELECT vec_id, n, p, x, min(far * 64 + entry) AS best
  FROM (SELECT a.vec_id, a.n, a.p, a.x, c.entry,
      list_sum([(a.x[i] - c.x[i]) * (a.x[i] - c.x[i]) FOR i IN range(1, len(a.x) + 1)])::HUGEINT AS far
    FROM parts AS a JOIN c{r} AS c USING (p))
  GROUP BY vec_id, n, p, x)"""

_MOVED = """,
m{r} AS (
  SELECT p, entry, i, floor(sum(v)::DOUBLE / count(*))::BIGINT AS v
  FROM (SELECT p, best % 64 AS entry, unnest(x) AS v, unnest(range(len(x))) AS i FROM b{r}) GROUP BY p, entry, i),
c{next} AS MATERIALIZED (
  SELECT p, entry, coalesce(m.x, c.x) AS x
  FROM c{r} AS c LEFT JOIN (SELECT p, entry, list(v ORDER BY i) AS x FROM m{r} GROUP BY p, entry) AS m USING (p, entry)),"""

ORACLES["op11_vector_codes"] = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, [floor(x::DOUBLE * 256)::BIGINT FOR x IN embedding] AS v,
    row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS n
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, n, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS x
  FROM kept, (SELECT unnest(range(16)) AS p)),
c0 AS MATERIALIZED (SELECT p, n AS entry, x FROM parts WHERE n < 64),
{_CODES.format(r=0)}{_MOVED.format(r=0, next=1)}
{_CODES.format(r=1)}{_MOVED.format(r=1, next=2)}
{_CODES.format(r=2)},
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, entry)) AS h FROM c2),
coded AS (
  SELECT n, string_agg(printf('%02x', (best % 64)::BIGINT), '' ORDER BY p) AS code, sum(best // 64)::BIGINT AS error
  FROM b2 GROUP BY n)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
FROM kept JOIN coded USING (n), books
"""
