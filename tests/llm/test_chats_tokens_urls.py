import base64
import hashlib
import math
import re
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import byte_bpe, conversations, mixing, token_files, url_reputation, weighted_sampling
from marginalia.llm.oracles import ORACLES
from marginalia.llm.queries import END_OF_DOCUMENT, QUERIES, RULES, vocabulary_path

TURNS = "conv_id bigint, turn bigint, role string, text string"


# -- chats ------------------------------------------------------------------------------
def chat(conv, texts, start=0, gap=1):
    return [(conv, start + gap * i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]


def brute_chats(rows):
    """{conv_id: (text, equals)} of the conversations that are no prefix of a longer one.

    A repeated row is one turn; a prefix may end between turns of one number."""
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, set()).add((t, r, x))
    lists = {}
    for c, turns in by.items():
        first = min((t for t, _, _ in turns if t is not None), default=0)
        lists[c] = sorted((-1 if t is None else t - first, r is not None, r or "", x is not None, x or "") for t, r, x in turns)
    out = {}
    for c, own in lists.items():
        same = [k for k, other in lists.items() if other == own]
        low = min((k for k in same if k is not None), default=None)
        if c == low and not any(len(other) > len(own) and other[: len(own)] == own for other in lists.values()):
            said = "".join(f"<|im_start|>{p[2] if p[1] else 'unknown'}\n{p[4]}<|im_end|>\n" for p in own)
            out[c] = (said, len(same))
    return out


def odd_log():
    """Snapshots, repeated rows, turns of one number, gaps, nulls in every column, a crowded null id."""
    rows = chat(1, "ab") + chat(2, "abcd") + chat(3, "abcd") + chat(4, "abX") + chat(5, "a") + chat(6, "b")
    rows += chat(7, "abcdefghij", start=5) + chat(8, "abc", gap=2) + chat(9, "abc", start=3, gap=2) + chat(10, [None, ""])
    rows += [(11, 0, None, "q"), (11, 0, None, "q"), (11, 1, "user", "r"), (12, 0, None, "q"), (13, None, "user", "z"), (13, 0, "user", "a")]
    rows += [(14, 0, "user", "t1"), (14, 0, "user", "t2"), (14, 1, "user", "u"), (15, 0, "user", "t1"), (None, 0, "user", "alone")]
    rows += chat(20, [f"turn {i}" for i in range(9)]) + chat(21, [f"turn {i}" for i in range(8)])
    # a row logged twice in a snapshot, and a snapshot that ends between two turns of one number
    rows += [*chat(30, ["hi", "yo"]), (30, 1, "assistant", "yo"), *chat(31, ["hi", "yo", "bye"])]
    rows += [(32, 0, "user", "q"), (32, 1, "user", "a"), (32, 1, "user", "b"), (33, 0, "user", "q"), (33, 1, "user", "a")]
    rows += [(None, i % 3, "user", f"nobody's {i}") for i in range(700)] + [(40, None, None, f"none {i}") for i in range(300)]
    return rows


@pytest.mark.parametrize("block", [256, 2])
def test_snapshots_collapse(spark, block):
    rows = odd_log()
    got = conversations.format_chats(spark.createDataFrame(rows, TURNS).repartition(3), block).collect()
    texts, equal = {}, {}
    for r in sorted(got, key=lambda r: (str(r.conv_id), r.part)):
        texts[r.conv_id] = texts.get(r.conv_id, "") + r.text
        equal[r.conv_id] = r.n_equal
        assert r.n_turns <= block
    assert {c: (t, equal[c]) for c, t in texts.items()} == brute_chats(rows)
    assert 30 not in texts and 33 not in texts and 31 in texts and 32 in texts
    if block == 2:
        assert sum(1 for r in got if r.conv_id == 20) == 5


def test_the_registered_sql_agrees_on_an_odd_log(spark, tmp_path):
    log = spark.createDataFrame(odd_log(), TURNS)
    log.withColumn("slice", F.lit("a clashing name")).withColumn("n", F.lit(0)).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    columns = ["conv_id", "part", "n_turns", "n_equal", "text"]
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES['op1_chat_formatting']})").fetchall()
    got = QUERIES["op1_chat_formatting"](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and len(got) > 10


# -- byte-level BPE ---------------------------------------------------------------------
ODD = [
    None, "", " ", "  ", " a", "a ", "a  b", "a \n b", "\n\n x\ty ", "don't I'LL it's", "<|endoftext|> x", "é" * 50,
    "日本語 テスト", "🙂👩‍👩‍👧 x", "1234 56 7,8", "x" * 60_000, " x" * 3000 + "  ", "a\x85 b", "ß ẞ b", "!'s 's' ''", "a\u00a0b c",
]


def reference_ids(texts):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    tokens = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [tokens.encode_ordinary(t or "") for t in texts]


def test_ids_are_those_of_the_ranks_and_decode_back(spark, docs_of, prose, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT_PARTS", 50)
    texts = ODD + [prose(i, 200).replace("w7", "w7.\nAnd, ") for i in range(60)]
    docs = docs_of(list(enumerate(texts))).withColumn("ids", F.lit("taken"))
    got = {r.doc_id: r for r in byte_bpe.encode(docs, vocabulary_path(), offsets=True).collect()}
    for i, (text, ids) in enumerate(zip(texts, reference_ids(texts))):
        assert np.frombuffer(got[i].ids_, "<u4").tolist() == ids and got[i].n_tokens == len(ids) and got[i].ids == "taken"
        assert len(got[i].offsets) == len(ids) and sorted(got[i].offsets) == got[i].offsets
    back = byte_bpe.round_trip(docs, vocabulary_path()).collect()
    assert {r.doc_id: bytes(r.decoded) for r in back} == {i: (t or "").encode() for i, t in enumerate(texts)}
    assert byte_bpe.encode(docs.limit(0), vocabulary_path()).count() == 0


def test_ids_beyond_16_bits_are_not_narrowed():
    encoder = SimpleNamespace(size=np.zeros((1 << 16) + 1))
    with pytest.raises(ValueError, match="65536"):
        byte_bpe._fits(encoder, narrow=True)
    assert byte_bpe._fits(encoder, narrow=False) is encoder
    encoder.size = encoder.size[1:]
    assert byte_bpe._fits(encoder, narrow=True) is encoder


def test_split_characters(spark):
    encoder = byte_bpe.Encoder(vocabulary_path())
    ids = encoder.encode(["🙂 日"])[0]
    assert len(ids) // 4 > 3  # characters take several pieces
    assert b"".join(encoder.decode(ids[i : i + 4]) for i in range(0, len(ids), 4)) == "🙂 日".encode()
    offsets = encoder.char_offsets(ids).tolist()
    assert offsets[0] == offsets[1] == 0 and offsets[-1] == 2
    rows = spark.createDataFrame([(bytearray(ids[:4]),), (None,)], "ids binary")
    assert sorted(bytes(r.decoded) for r in byte_bpe.decode(rows, vocabulary_path()).collect()) == [b"", "🙂".encode()[: len(encoder.decode(ids[:4]))]]


# -- token files ------------------------------------------------------------------------
@pytest.mark.parametrize("width", [2, 4])
@pytest.mark.parametrize("block", [8, 64, 1 << 22])
def test_documents_are_found_across_blocks(spark, tmp_path, width, block):
    rng = np.random.default_rng(7)
    files = {}
    for f, lengths in enumerate([[0, 3, 0, 0, 17, 1, 40], [], [5], [0], list(rng.integers(0, 30, 50))]):
        ids = []
        for n in lengths:
            ids += [*rng.integers(0, 1000, n), 1000 + f * 0]
        tail = [1, 2, 3][: f % 3]
        files[f"f{f}"] = ([*lengths, *([len(tail)] if tail else [])], np.array([*ids, *tail], f"<u{width}"))
    files["odd"] = ([2], np.array([4, 5, 1000], f"<u{width}"))
    for name, (_, ids) in files.items():
        (tmp_path / name).write_bytes(ids.tobytes() + (b"\1" if name == "odd" else b""))
    got = token_files.token_counts(spark, str(tmp_path), 1000, width, block).collect()
    found = {name: [] for name in files}
    for r in sorted(got, key=lambda r: (r.file, r.doc_no)):
        found[r.file.rsplit("/", 1)[1]].append(r)
    for name, (lengths, _) in files.items():
        assert [r.n_tokens for r in found[name]] == [int(n) for n in lengths], name
        assert [r.doc_no for r in found[name]] == list(range(len(lengths)))
        assert [r.first_token for r in found[name]] == [sum(lengths[:i]) + i for i in range(len(lengths))]


def test_written_files_hold_what_was_encoded(spark, docs_of, prose, tmp_path):
    texts = [None, "", "a b", *[prose(i, 50 * i) for i in range(20)]]
    docs = byte_bpe.encode(docs_of(list(enumerate(texts))).repartition(3), vocabulary_path(), narrow=True)
    folder = str(tmp_path / "files")
    token_files.write_token_files(F.col("ids"), docs, folder, END_OF_DOCUMENT, 2)
    got = token_files.token_counts(spark, folder, END_OF_DOCUMENT, 2, block=256).collect()
    assert sorted(r.n_tokens for r in got) == sorted(map(len, reference_ids(texts)))


# -- URLs -------------------------------------------------------------------------------
def brute_rule(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule in RULES:
        name, slash, rest = rule.where.partition("/")
        fits = (host == name or host.endswith("." + name)) and path.startswith(slash + rest)
        if fits and (best is None or len(rule.where) > len(best)):
            best = rule.where
    return host, path, best


URLS = [
    None, "", "x", "http://", "http:///p", "http://A.Example.COM/en/1?q#f", "https://www.example.com/en/", "https://www.example.com/en",
    "http://notexample.com/en/", "http://com/", "http://com", "http://x.net/es/1", "http://x.net/ES/1", "http://x.net/fr/", "http://É.net/de",
    "ftp://a://b/c", "http://x.net?u=/es/", "http://y.co.uk/a", "http://z.y.co.uk/a\nb", "http://x.com#/", "http://x.com/a?b/c",
]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate([*URLS, *URLS])], "page_id bigint, url string, host string")
    outcomes = spark.createDataFrame([(1, True), (None, None)], "page_id bigint, good boolean")
    got = url_reputation.judge(pages, outcomes, RULES)
    assert got.columns == ["page_id", "url", "host", "host_", "path", "rule", "verdict", "bound"]
    rows = {r.page_id: r for r in got.collect()}
    assert len(rows) == 2 * len(URLS)
    verdicts = {r.where: r.verdict for r in RULES}
    for i, u in enumerate([*URLS, *URLS]):
        host, path, rule = brute_rule(u)
        assert (rows[i].host_, rows[i].path, rows[i].rule) == (host, path, rule), u
        assert rows[i].verdict in ("allow", "block") and (rule is None or rows[i].verdict == verdicts[rule])
    assert url_reputation.judge(pages.limit(0), outcomes, RULES).count() == 0
    assert url_reputation.judge(pages, outcomes.limit(0), []).where("verdict IS NULL").count() == 0


def test_hosts_shrink_towards_their_domain(spark):
    pages, good = [], []
    for host, n, rate in [("a.big.org", 200, 0.95), ("b.big.org", 2, 0.5), ("bad.foul.org", 200, 0.1), ("new.foul.org", 0, 0), ("s.lone.org", 1, 0)]:
        for k in range(max(n, 1)):
            pages.append((len(pages), f"http://{host}/{k}"))
            if n:
                good.append((len(pages) - 1, k < rate * n))
    frame = spark.createDataFrame(pages, "page_id bigint, url string")
    got = {r.host: r for r in url_reputation.reputations(frame, spark.createDataFrame(good, "page_id bigint, good boolean")).collect()}
    assert got["b.big.org"]["mean"] > 0.6 > got["bad.foul.org"]["mean"]
    assert got["new.foul.org"]["mean"] < got["s.lone.org"]["mean"] < got["b.big.org"]["mean"]
    assert got["b.big.org"].bound < got["a.big.org"].bound and got["new.foul.org"].n == 0
    assert got["b.big.org"].domain == "big.org" and got["b.big.org"].suffix == "org"


# -- mixing -----------------------------------------------------------------------------
def poisson_inverse(mean, u):
    k, p = 0, math.exp(-mean)
    below = p
    while below <= u:
        k += 1
        p *= mean / k
        below += p
        if p < 1e-18:
            break
    return k


@pytest.mark.parametrize("mean", [0.0, 0.2, 1.0, 7.5, 16.0])
def test_poisson_table(spark, mean):
    table = spark.range(1).select(mixing.poisson_table(F.lit(mean)).alias("t")).first().t
    for u in (0.0, 0.1, 0.5, 0.9, 0.999, 1 - 2**-40):
        assert sum(x <= u for x in table) == poisson_inverse(mean, u)
    assert table[-1] > 1 - 1e-12


def test_shares_come_out_and_runs_agree(spark, docs_of):
    rows = [(i, "x" * (i % 50)) for i in range(6000)]
    docs = docs_of(rows)
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 2, None).otherwise(F.col("source"))).withColumn("copy", F.lit("c"))
    out = mixing.mix(docs.repartition(5), {"src0": 0.6, "src1": 0.1}, 0.3, seed=3).cache()
    assert out.columns == [*docs.columns, "copy_"]
    sizes = {r.source: r.n for r in out.groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    total = sum(sizes.values())
    for source, share in (("src0", 0.6), ("src1", 0.1), (None, 0.3)):
        assert abs(sizes[source] / total - share) < 0.02
    again = mixing.mix(docs, {"src0": 0.6, "src1": 0.1}, 0.3, seed=3)
    assert sorted(map(tuple, out.select("doc_id", "copy_").collect())) == sorted(map(tuple, again.select("doc_id", "copy_").collect()))
    counts = [r.n for r in out.where("source = 'src0'").groupBy("doc_id").agg(F.count("*").alias("n")).collect()]
    assert abs(sum(counts) / 2000 - 1.8) < 0.1 and abs(1 - len(counts) / 2000 - math.exp(-1.8)) < 0.03
    assert len({r.doc_id // 1000 for r in out.limit(50).collect()}) > 3  # shuffled


def test_large_rates_and_odd_rows(spark, docs_of):
    docs = docs_of([(i, "ab") for i in range(300)] + [(None, None), (None, ""), (5, "ab"), (6, "ab"), (1000, "y" * 5_000)])
    out = mixing.mix(docs, {"src0": 1.0, "src1": 0.0}, 0.0, total=1.0, seed=1)
    rate = {r.source_group: r.rate for r in mixing.rates(docs, {"src0": 1.0, "src1": 0.0}, 0.0).collect()}
    assert rate["src1"] == 0 and rate[None] == 0 and rate["src0"] > 16
    assert abs(out.groupBy("doc_id").count().agg(F.avg("count")).first()[0] / rate["src0"] - 1) < 0.1
    assert mixing.mix(docs.limit(0), {"src0": 1.0}, 0.5).count() == 0
    empty = docs_of([(1, ""), (2, None)])
    assert mixing.mix(empty, {"src0": 0.5}, 0.5).columns[-1] == "copy"


# -- fingerprints -----------------------------------------------------------------------
def test_edited_texts_and_their_digests(spark, docs_of, prose):
    rows = [(3 * i, prose(i, 5 + 13 * i)) for i in range(30)] + [(1, ""), (2, None), (4, "é🙂a"), (5, "abcdefgh"), (5, "abcdefgh"), (None, "null id"), (400, "z" * 50_000)]
    got = weighted_sampling.edited_fingerprints(docs_of(rows).repartition(3)).collect()
    assert len(got) == len(rows)
    order = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.n_chars, r.edited_sha256, r.fingerprint, r.near_edited, r.near_next))
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        take = len(t) // 4
        new = t[: len(t) - take] + following[:take]
        ((n, sha, fingerprint, near_edited, near_next),) = by[i]
        assert (n, sha) == (len(t), hashlib.sha256(new.encode()).hexdigest()), i
        assert 0 <= near_edited <= 1 and 0 <= near_next <= 1 and len(fingerprint) == 8 * weighted_sampling.SAMPLES
    assert weighted_sampling.edited_fingerprints(docs_of([])).count() == 0
    (alone,) = weighted_sampling.edited_fingerprints(docs_of([(1, "a b")])).collect()
    assert alone.near_next == 1


def test_collision_rate_is_the_generalised_jaccard_similarity(spark):
    rng = np.random.default_rng(11)
    pairs, want = [], []
    for i in range(60):
        a, b = rng.integers(0, 6, 40), rng.integers(0, 6, 40)
        b = np.where(rng.random(40) < 0.6, a, b)
        want.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
        text = lambda w, i=i: " ".join(f"t{i}_{k}" for k, n in enumerate(w) for _ in range(n))
        pairs.append((i, text(a), text(b)))
    frame = spark.createDataFrame(pairs, "i long, a string, b string")
    found = weighted_sampling.fingerprints(frame, ["i"], {"a": "x", "b": "y"}, samples=48)
    near = found.select("i", weighted_sampling.likeness(F.col("x"), F.col("y"), 48).alias("n")).collect()
    got = np.array([r.n for r in sorted(near, key=lambda r: r.i)])
    want = np.array(want)
    assert abs(got.mean() - want.mean()) < 0.03
    assert np.abs(got - want).max() < 0.3


def test_likeness_with_the_number_of_samples_of_the_query(spark):
    pairs = [(i, " ".join(f"t{i}_{k}" for k in range(60)), " ".join(f"t{i}_{k}" for k in range(15, 75))) for i in range(120)]
    frame = spark.createDataFrame(pairs, "i long, a string, b string")
    found = weighted_sampling.fingerprints(frame, ["i"], {"a": "x", "b": "y"})
    near = found.select(weighted_sampling.likeness(F.col("x"), F.col("y")).alias("n")).collect()
    off = np.array([r.n for r in near]) - 45 / 75
    assert abs(off.mean()) < 0.03 and np.sqrt((off**2).mean()) < 0.09 and (np.abs(off) > 0.2).mean() < 0.03


def test_weights_count_words(spark):
    row = spark.createDataFrame([("b a\tb  c b",)], "t string").select(weighted_sampling.term_weights(F.col("t")).alias("w")).first()
    assert sorted(x.weight for x in row.w) == [1, 1, 3]
