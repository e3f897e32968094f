import base64
import gzip
import hashlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import fill_in_middle, vector_codes, warc
from marginalia.llm.frames import stored

VECTORS = "vec_id bigint, label int, embedding array<float>, code string, part int"
PAGES = "page_id bigint, url string, html string, row string, key int"


# -- fill in the middle -----------------------------------------------------------------
def plain_middle(doc_id, text, seed=1, transformed=90, suffix_first=20):
    """(n, form, prefix, middle, output) with slices of the text."""
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= transformed:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < suffix_first:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def middle_rows():
    rng = random.Random(13)
    alphabet = "abé漢🙂́\n\0<>PSM "
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 3, 7, 40, 300])))) for i in range(400)]
    rows += [(None, None), (None, "no id"), (1000, None), (1001, ""), (1002, "has <P> inside"), (1003, "<M>"), (1003, "<M>")]
    rows += [(1004, "<<S"), (1005, "é" * 300_000), (-7, "negative"), (1006, "twice"), (1006, "twice")]
    return rows


@pytest.mark.parametrize("seed, transformed, suffix_first", [(1, 90, 20), (2, 100, 100), (3, 100, 0), (4, 0, 50)])
def test_middles_match_slices_and_restore(spark, seed, transformed, suffix_first):
    rows = middle_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("form", F.lit(1)).repartition(5)
    made = fill_in_middle.transform(docs, seed, transformed=transformed, suffix_first=suffix_first)
    got = fill_in_middle.restore(made).collect()
    want = [(i, *plain_middle(i, t, seed, transformed, suffix_first), t or "") for i, t in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert fill_in_middle.restore(fill_in_middle.transform(docs.limit(0))).count() == 0


def test_rotation_needs_no_room_and_inverts():
    data = bytearray(b"0123456789")
    fill_in_middle.rotate(data, 2, 5, 9)
    assert data == b"0156782349"
    fill_in_middle.rotate(data, 2, 6, 9)
    assert data == b"0123456789"


def test_sentinels_that_could_be_misread_are_refused(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id bigint, text string")
    for bad in (("aba", "<S>", "<M>"), ("<P>", "<P>", "<M>"), ("<P>", "x<P>x", "<M>"), ("", "<S>", "<M>"), ("ab", "bc", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle.transform(docs, sentinels=bad)
    row = fill_in_middle.restore(fill_in_middle.transform(docs, 1, sentinels=("[1]", "[22]", "[333]"), transformed=100), ("[1]", "[22]", "[333]")).first()
    assert row.restored == "text" and "[333]" in row.output


# -- vector codes -----------------------------------------------------------------------
def plain_codes(rows, parts, entries, rounds, scale=256):
    """[(vec_id, code, error, label_error)] and the books, by comparing every part with every entry."""
    kept = [(i, label, [int(np.floor(float(np.float32(x)) * scale)) for x in v]) for i, label, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    dim = len(kept[0][2])
    width = -(-dim // parts)
    cut = lambda v: [(v + [0] * (parts * width - dim))[p * width : (p + 1) * width] for p in range(parts)]
    fit = [r for r in kept if len(r[2]) == dim]
    books = [[cut(r[2])[p] for r in fit[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        groups = {}
        for _, _, v in fit:
            for p, x in enumerate(cut(v)):
                groups.setdefault((p, nearest(p, x)[1]), []).append(x)
        for (p, i), members in groups.items():
            books[p][i] = [sum(c) // len(members) for c in zip(*members)]
    out = []
    for i, label, v in kept:
        if len(v) != dim:
            out.append((i, label, None, None))
            continue
        found = [nearest(p, x) for p, x in enumerate(cut(v))]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    sums = {}
    for _, label, _, e in out:
        if e is not None:
            sums[label] = sums.get(label, 0) + e
    return [(i, c, e, sums.get(label)) for i, label, c, e in out], books


def vector_rows(n, dim, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(3)), [float(x) for x in rng.normal(0, spread, dim).round(2).astype(np.float32)]) for i in range(n)]
    rows += [(n, None, rows[0][2]), (n + 1, None, rows[1][2]), (n + 1, None, rows[1][2]), (None, 1, rows[2][2])]
    rows += [(n + 2, 1, None), (n + 3, 1, [None] * dim), (n + 4, 1, [float("nan")] * dim), (n + 5, 1, [float("inf")] + [0.0] * (dim - 1))]
    rows += [(n + 6, 7, [1.0]), (n + 7, 7, []), (-1, 2, [0.0] * dim), (-2, 2, [-0.001] * dim), (n + 8, 2, [300.0] * dim)]
    return rows


@pytest.mark.parametrize("n, dim, parts, entries, rounds, spread", [(150, 12, 4, 16, 2, 1.0), (90, 10, 4, 64, 2, 0.01), (60, 5, 5, 8, 1, 1.0), (20, 6, 2, 64, 2, 1.0)])
def test_codes_match_brute_force(spark, n, dim, parts, entries, rounds, spread):
    rows = vector_rows(n, dim, n, spread)
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], VECTORS).repartition(3)
    want, books = plain_codes(rows, parts, entries, rounds)
    got = vector_codes.compress(df, parts=parts, entries=entries, rounds=rounds).collect()
    assert sorted(repr(tuple(r)[:4]) for r in got) == sorted(map(repr, want))
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(text.encode()).hexdigest()}


def test_search_goes_on_at_an_equal_bound():
    """The bound must be strictly greater: an entry of a smaller number at the very same distance wins."""
    books = vector_codes.Codebooks(np.array([[[2, 2], [0, 0], [-2, -2], [2, 2]]]), 2)
    which, far = books.nearest(np.array([[1, 1], [-1, -1], [0, 0], [9, 9]]))
    assert which.tolist() == [[0], [1], [1], [0]] and far.tolist() == [[2], [2], [0], [98]]


def test_codes_decode_to_their_entries(spark):
    rows = spark.createDataFrame([(*r, "", 0) for r in vector_rows(80, 8, 1)], VECTORS)
    ready = vector_codes.prepared(rows)
    books = vector_codes.fit(ready, 4, 16, 2)
    coded = vector_codes.encode(ready, books).join(ready.select("vec_id", "v"), "vec_id").where("code IS NOT NULL")
    for r in vector_codes.decode(coded, books).collect():
        assert len(r.decoded) == 8 and (r.vec_id is None or r.vec_id == 81 or sum((a - b) ** 2 for a, b in zip(r.decoded, r.v)) == r.error)


def test_no_usable_vectors(spark):
    rows = spark.createDataFrame([(1, 1, None, "", 0), (2, 1, [float("nan")], "", 0)], VECTORS)
    assert vector_codes.compress(rows).collect() == [] == vector_codes.compress(rows.limit(0)).collect()


# -- archives ---------------------------------------------------------------------------
def page_rows():
    rng = random.Random(3)
    rows = [(i, f"http://h{i % 3}.org/{i}", "".join(rng.choice("abc é<p>\n") for _ in range(rng.randrange(4000)))) for i in range(60)]
    rows += [(100 + i, "http://copy.org/", "the same page " * 40) for i in range(25)]
    rows += [(200, None, None), (201, "http://e.org/", ""), (202, "http://bad url\r\nX: y", "odd url"), (None, "u", "alone"), (None, "u", "the same page " * 40)]
    rows += [(203, "u", "again"), (203, "u", "again"), (204, "u", "WARC/1.1\r\n\r\n" * 30), (205, "u", "漢" * 200_000)]
    return rows


def plain_types(rows, least):
    out = []
    for k, (i, _, html) in enumerate(rows):
        body = (html or "").encode()
        same = [(j is not None, j or 0, m) for m, (j, _, h) in enumerate(rows) if (h or "").encode() == body]
        revisit = len(body) >= least and max(same)[2] != k
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        top = max(same)
        out.append((i, len(body), digest, "revisit" if revisit else "response", (top[1] if top[0] else None) if revisit else None))
    return out


@pytest.mark.parametrize("least, size", [(0, warc.RANGE), (0, 997), (100, 5000)])
def test_archives_round_trip(spark, tmp_path, least, size):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], PAGES).repartition(3)
    warc.write_archives(pages, str(tmp_path / "w"), least_bytes=least)
    found = warc.outermost(stored(warc.read_archives(spark, str(tmp_path / "w"), size), "records"), size)
    records = [r for r in found.withColumn("page", warc.page_id_of("record_id")).withColumn("first", warc.page_id_of("refers_to_id")).collect() if r.record_type != "warcinfo"]
    got = [(r.page, r.payload_bytes, r.payload_digest, r.record_type, r.first) for r in records]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_types(rows, least)))
    assert all(r.intact for r in records) and len({r.record_id for r in records}) == len(rows)
    by_id = {r.record_id: r.payload for r in records if r.record_type == "response"}
    texts = sorted(bytes(by_id[r.refers_to_id] if r.record_type == "revisit" else r.payload).decode() for r in records)
    assert texts == sorted(html or "" for _, _, html in rows)
    # the files are archives that any reader can unpack, member by member
    for path in (tmp_path / "w").glob("part-*"):
        plain = gzip.decompress(path.read_bytes())
        assert plain.count(b"WARC/1.1\r\nWARC-Type:") == sum(1 for r in records if r.file.endswith(path.name)) + plain.count(b"WARC-Type: warcinfo")


def test_ranges_own_records_and_pass_over_what_is_none(spark, tmp_path):
    inner = warc.INFO  # a whole archive as a payload that is stored as it is
    outer = io.BytesIO()
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:outer>\r\nContent-Length: {50_000 + len(inner)}\r\n\r\n"
    with gzip.GzipFile(fileobj=outer, mode="wb", compresslevel=0, mtime=0) as f:
        f.write(head.encode() + bytes(25_000) + inner + bytes(25_000) + b"\r\n\r\n")
    broken = bytearray(warc.INFO)
    broken[-3] ^= 1  # a wrong length
    data = b"junk" + outer.getvalue() + warc.MAGIC * 5 + bytes(broken) + gzip.compress(b"no record", mtime=0) + warc.INFO + b"\x1f\x8b"
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc.gz").write_bytes(data)
    (tmp_path / "a" / "empty.warc.gz").write_bytes(b"")
    starts = [4, data.rindex(warc.INFO)]
    for size in (warc.RANGE, 20_000, 777, len(outer.getvalue()) + 4):
        all_ = stored(warc.read_archives(spark, str(tmp_path / "a"), size), "records")
        assert sorted(r.offset for r in warc.outermost(all_, size).collect()) == starts
    assert all_.where("offset = 4").first().payload_bytes == 50_000 + len(inner)
    (tmp_path / "none").mkdir()
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_pages_may_be_missing(spark, tmp_path):
    none = spark.createDataFrame([], PAGES)
    warc.write_archives(none, str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0


def test_a_hot_payload_is_told_to_its_rows_by_salts(spark, tmp_path):
    """One payload holds nearly all rows: one response, and no row is lost."""
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("hot").alias("html"))
    warc.write_archives(pages, str(tmp_path / "w"))
    kinds = {r.record_type: r["count"] for r in warc.read_archives(spark, str(tmp_path / "w")).groupBy("record_type").count().collect()}
    assert kinds["response"] == 1 and kinds["revisit"] == 2999
