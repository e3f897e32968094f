import hashlib
import re

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    def build(rows):
        """documents from (doc_id, text) pairs; sources take turns."""
        full = [(i, t, "en", f"src{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, DOCS)

    return build


@pytest.fixture(scope="session")
def prose():
    """Deterministic invented text: word number k of text i."""

    def make(i, n, vocabulary=400):
        words = []
        for k in range(n):
            h = int(hashlib.md5(f"{i}/{k}".encode()).hexdigest(), 16)
            words.append("w" + format(h % vocabulary, "x"))
        return " ".join(words)

    return make


def shingle_set(text, k):
    words = re.findall(rb"[^\x20\x09-\x0d]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute_classes(rows, k, num, den):
    """{doc_id: (set size, smallest doc_id linked)} by comparing all pairs."""
    sets = {i: shingle_set(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}
