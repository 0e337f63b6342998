"""Periodic runs against brute force."""

import hashlib
import zlib

import numpy as np
import pytest

from verdigate.llm import runs


def brute(words, shortest=12):
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i - start >= p and i - start + p >= shortest:
                found.setdefault((start, i + p), p)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def sequence(documents):
    known, parts, separator = {}, [], 10**6
    for words in documents:
        parts += [known.setdefault(w, len(known) + 1) for w in words] + [separator]
        separator += 1
    return np.array(parts, np.int64), np.array([len(w) for w in documents], np.int64)


def test_cover_and_its_shifts():
    inside = set(runs.COVER)
    for i in range(runs.MODULUS):
        for j in range(runs.MODULUS):
            s = runs.SHIFTS[i, j]
            assert (i + s) % runs.MODULUS in inside and (j + s) % runs.MODULUS in inside
    with pytest.raises(ValueError):
        runs.shift_table(8, (0, 1))


@pytest.mark.parametrize("letters", [1, 2, 3, 40])
def test_extensions(letters):
    words = np.random.default_rng(letters).integers(1, letters + 1, 400)
    words[200:390] = words[10:200]
    lce = runs.Extensions(words)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(400), np.arange(400)))
    a, b = a[a != b], b[a != b]
    got = lce.of(a, b)
    want = np.zeros((401, 401), int)
    for i in range(399, -1, -1):
        for j in range(399, -1, -1):
            want[i, j] = want[i + 1, j + 1] + 1 if words[i] == words[j] else 0
    assert (got == want[a, b]).all()


def test_runs_of_joined_documents(monkeypatch):
    rng, total = np.random.default_rng(0), 0
    for pieces in (1 << 20, 50):
        monkeypatch.setattr(runs, "PLACES_AT_ONCE", pieces)
        for _ in range(120):
            documents = []
            for _ in range(rng.integers(1, 8)):
                n, letters = int(rng.integers(0, 160)), int(rng.integers(1, 4))
                words = list(rng.integers(0, letters, n))
                if rng.random() < 0.5 and n > 10:
                    p, s = int(rng.integers(1, n // 2 + 1)), int(rng.integers(0, n))
                    for i in range(s + p, n):
                        words[i] = words[i - p]
                documents.append(words)
            want = [(k, *r) for k, w in enumerate(documents) for r in brute(w)]
            got = [tuple(r) for r in runs.find_runs(*sequence(documents)).tolist()]
            assert got == want
            total += len(want)
    assert total > 500


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    dropped = {i for s, length, p in found for i in range(s + p, s + length)}
    left = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    listed = "".join(f"{s},{length},{p}\n" for s, length, p in found)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return (
        doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2],
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest(),
    )


def test_rows(spark):
    words = [f"w{i * i % 97}" for i in range(700)]
    texts = [None, "", " \n\t", "a", "a " * 11, "a " * 12, "a b c " * 4, "ünï cödé " * 30, " ".join(words),
             "x y " * 3000, " a b " * 20, "a a b " * 9 + "q " * 13]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(i, " ".join(words[: 20 + i]), 1) for i in range(100, 160)]
    rows += [rows[5], rows[5], (None, "a " * 30, 1)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_runs int")
    order = lambda r: str(r)
    got = sorted(map(tuple, runs.periodic_runs(docs).collect()), key=order)
    assert got == sorted((expected(i, t) for i, t, _ in rows), key=order)
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    short = [r for r in docs.collect() if len(r.text or "") < 20_000]
    got = {r.doc_id: tuple(r) for r in runs.periodic_runs(docs).collect()}
    assert len(got) == docs.count()
    assert all(got[r.doc_id] == expected(r.doc_id, r.text) for r in short)
    assert sum(r[1] > 0 for r in got.values()) > 10
