"""The Merkle manifest against brute force."""

import hashlib
import zlib

import pytest

from verdigate.llm import manifest
from verdigate.llm.common import Scratch


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def siblings(levels, at, fanout):
    for nodes in levels[:-1]:
        begin = at // fanout * fanout
        yield nodes[begin:at], nodes[at + 1 : begin + fanout]
        at //= fanout


def brute(rows, fanout):
    trees = {}
    for doc_id, text, lang, source, n_chars in rows:
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n_chars is not None
        own = leaf((doc_id, source, lang, n_chars, text))
        changed = leaf((doc_id, source, lang, n_chars + hit if n_chars is not None else None, text))
        trees.setdefault(lang, []).append((doc_id is not None, doc_id or 0, own, changed, doc_id))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for rows in trees.values():
        rows.sort(key=lambda r: r[:3])
    lower = [climb([r[2] for r in trees[x]], fanout) for x in langs]
    upper = climb([levels[-1][0] for levels in lower], fanout)
    root = upper[-1][0] if langs else None
    made = []
    for k, x in enumerate(langs):
        for i, (_, _, own, digest, doc_id) in enumerate(trees[x]):
            proof = ""
            for left, right in [*siblings(lower[k], i, fanout), *siblings(upper, k, fanout)]:
                proof += "".join(left + right)
                digest = sha(*left, digest, *right)
            made.append((doc_id, own, lower[k][-1][0], root, sha(proof), digest, digest == root))
    return sorted(made, key=str)


COLUMNS = "doc_id int, text string, lang string, source string, n_chars int, root int, _pos int"


def rows_of(langs, n):
    rows = [
        (i * 7 % 1000, None if i % 11 == 0 else f"text {i} ü", langs[i % len(langs)], None if i % 5 == 0 else "s", None if i % 13 == 0 else i)
        for i in range(n)
    ]
    return [*rows, rows[-1], rows[-1], (None, "x", langs[0], "s", 1), (None, None, None, None, None), (5, "", "zz", "", 0)]


@pytest.mark.parametrize(
    "fanout, block, langs, n",
    [(2, 8, ["en", None, "de", "é"], 150), (3, 9, ["en"], 100), (2, 4096, ["en", "fr"], 64), (5, 7, [f"l{i}" for i in range(40)], 150), (2, 4, ["en"], 1)],
)
def test_manifest(spark, monkeypatch, fanout, block, langs, n):
    monkeypatch.setattr(manifest, "BLOCK", block)
    rows = rows_of(langs, n)
    docs = spark.createDataFrame([(*r, 1, 1) for r in rows], COLUMNS)
    got = sorted(map(tuple, manifest.merkle_manifest(docs, Scratch(spark), fanout).collect()), key=str)
    assert got == brute(rows, fanout)
    assert {r[6] for r in got} <= {True, False} and any(not r[6] for r in got) == (n > 1)


def test_no_rows(spark):
    docs = spark.createDataFrame([], COLUMNS)
    found = manifest.merkle_manifest(docs, Scratch(spark))
    assert found.count() == 0 and found.columns[-1] == "verified"


def test_parents_resume_from_a_copy():
    children = [sha(str(i)) for i in range(4)]
    parent = manifest.Parent(children)
    for slot in range(4):
        other = [*children[:slot], sha("new"), *children[slot + 1 :]]
        assert parent.resumed(slot, sha("new")) == sha(*other) != parent.digest
    assert parent.digest == sha(*children)
