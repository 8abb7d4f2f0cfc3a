"""Periodic runs against brute force, and on odd input."""

import hashlib
import random
import time
import zlib

import pytest

from quillspark.llm import runs

WORD = __import__("re").compile(rb"[^\x20\x09-\x0D]+")


def by_brute_force(w, least=12):
    """Every stretch of each period, the smallest period of each."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(least, 2 * q):
                out.setdefault((s, i - s + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def made(rng):
    kind, n = rng.randrange(4), rng.randrange(120)
    if kind == 0:
        return rng.choices("ab", k=n)
    if kind == 1:
        a, b = "a", "ab"
        while len(b) < n:
            a, b = b, b + a
        return list(b[:n])
    base = rng.choices("abcdef"[: rng.randrange(2, 7)], k=rng.randrange(1, 30))
    w = base * rng.randrange(1, 6) + ["z"] + base * rng.randrange(1, 4)
    for _ in range(rng.randrange(3)):
        w[rng.randrange(len(w))] = "q"
    return w * rng.randrange(1, 4) if kind == 3 else rng.choices("abc", k=5) + w


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_by_brute_force(least):
    rng = random.Random(least)
    for _ in range(150):
        docs = [made(rng) for _ in range(rng.randrange(1, 10))] + [[]]
        for w, found in zip(docs, runs.find_runs(docs, least), strict=True):
            assert found == by_brute_force(w, least), w


def test_previous_factors():
    rng = random.Random(2)
    for _ in range(100):
        w = rng.choices("abc", k=rng.randrange(1, 40))
        import numpy as np

        index = runs.Index(np.array([ord(c) for c in w]), np.full(len(w), len(w)))
        assert [w[s:] for s in index.suffixes] == sorted(w[i:] for i in range(len(w)))
        length, source = runs.previous_factors(index.suffixes.tolist(), index.lcp.tolist(), 0)
        common = lambda a, b: next((k for k in range(len(w) - b) if w[a + k] != w[b + k]), len(w) - b)
        assert length == [max((common(j, i) for j in range(i)), default=0) for i in range(len(w))]
        assert all(s < i and common(s, i) == n for i, (n, s) in enumerate(zip(length, source, strict=True)) if n)


def test_long_runs_take_linear_time():
    took = []
    for n in (50_000, 200_000):
        began = time.process_time()
        assert [len(r) for r in runs.find_runs([["a"] * n, ["a", "b", "c"] * (n // 3), list(map(str, range(n)))])] == [1, 1, 0]
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0]


def expected(doc_id, text, change=True):
    w = WORD.findall((text or "").encode())
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None and change else 1
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = by_brute_force(w)
    best = sorted(found, key=lambda r: (-r[1], r[0], r[2]))[:1] or [(None, None, None)]
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    listed = "".join(f"{s},{k},{q}\n" for s, k, q in found)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    milli = 1000 * best[0][1] // best[0][2] if found else None
    return (doc_id, len(found), *best[0], milli, sha(listed.encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_by_brute_force(spark, tmp_path):
    where = "/root/testdata/sf0.001"
    theirs = {r[0]: r[1] for r in spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").collect() if len(r[1]) < 20_000}
    found = [tuple(r) for r in runs.op13_periodic_runs(spark, where).collect() if r["doc_id"] in theirs]
    assert len(found) > 150 and sorted(found) == sorted(expected(i, t) for i, t in theirs.items())
    assert any(r[1] for r in found) and any(r[0] for r in found if zlib.crc32(str(r[0]).encode()) % 10 == 0)


def test_odd(spark):
    line = "one two three "
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, line * 4), (4, line * 4), (4, line * 3), (None, "日本 é " * 9), (5, "x " * 11), (6, "x " * 12), (7, "y " + "a b " * 6 + "a a a b " * 5)]
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, n_runs string, length long")
    found = [tuple(r) for r in runs.periodic_runs(docs).collect()]
    assert sorted(found, key=repr) == sorted((expected(i, t, False) for i, t in rows), key=repr)
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    left = {(r["doc_id"], r["text"]) for r in runs.collapse(docs).collect()}
    assert (4, "one two three") in left and (1, "") in left and (5, " ".join("x" * 11)) in left and (6, "x") in left and (None, "日本 é") in left
    # batches of one long text and many short ones
    many = spark.createDataFrame([(i, "w " * (200_000 if i == 3 else i)) for i in range(40)], "doc_id long, text string").repartition(1)
    assert {r["doc_id"]: r["length"] for r in runs.periodic_runs(many).collect()} == {i: (200_000 if i == 3 else i) if i == 3 or i >= 12 else None for i in range(40)}
