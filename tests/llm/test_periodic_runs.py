import hashlib
import random
import zlib

import numpy as np
import pytest

from recordchecks.llm import periodic_runs as pr


def brute_runs(w, least=12):
    """Every maximal stretch by comparing words p apart, least period of each."""
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def sequences(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        k, size = rng.choice([1, 2, 2, 3, 5, 50]), rng.choice([0, 1, 11, 12, 13, 30, 100, 250])
        w = [rng.randrange(k) for _ in range(size)]
        if w and rng.random() < 0.4:
            a = rng.randrange(size)
            p = 1 + rng.randrange(max(1, size - a))
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        yield w


def test_every_remainder_is_reached():
    assert (pr.SHIFT >= 0).all()
    for a in range(pr.COVER):
        for b in range(pr.COVER):
            d = pr.SHIFT[a, b]
            assert (a + d) % pr.COVER in pr.CLASSES and (b + d) % pr.COVER in pr.CLASSES


def test_extension_equals_comparing_words():
    rng = np.random.default_rng(2)
    for size, k in ((5, 1), (200, 1), (400, 2), (300, 30)):
        w = np.r_[rng.integers(0, k, size), k].astype(np.int32)
        w[size // 2:size] = w[:size - size // 2]
        ext = pr.Extension(w)
        i, j = rng.integers(0, size, (2, 500))
        i, j = np.minimum(i, j), np.maximum(i, j)
        i, j = i[i < j], j[i < j]
        want = [next(d for d in range(size + 1) if w[a + d] != w[b + d]) for a, b in zip(i, j, strict=True)]
        assert ext(i, j).tolist() == want


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    texts = list(sequences(30, seed))
    for got, w in zip(pr.runs_of([np.array(t, np.int32) for t in texts]), texts, strict=True):
        assert [tuple(r) for r in got.tolist()] == brute_runs(w)


def test_grid_in_blocks(monkeypatch):
    monkeypatch.setattr(pr, "GRID", 10)
    texts = list(sequences(12, 9))
    for got, w in zip(pr.runs_of([np.array(t, np.int32) for t in texts]), texts, strict=True):
        assert [tuple(r) for r in got.tolist()] == brute_runs(w)


def expected(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str("null" if doc_id is None else doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    gone = {i for s, e, p in runs for i in range(s + p, s + e)}
    return (doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{e},{p}\n" for s, e, p in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def test_query_equals_brute_force(spark, make_docs, edge_rows, tmp_path):
    rng = random.Random(4)
    # one very long text with periods of its own, not brute-forced over every p
    rows = [r for r in edge_rows if len(r[1] or "") < 9_000]
    rows += [(100 + i, " ".join(f"w{x}" for x in w), "s") for i, w in enumerate(sequences(80, 7))]
    rows += [(300 + i, rng.choice(["ha ", "na\x0bBa\t", "é ü ô "]) * rng.randrange(40), "s") for i in range(20)]
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in pr.query(spark, str(tmp_path)).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted(got, key=key) == sorted((expected(i, t) for i, t, _ in rows), key=key)


def test_long_texts_and_small_batches(make_docs, edge_rows, monkeypatch):
    monkeypatch.setattr(pr, "BATCH_WORDS", 50)
    rows = [*edge_rows, (50, "a " * 30_000, "s"), (51, "x y z " * 9_000, "s")]
    got = {r["doc_id"]: r for r in pr.periodic_runs(make_docs(rows).coalesce(1)).collect()}
    assert [tuple(r) for r in got[50]["runs"]] == [(0, 30_000, 1)] and got[50]["collapsed"] == "a"
    assert [tuple(r) for r in got[51]["runs"]] == [(0, 27_000, 3)] and got[51]["collapsed"] == "x y z"
    assert got[1]["runs"] == [] and got[1]["collapsed"] == "" and got[2]["n_words"] == 0
    assert got[4]["n_words"] == 12_000
    assert len(pr.periodic_runs(make_docs(rows)).collect()) == len(rows)


def test_empty_table(make_docs):
    assert pr.periodic_runs(make_docs([])).collect() == []
