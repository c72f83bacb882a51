import numpy as np
import pytest

from recordchecks.llm import nearest

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string, cell int, query string, score int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 9, "x", 1, "q", 2) for i, v in rows], SCHEMA)


def slow(rows, every, k):
    """``query id -> lists``, one for each row with that id."""
    valid = [(i, v) for i, v in rows if i is not None and v and not any(x is None or not np.isfinite(x) for x in v) and any(v)]
    out = {}
    for size in {len(v) for _, v in valid}:
        ids = np.array([i for i, v in valid if len(v) == size])
        m = np.array([v for _, v in valid if len(v) == size], np.float32).astype(np.float64)
        for a, i in enumerate(ids):
            if i % every == 0:
                s = (m * m[a]).sum(axis=1) / (np.sqrt((m * m).sum(axis=1)) * np.sqrt((m[a] * m[a]).sum()))
                order = [x for x in np.lexsort((ids, -s)) if x != a][:k]
                out.setdefault(int(i), []).append([(int(ids[x]), s[x]) for x in order])
    return {i: sorted(v) for i, v in out.items() if any(v)}


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("clusters", [0, 12])
def test_recall_against_brute_force(spark, clusters, monkeypatch):
    monkeypatch.setattr(nearest, "CELL_ROWS", 200)
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 150)
    rng = np.random.default_rng(4)
    m = rng.normal(0, 1, (1500, 16)) * (0.2 if clusters else 1) + (rng.normal(0, 1, (clusters, 16))[rng.integers(0, clusters, 1500)] if clusters else 0)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(m)]
    got, want = lists(nearest.neighbours(table(spark, rows), every=20)), {q: v[0] for q, v in slow(rows, 20, 5).items()}
    assert got.keys() == want.keys()
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want]
    assert np.mean(hits) >= 0.9
    whole = slow(rows, 20, 1500)
    exact = {q: dict(whole[q][0]) for q in list(want)[:3]}
    for q, of in exact.items():
        assert all(s == pytest.approx(of[i], abs=1e-12) for i, s in got[q])


def test_copies_ties_and_rows_that_take_no_part(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 1, 16).astype(np.float32).astype(float).tolist()) for i in range(40)]
    one = rows[3][1]
    rows += [(100 + i, one) for i in range(60)] + [(None, one), (500, None), (550, [0.0] * 16), (600, [float("nan")] * 16)]
    rows += [(650, [None] * 16), (700, [1.0] * 3), (750, []), (800, [float("inf")] + [1.0] * 15), (900, [2 * x for x in one])]
    got, want = lists(nearest.neighbours(table(spark, rows), every=50)), {q: v[0] for q, v in slow(rows, 50, 5).items()}
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert set(got) == {0, 100, 150, 900}


def test_rows_that_repeat_an_id_and_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(7)
    vector = lambda n: rng.normal(0, 1, n).astype(np.float32).astype(float).tolist()
    rows = [(i, vector(16)) for i in range(60)] + [(i, vector(4)) for i in range(0, 200, 10)] + [(1000, vector(3))]
    one, two = rows[7][1], rows[9][1]
    rows += [(50, one), (50, two), (50, two), (9, two), (100, one), (7, one)] + [(150, two)] * 9
    out = nearest.neighbours(table(spark, rows), every=50).collect()
    want = slow(rows, 50, 5)
    assert {r["query_id"] for r in out} == set(want)  # 1000 is alone with its length
    for q, of in want.items():
        got = sorted((r["rank"], r["vec_id"], round(r["score"], 9)) for r in out if r["query_id"] == q)
        assert got == sorted((n, i, round(s, 9)) for each in of for n, (i, s) in enumerate(each, 1)), q


def test_few_candidates_and_empty_table(spark):
    one = [1.0] + [0.0] * 15
    assert lists(nearest.neighbours(table(spark, [(0, one), (1, one[::-1])]), every=50)) == {0: [(1, 0.0)]}
    assert nearest.neighbours(table(spark, [(0, one)]), every=50).collect() == []
    assert nearest.neighbours(table(spark, []), every=50).collect() == []
    assert nearest.neighbours(table(spark, [(7, one)]), every=50).collect() == []


def test_chi_square_quantile():
    assert nearest.chi_square_quantile(0.99, 6) == pytest.approx(16.8119, abs=1e-3)
    assert nearest.chi_square_quantile(0.95, 2) == pytest.approx(5.9915, abs=1e-3)


def test_cells_part_the_space():
    rng = np.random.default_rng(6)
    points = rng.normal(0, 1, (500, 6))
    boxes = nearest.kd_cells(points[:100], 3)
    p = points[:, None, :]
    assert (((p >= boxes[:, 0]) & (p < boxes[:, 1])).all(axis=2).sum(axis=1) == 1).all()
    order = nearest.kd_order(points)
    assert sorted(order) == list(range(500)) and max(b - a for a, b in nearest.leaf_runs(500)) <= nearest.LEAF
