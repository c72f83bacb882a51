import math

import numpy as np
import pytest

from recordchecks.llm import mixing

RNG = np.random.default_rng(3)


def slow_targets(sizes):
    """Share by weight; cap; share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, list(names), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def rows_of(n, sources):
    return [(i, " ".join(["w"] * int(RNG.integers(1, 300))), sources[int(RNG.integers(len(sources)))]) for i in range(n)]


def totals(rows):
    out = {}
    for _, t, s in rows:
        out[s] = out.get(s, 0) + len((t or "").encode().split())
    return out


@pytest.mark.parametrize("sources", [["a", "b", "c", None], ["z", "Z", "é", "a", None, "b"]])
def test_targets_and_taken(make_docs, sources):
    rows = rows_of(1500, sources) + [(5000, "one two", "tiny"), (5001, None, "empty"), (5002, "", None)]
    got = mixing.mix(make_docs(rows)).collect()
    size, target = totals(rows), slow_targets(totals(rows))
    of = {i: s for i, _, s in rows}
    taken = {}
    for r in got:
        s = of[r["doc_id"]]
        assert r["source_size"] == size[s] and math.isclose(r["target"], target[s], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert len(got) == len(rows)
    for s in size:
        assert abs(taken[s] - target[s]) <= 0.01 * target[s] + 150, s


def test_rates_meet_the_targets(make_docs):
    """The solved multipliers give every source its target, by a sum over documents."""
    rows = rows_of(600, ["a", "b", "c", "d"])
    plan = mixing.mix_plan(mixing.source_sizes(make_docs(rows), "doc_id", "source", "text"))
    size, target = totals(rows), slow_targets(totals(rows))
    got = {r["key"][1:]: r["target"] for r in plan.select("key", "target").distinct().collect()}
    assert got == pytest.approx({s: target[s] for s in size})


def test_reruns_agree_and_equal_rows_share(make_docs, edge_rows):
    rows = edge_rows + [(None, "a b c", "b")] * 40
    a, b = (sorted(map(str, mixing.mix(make_docs(rows).repartition(n)).collect())) for n in (1, 5))
    assert a == b and len(a) == len(rows)


def test_mixed_rows_are_the_copies(make_docs, edge_rows):
    docs = make_docs(edge_rows + rows_of(200, ["p", "q", "r"])[11:])
    copies = sum(r["copies"] for r in mixing.mix(docs).collect())
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == copies


def test_large_ids_beside_null_stay_whole(make_docs):
    big = 2 ** 60 + 1
    got = {r["doc_id"] for r in mixing.mix(make_docs([(big, "a b", "s"), (None, "a b c", "s")])).collect()}
    assert got == {big, None}


def test_empty_table(make_docs):
    assert mixing.mix(make_docs([])).collect() == [] and mixing.mixed(make_docs([])).collect() == []


def test_rounding_carries_the_error():
    size = np.sort(RNG.integers(1, 1000, 500))[::-1]
    rates = RNG.uniform(0, 3, 500)
    out = mixing.round_block(size, np.ones(500, np.int64), rates)
    assert ((out == np.floor(rates)) | (out == np.ceil(rates))).all()
    assert abs((out * size).sum() - (rates * size).sum()) <= 50
