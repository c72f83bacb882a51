import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from recordchecks.llm import simhash
from recordchecks.llm.components import components

CODE = simhash.golay()


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    fps = [slow_fingerprint(t) for _, t, _ in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 3 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    first = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    return sorted((str(r[0]), f"{f:016x}", str(first[g])) for r, f, g in zip(rows, fps, group, strict=True))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2 ** 64 - 1), st.sets(st.integers(0, 63), max_size=3))
def test_any_three_bits_share_a_key(fp, bits):
    other = fp
    for b in bits:
        other ^= 1 << b
    pair = np.array([fp, other], np.uint64).view(np.int64)
    probe, build = simhash.keys(pair[:1], True, CODE)[1], simhash.keys(pair[1:], False, CODE)[1]
    assert set(probe) & set(build)


def test_golay_code():
    tables, errors = CODE
    assert len(tables[0]) == 4096 and (errors[:, 0] >= 0).all()  # perfect: every syndrome has a leader
    assert max(bin(e).count("1") for e in errors[:, 0]) == 3
    assert set((errors >= 0).sum(axis=1)) == {1, 6}


def test_against_brute_force(make_docs, edge_rows):
    base = "the quick brown fox jumps over the lazy dog while seven wizards brew a pot of green tea near the old mill " * 4
    near = [(200 + i, base + " tail" * i, "s") for i in range(6)] + [(300 + i, base.replace("mill", f"mill{i}"), "s") for i in range(4)]
    rows = edge_rows + near + [(5, "one", "b")]
    got = simhash.near_duplicates(make_docs(rows)).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == slow_components(rows)


def test_one_of_each_component_stays(make_docs, edge_rows):
    rows = edge_rows + [(20, "The cat sat on the mat. " * 20, "q"), (21, "something else altogether here", "q")]
    docs = make_docs(rows)
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    classes = {(f, c) for _, f, c in slow_components(rows)}
    roots = {c for _, c in classes}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(map(str, ids)) == sorted(roots) and len(set(ids)) == len(ids)


def test_empty_table(make_docs):
    docs = make_docs([])
    assert simhash.near_duplicates(docs).collect() == [] and simhash.deduplicated(docs).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long"), "u", "v").collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100 + i: 100 for i in range(30)}
