import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from recordchecks.llm import spelling_variants as sv


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, alter=True, least=5, ratio=5):
    n = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            if alter and h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= least}
    links = {w: [v for v in n if near(v, w)] for w in n}
    form = {}
    for w, vs in links.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(links[w]), n[form[w]] if form[w] else None) for w in n}


def vocabulary(seed, letters, count):
    rng = random.Random(seed)
    words = set()
    for _ in range(count):
        w = "".join(rng.choice(letters) for _ in range(rng.choice([6, 6, 7, 8, 9, 12])))
        words.add(w)
        for _ in range(2):
            i, o = rng.randrange(len(w)), rng.random()
            v = w[:i] + w[i + 1:] if o < 0.3 else w[:i] + rng.choice(letters) + w[i + (o < 0.6):]
            if len(v) >= 6:
                words.add(v)
    return sorted(words)


@pytest.mark.parametrize("letters,least", list(itertools.product(["ab", "abc", "abcdef"], [0, 3, 20, 100])))
def test_no_near_pair_is_outside_the_lists(letters, least):
    """The affected-gram bound: each near pair meets in a list, whatever grams are frequent."""
    words = vocabulary(least, letters, 150)
    grams = Counter(w[i:i + q] for w in words for q in range(sv.QMIN, sv.QMAX) for i in range(len(w) - q + 1))
    frequent = {g: c for g, c in grams.items() if c > least}
    keys = {w: sv.keys_of(w, frequent) for w in words}
    lists = {}
    for w, k in keys.items():
        for gram, start in k:
            lists.setdefault((gram, start, len(w)), set()).add(w)
    got = set()
    for w, k in keys.items():
        for gram, start in k:
            for size, step in ((0, 0), (1, 0)) if start < -1 else ((0, 0), (1, 0), (1, 1)):
                got |= {frozenset((w, v)) for v in lists.get((gram, start + step, len(w) + size), ()) if near(v, w)}
    assert got == {frozenset(p) for p in itertools.combinations(words, 2) if near(*p)}


def test_masks_leave_out_no_near_pair():
    for a, b in itertools.combinations(vocabulary(11, "abcdeé", 150), 2):
        if near(a, b):
            (la, pa), (lb, pb) = sv.masks(a), sv.masks(b)
            assert (la ^ lb).bit_count() <= 2 and (pa ^ pb).bit_count() <= 4


def test_bound_is_an_upper_bound():
    """All but the bound's number of grams of a word are grams of every near word, in place."""
    words = vocabulary(5, "abc", 60)
    grams = Counter(w[i:i + q] for w in words for q in range(sv.QMIN, sv.QMAX) for i in range(len(w) - q + 1))
    frequent = {g: c for g, c in grams.items() if c > 10}
    for a, b in itertools.permutations(words, 2):
        if near(a, b):
            mine = sv.decompose(a, frequent)
            theirs = {(b[x:y], s) for x, y in sv.decompose(b, frequent) for s in {x, x - len(b) + len(a)}}
            assert sum((a[x:y], x) in theirs for x, y in mine) >= len(mine) - sv.affected(a, mine, frequent)


def test_decomposition_takes_the_longest_grams():
    assert [("abcdef"[a:b]) for a, b in sv.decompose("abcdef", {})] == ["ab", "bc", "cd", "de", "ef"]
    assert [("abcdef"[a:b]) for a, b in sv.decompose("abcdef", {"ab": 9, "abc": 9, "ef": 9})] == ["abcd", "de", "ef"]


def rows_with_slips():
    rng = random.Random(8)
    base = vocabulary(3, "abcdeüé", 60)
    rows = []
    for i in range(400):
        words = rng.choices(base, weights=[1 + 400 // (k + 1) for k in range(len(base))], k=30)
        rows.append((i, " ".join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in words) + rng.choice([".", "!", " 漢字 7"]), "s"))
    return rows


@pytest.mark.parametrize("least", [1, 20])
def test_query_equals_brute_force(spark, make_docs, edge_rows, tmp_path, monkeypatch, least):
    monkeypatch.setattr(sv, "LEAST_FREQUENT", least)
    rows = rows_with_slips() + edge_rows
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sv.query(spark, str(tmp_path)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    want = brute(rows)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert any(r["form"] for r in got)


def test_chains_of_forms_and_ties(make_docs):
    n = {"abcdef": 1000, "abcdeg": 200, "abcdxg": 40, "abcyxg": 8, "mnopqr": 10, "mnopqs": 50, "mnopqt": 50}
    rows = [(k, f"{w} " * c, "s") for k, (w, c) in enumerate(n.items())]
    got = {r["word"]: r for r in sv.variant_groups(make_docs(rows)).collect()}
    assert [got[w]["root"] for w in ("abcyxg", "abcdxg", "abcdeg", "abcdef")] == ["abcdef"] * 4
    assert got["mnopqr"]["form"] == "mnopqs" and got["mnopqs"]["form"] is None and got["mnopqr"]["n_near"] == 2


def test_frequent_grams_are_counted_in_all_places(spark, monkeypatch):
    monkeypatch.setattr(sv, "LEAST_FREQUENT", 5)
    words = vocabulary(2, "abcdé", 200)
    grams = Counter(w[i:i + q] for w in words for q in range(sv.QMIN, sv.QMAX) for i in range(len(w) - q + 1))
    got = sv.frequent_grams(spark.createDataFrame([(w,) for w in words], "word string"))
    assert got == {g: c for g, c in grams.items() if c > 5}


def test_broadcast_of_frequent_grams_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(sv, "FREQUENT", 40)
    words = spark.createDataFrame([(w,) for w in vocabulary(1, "abcd", 300)], "word string")
    grams = sv.frequent_grams(words)
    assert all(sum(len(g) == q for g in grams) <= 40 for q in range(sv.QMIN, sv.QMAX))
    total = words.agg(F.sum(F.length("word"))).first()[0]
    assert min(grams.values(), default=10**9) > total // 40


def test_empty_table(make_docs):
    assert sv.variant_groups(make_docs([])).collect() == []
    assert sv.variant_groups(make_docs([(1, None, "a"), (2, "", "b")])).collect() == []
