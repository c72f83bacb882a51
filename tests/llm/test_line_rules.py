import itertools
import re
from collections import Counter

import numpy as np
import pytest

from recordchecks.llm import line_rules as lr

WORD = r"[^\x20\x09-\x0D]+"


def slow(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int")


def test_counts(spark, make_docs, edge_rows):
    rows = edge_rows + [(50, "a b c d a b c\n a | <b>\na b c d\na b c d\n\n", "s"), (51, "x y  z # # #", "s"), (52, "w " * 60, "s")]
    got = lr.quality_rules(make_docs(rows), labels_of(spark, [])).collect()
    keys = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted((str(r["doc_id"]), *(r[k] for k in keys)) for r in got) == sorted((str(i), *slow(t)) for i, t, _ in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"])  # without labels every line is content


def test_boilerplate_goes_and_content_stays(spark, make_docs):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(500)]
    line = lambda: " ".join(rng.choice(words, 12)).capitalize() + "."
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        rows.append((i, "\n".join(re.sub(r"(\w+)", r"\1 |", line()) if bad else line() for _ in range(8)), "s"))
        if i < 120:
            labels.append((i, 0 if bad else 1))
    got = {r["doc_id"]: r for r in lr.quality_rules(make_docs(rows), labels_of(spark, labels)).collect()}
    assert all(got[i]["kept"] == (i % 4 != 0) for i in range(120, 240))


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(0)
    for _ in range(20):
        crf = lr.Crf()
        crf.emit, crf.move = rng.normal(0, 1, (lr.FEATURES, 2)), rng.normal(0, 1, (2, 2))
        masks = [int(x) for x in rng.integers(0, 2 ** lr.FEATURES, 7)]
        e = lr.unpack(np.array(masks)) @ crf.emit
        value = lambda path: sum(e[t, s] for t, s in enumerate(path)) + sum(crf.move[a, b] for a, b in zip(path, path[1:], strict=False))
        assert value(crf.viterbi(masks)) == pytest.approx(max(map(value, itertools.product((0, 1), repeat=7))))


def test_fit_climbs_the_likelihood():
    """The fitted field gives both label sequences more than an even chance."""
    masks = [np.array([1, 1 | 64, 1]), np.array([1 | 128, 1 | 128])] * 20
    crf = lr.Crf().fit(masks, [1, 0] * 20)
    assert crf.viterbi([1, 65, 1]) == [1, 1, 1] and crf.viterbi([129, 129]) == [0, 0]


def test_empty_table(spark, make_docs):
    assert lr.quality_rules(make_docs([]), labels_of(spark, [])).collect() == []


def test_mixed_documents_have_both_states(spark, make_docs):
    """Only documents are labelled; held-out mixtures still get the share of their own lines."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(500)]
    rows, labels, truth = [], [], {}
    for i in range(300):
        bad = i % 4 == 0 if i < 200 else i % 2 == 0
        n_bad = int(rng.integers(5, 9)) if bad else int(rng.integers(0, 4))
        junk = [j < n_bad for j in range(8)]
        rng.shuffle(junk)
        lines = [" ".join(rng.choice(words, 10)).capitalize() + "." for _ in junk]
        rows.append((i, "\n".join(re.sub(r"(\w+)", r"\1 |", x).replace(".", "") if j else x for x, j in zip(lines, junk, strict=True)), "s"))
        if i < 200:
            labels.append((i, 0 if bad else 1))
        held = [10 if not j else 20 for j in junk]
        truth[i] = sum(h for h, j in zip(held, junk, strict=True) if not j) / sum(held)
    got = {r["doc_id"]: r for r in lr.quality_rules(make_docs(rows), labels_of(spark, labels)).collect()}
    close = [abs(got[i]["content_share"] - truth[i]) < 1e-9 for i in range(200, 300)]
    assert sum(close) >= 90 and any(0 < truth[i] < 1 for i in range(200, 300))


@pytest.mark.parametrize("label", [0, 1])
def test_constrained_states_hold_the_label(label):
    rng = np.random.default_rng(label)
    crf = lr.Crf()
    for _ in range(50):
        crf.emit, crf.move = rng.normal(0, 1, (lr.FEATURES, 2)), rng.normal(0, 1, (2, 2))
        masks, words = rng.integers(0, 2 ** lr.FEATURES, 9), rng.integers(0, 20, 9)
        path = lr.constrained(crf, masks, words, label)
        content = words[path == lr.CONTENT].sum()
        assert 2 * content >= words.sum() if label else 2 * content < words.sum() or not words.sum()
        free = np.array(crf.viterbi(masks.tolist()))
        share = words[free == lr.CONTENT].sum()
        if (2 * share >= words.sum()) == bool(label):
            assert (path == free).all()
