import math
import zlib
from collections import Counter

import numpy as np
import pytest

from recordchecks.llm import class_lm
from recordchecks.llm.common import packed, unpacked


def held(i):
    return zlib.crc32(str("null" if i is None else i).encode()) % 7 == 2


def test_base_score(make_docs, edge_rows):
    rows = edge_rows + [(50 + i, f"some words {i} and more Words", "s") for i in range(60)]
    got = class_lm.scores(make_docs(rows)).collect()
    counts = Counter()
    for i, t, _ in rows:
        if not held(i):
            counts.update([*(t or "").encode().lower().split(), b""])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t, _ in rows:
        tokens = [*(t or "").encode().lower().split(), b""]
        want.append((str(i), held(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)))
    rows_ = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got)
    for a, b in zip(sorted(want), rows_, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5])
    assert all(r["score"] < 0 for r in got)


def test_tail_words_meet_their_counts(make_docs, monkeypatch):
    rows = [(i, f"a b w{i % 5} w{i % 3} rare{i % 40}", "s") for i in range(120)]
    whole = class_lm.scores(make_docs(rows)).collect()
    monkeypatch.setattr(class_lm, "HEAD", 3)
    monkeypatch.setattr(class_lm, "TOP", 3)
    few = class_lm.scores(make_docs(rows)).collect()
    for a, b in zip(sorted(whole, key=lambda r: r["doc_id"]), sorted(few, key=lambda r: r["doc_id"]), strict=True):
        assert a["base_score"] == pytest.approx(b["base_score"]) and a["n_known"] == b["n_known"]


def test_classes_beat_the_base_on_held_out_text(make_docs):
    rng = np.random.default_rng(1)
    nouns, verbs = [f"noun{i}" for i in range(30)], [f"verb{i}" for i in range(30)]
    rows = [(i, " ".join(f"{nouns[rng.integers(30)]} {verbs[rng.integers(30)]}" for _ in range(40)), "s") for i in range(200)]
    got = [r for r in class_lm.scores(make_docs(rows)).collect() if r["held_out"]]
    assert got and sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


@pytest.mark.parametrize("head", [60_000, 1_400])
def test_words_beyond_the_first_clustering_have_classes_of_their_own(make_docs, monkeypatch, head):
    """Nouns and verbs of one hash, rarer than 1,400 others: the order of a text matters to its score."""
    monkeypatch.setattr(class_lm, "HEAD", head)
    rng = np.random.default_rng(1)
    nouns, verbs = [f"noun{i}" for i in range(700)], [f"verb{i}" for i in range(700)]
    rare = [f"n{i}xyz" for i in range(20)], [f"v{i}xyz" for i in range(20)]
    def line():
        return " ".join(str(rng.choice(rare[j % 2] if rng.random() < 0.01 else (nouns, verbs)[j % 2])) for j in range(60))
    ids = [i for i in range(1000) if not held(i)][:700]
    right, wrong = [i for i in range(1000, 2000) if held(i)][:2]
    rows = [(i, line(), "s") for i in ids] + [(right, "n1xyz verb1 noun1 v1xyz", "s"), (wrong, "v1xyz verb1 noun1 n1xyz", "s")]
    got = {r["doc_id"]: r["score"] for r in class_lm.scores(make_docs(rows)).collect()}
    assert got[right] > got[wrong] + 1


def test_exchange_finds_the_classes():
    pairs = np.zeros((9, 9))
    for a in (1, 2, 3, 4):
        for b in (5, 6, 7, 8):
            pairs[a, b] = pairs[b, a] = 10
    cls = class_lm.exchange(pairs, classes=3)
    assert len(set(cls[1:5])) == 1 and len(set(cls[5:])) == 1 and cls[1] != cls[5] and cls[0] == 0


def test_a_texts_words_sum_to_one_after_any_word(make_docs):
    """The probabilities of all known words, one unknown word a class, and the end sum to 1."""
    rows = [(i, "a b c a", "s") for i in range(40)]
    vocabulary = ["a", "b", "c"]
    probe = [(1000 + k, t, "s") for k, t in enumerate(["", *vocabulary])]
    probe = [(next(j for j in range(i * 1000, i * 1000 + 900) if held(j)), t, s) for i, t, s in probe]
    got = {r["doc_id"]: r["score"] for r in class_lm.scores(make_docs(rows + probe)).collect()}
    assert all(got[i] < 0 for i, _, _ in probe)
    assert sum(10 ** got[i] for i, _, _ in probe) < 1  # whole texts of at most one word


def test_empty_tables(make_docs):
    assert class_lm.scores(make_docs([])).collect() == []
    only = [(i, "never trained", "s") for i in range(200) if held(i)][:3]
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in class_lm.scores(make_docs(only)).collect())


def test_packed_counts_come_back():
    rng = np.random.default_rng(1)
    for counts in (np.zeros(50), np.ones(50), np.arange(50), rng.integers(0, 2, 5000) * rng.integers(0, 2 ** 31, 5000)):
        assert (unpacked(packed(counts.astype(np.float64)), len(counts)) == counts).all()
