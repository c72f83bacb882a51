import zlib

import numpy as np
import pytest

from recordchecks.llm import quality_net as qn

RNG = np.random.default_rng(5)
GOOD = [f"{a}{b}" for a in ("ma", "to", "ri", "len", "so") for b in ("na", "ket", "lo", "sim", "per", "du")]


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def rows_of(n):
    out = []
    for i in range(n):
        words = list(RNG.choice(GOOD, int(RNG.integers(20, 80))))
        bad = i % 3 == 0
        out.append((i, " ".join(w + "###" if bad else w for w in words) + ".", "s", 0 if bad else 1))
    return out


def labels_of(spark, rows):
    return spark.createDataFrame([(i, q, 0, "z") for i, _, _, q in rows], "doc_id long, quality int, toxic int, text string")


def test_held_out_accuracy(spark, make_docs, edge_rows):
    rows = rows_of(500)
    docs = make_docs([r[:3] for r in rows] + [(10_000 + k, t, s) for k, (_, t, s) in enumerate(edge_rows)] + [(None, None, None)])
    got = {r["doc_id"]: r for r in qn.quality_scores(docs, labels_of(spark, rows)).collect()}
    assert len(got) == len(rows) + len(edge_rows) + 1
    right = [got[i]["predicted"] == q for i, _, _, q in rows if held(i)]
    assert np.mean(right) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert all(got[i]["held_out"] == held(i) for i, *_ in rows)
    kept = qn.good_documents(docs, labels_of(spark, rows))
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got.values())


def test_scores_do_not_depend_on_other_columns(spark, make_docs):
    rows = rows_of(120)
    labels = labels_of(spark, rows)
    score = lambda d: sorted((r["text"] if "text" in r else r["doc_id"], round(r["score"], 9)) for r in qn.quality_scores(d, labels).collect())
    assert score(make_docs([r[:3] for r in rows])) == score(make_docs([(i, t, "other") for i, t, _, _ in rows]))


def test_index_matrix_is_the_sum_of_neighbours(make_docs):
    texts = ["a b c", "b a", None, "", "c c c d"]
    got = qn.index_matrix(make_docs([(i, t, "s") for i, t in enumerate(texts)]).repartition(3), "text")
    want = np.zeros(qn.ROWS * qn.DIM)
    for t in texts:
        rows = qn.text_rows(t)
        for i, a in enumerate(rows):
            for b in rows[max(0, i - 2):i] + rows[i + 1:i + 3]:
                one = np.zeros(qn.ROWS * qn.DIM)
                qn.add_contexts(one, np.array([a, b]))
                want[a * qn.DIM:(a + 1) * qn.DIM] += one[a * qn.DIM:(a + 1) * qn.DIM] / (2 if a == b else 1)
    assert np.allclose(got.ravel(), want)


@pytest.mark.parametrize("quality,score", [([], 0.5), ([1, 1, 1], 1.0), ([0, 0], 0.0), ([None, 2], 0.5)])
def test_without_both_classes(spark, make_docs, quality, score):
    ids = [i for i in range(100) if not held(i)]
    labels = spark.createDataFrame([(ids[k], q) for k, q in enumerate(quality)], "doc_id long, quality int")
    got = qn.quality_scores(make_docs([(i, f"text {i}", "s") for i in ids]), labels).collect()
    assert {r["score"] for r in got} == {score}


def test_empty_table(spark, make_docs):
    assert qn.quality_scores(make_docs([]), labels_of(spark, [])).collect() == []


def test_temperature():
    x = RNG.normal(0, 1, (600, 4))
    y = ((x[:, 0] + RNG.normal(0, 1, 600)) > 0).astype(float)
    kept = np.arange(600) % 5 == 0
    net = qn.Net().fit(x, y, kept, epochs=200)
    p = net.probabilities(x[kept])
    loss = lambda q: -np.mean(y[kept] * np.log(q) + (1 - y[kept]) * np.log(1 - q))
    raw = 1 / (1 + np.exp(-net.logits(x[kept])))
    assert loss(p) <= loss(np.clip(raw, 1e-12, 1 - 1e-12)) + 1e-9
