import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordchecks.llm import toxicity as tx

RNG = np.random.default_rng(3)
PLAIN = [f"{a}{b}" for a in ("ma", "to", "ri", "len", "so") for b in ("na", "ket", "lo", "sim", "per", "du")]
STOP = {"en": ["the", "and", "of", "is"], "de": ["der", "und", "nicht", "ein"]}
# in one language a word marks the class, in the other a pair of words of which each is plain
MARKS = {"en": ["grumble"], "de": ["falsch", "kram"]}


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def rows_of(n):
    out = []
    for i in range(n):
        lang = "de" if i % 3 == 0 else "en"
        words = [str(w) for w in RNG.choice(PLAIN + STOP[lang] * 3, int(RNG.integers(15, 60)))]
        toxic = int(i % 4 == 1)
        if toxic:
            at = int(RNG.integers(0, len(words)))
            words[at:at] = MARKS[lang]
        elif lang == "de":
            words.insert(int(RNG.integers(0, len(words))), str(RNG.choice(MARKS["de"])))
        out.append((i, " ".join(words) + ".", "s", toxic))
    return out


def labels_of(spark, rows):
    return spark.createDataFrame([(i, 0, y, "z") for i, _, _, y in rows], "doc_id long, quality int, toxic int, text string")


def test_held_out_accuracy(spark, make_docs, edge_rows):
    rows = rows_of(1500)
    docs = make_docs([r[:3] for r in rows] + [(10_000 + k, t, s) for k, (_, t, s) in enumerate(edge_rows)] + [(None, None, None)])
    found = tx.toxicity_scores(docs, labels_of(spark, rows)).collect()
    got = {r["doc_id"]: r for r in found}
    assert len(found) == len(rows) + len(edge_rows) + 1
    assert all(got[i]["held_out"] == held(i) for i, *_ in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    test = [(got[i]["predicted"], y) for i, _, _, y in rows if held(i)]
    assert np.mean([p == y for p, y in test]) > 0.95
    assert {got[i]["language"] for i, *_ in rows} <= {"en", "de", ""}


def test_scores_do_not_depend_on_other_columns(spark, make_docs):
    rows = rows_of(150)
    labels = labels_of(spark, rows)

    def score(docs):
        return sorted((r["doc_id"], round(r["score"], 9)) for r in tx.toxicity_scores(docs, labels).collect())

    assert score(make_docs([r[:3] for r in rows])) == score(make_docs([(i, t, "other") for i, t, _, _ in rows]).withColumn("lang", F.lit(None).cast("string")))


def pooled_by_hand(net, words):
    """Largest answers of every filter, window by window."""
    emb = [net.emb[list(tx.rows_of(w))].sum(axis=0) for w in words] + [np.zeros(tx.DIM, np.float32)] * tx.PADS
    out = np.zeros((len(tx.WIDTHS), tx.FILTERS))
    for k, width in enumerate(tx.WIDTHS):
        conv = [net.conv[p] for p, (kk, _) in enumerate(net.offsets) if kk == k]
        out[k] = np.max([sum(emb[i + o] @ conv[o] for o in range(width)) for i in range(len(words) + 1)], axis=0)
    return out


def test_scorer_equals_windows_by_hand(monkeypatch):
    net = tx.ConvNet()
    rows = [r[1] for r in rows_of(12)] + [None, "", "one", "one two " * 200]
    want = np.array([net.logits(pooled_by_hand(net, (t or "").lower().replace(".", "").split())[None])[0] for t in rows])
    assert np.allclose(tx.Scorer(net)(rows)[0], want, atol=1e-4)
    # pieces, parts and a full cache change nothing
    for name, value in (("PIECE", 7), ("BATCH_WORDS", 30), ("TEXT_PART", 50), ("CACHE_WORDS", 5)):
        monkeypatch.setattr(tx, name, value)
    assert np.allclose(tx.Scorer(net)(rows)[0], want, atol=1e-4)


def test_thresholds_by_language():
    net = tx.ConvNet()
    z = np.r_[np.linspace(-4, 4, 200), np.linspace(-4, 4, 200)]
    spoken = np.repeat([1, 2], 200)
    y = np.where(spoken == 1, z > 2, z > -2).astype(float)
    net.calibrate(z, y, spoken)
    assert net.thresholds[1] > net.thresholds[2]
    assert np.mean((net.scores(z, spoken) >= 0.5) == (y > 0)) > np.mean((net.probability(z) >= net.thresholds[0]) == (y > 0))
    assert ((net.scores(z, spoken) >= 0.5) == (net.probability(z) >= net.thresholds[spoken])).all()
    # a language with few texts has the threshold of all
    assert net.thresholds[3] == net.thresholds[0] == tx.best_threshold(net.probability(z), y)


@pytest.mark.parametrize("toxic,score", [([], 0.5), ([1, 1, 1], 1.0), ([0, 0], 0.0), ([None, 2], 0.5)])
def test_without_both_classes(spark, make_docs, toxic, score):
    ids = [i for i in range(100) if not held(i)]
    labels = spark.createDataFrame([(ids[k], y) for k, y in enumerate(toxic)], "doc_id long, toxic int")
    got = tx.toxicity_scores(make_docs([(i, f"text {i}", "s") for i in ids]), labels).collect()
    assert {r["score"] for r in got} == {score}


def test_empty_table(spark, make_docs):
    assert tx.toxicity_scores(make_docs([]), labels_of(spark, [])).collect() == []


def test_every_labelled_text_is_learnt_from(spark, make_docs, monkeypatch):
    """Texts of one block, of many blocks and of many words all reach the weights and the thresholds."""
    rows = [r for r in rows_of(700) if not held(r[0])]
    marks = [r for r in rows if zlib.crc32(b"kept%d" % r[0]) % 5][::9]
    # a word that is in these texts alone, one of them longer than the old limit of 3,000 words
    own = {r[0]: f"zq{r[0]}xj" for r in marks}
    long = marks[0][0]
    rows = [(i, (t + " ") * (200 if i == long else 1) + own.get(i, ""), s, y) for i, t, s, y in rows]
    monkeypatch.setattr(tx, "BLOCK_TEXTS", 60)
    net = tx.fit(make_docs([r[:3] for r in rows]), labels_of(spark, rows))
    start = tx.ConvNet()
    moved = {i for i, w in own.items() if (net.emb[tx.rows_of(w)[0]] != start.emb[tx.rows_of(w)[0]]).any()}
    # a word may win no filter and stay as it was; the cut to one block moved at most those of that block
    assert len(moved) > len(own) / 3
    again = tx.fit(make_docs([r[:3] for r in rows]).repartition(3), labels_of(spark, rows))
    assert (again.emb == net.emb).all() and (again.thresholds == net.thresholds).all()


def test_windows_in_stretches(monkeypatch):
    net, coder = tx.ConvNet(), tx.Coder()
    texts = [coder.code(r[1].split()) for r in rows_of(40)] + [np.zeros(0, np.int32)]
    ids, first = tx.lay(texts)
    products = net.products(np.array(coder.rows, np.int64))
    want = net.pooled(products, ids, first, where=True)
    for stretch in (1, 7, 64):
        monkeypatch.setattr(tx, "STRETCH", stretch)
        got = net.pooled(products, ids, first, where=True)
        assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])


def test_threshold_of_counts():
    p, y = np.round(RNG.random(400), 2), (RNG.random(400) < 0.4).astype(float)
    keys, times = np.unique(np.stack([p, y]), axis=1, return_counts=True)
    assert tx.best_threshold(keys[0], keys[1], times.astype(float)) == tx.best_threshold(p, y)
