"""Toxicity by a convolutional text classifier (operator 12).

1. A word's embedding is the sum of hashed rows: the word, and its beginnings of
   4, 5 and 6 bytes (``ROWS`` rows of ``DIM``).
2. ``FILTERS`` filters of each width in ``WIDTHS`` slide over the words of a text;
   the largest answer of each, rectified, goes to a logistic output.  A filter's
   answer is a sum of per-word products, one for each place in the window, so
   the products are made once a distinct word.
3. The network is fitted in numpy (Adam) on all labelled texts, whole.  A fifth of them
   is kept from the fit.  The others are dealt to blocks by a hash of the id, of about
   ``BLOCK_TEXTS`` texts and ``BLOCK_WORDS`` words; a task holds one block.  The first
   block is learnt alone, in several passes; where there are more, ``ROUNDS`` rounds
   follow, in each of which every block is learnt from the common weights and the
   weights of all are averaged (an embedding row over the blocks that moved it) by an
   aggregate of fixed-point sums, so the driver gets one set of weights a round.
   The logits of all kept texts are counted on a grid of 1 / ``GRID``; on these counts the
   temperature is fitted, and then a threshold for each language.
4. The language of a text is guessed from its own most usual words; a language with
   fewer than ``LEAST`` texts of a class in the kept fifth has the threshold of all,
   others one between their own and that of all, by how many texts they have.
   The score is the calibrated probability, moved so that the threshold lies at 0.5.
5. Every text is scored whole in one map-side pass; the weights are broadcast (2 MB).

Labels, lang, source and doc_id never enter a score.  Defined results: null and
empty texts have no words and the score of zero features; repeated rows are scored
one by one; an id with conflicting labels is not learnt from; with no usable label
(or of one class only) the score is that class's share, 0.5 for none; other input
columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from recordchecks.llm.common import crc32_mod, read_table, small_batches, store

ROWS, DIM, FILTERS, WIDTHS = 32768, 16, 12, (1, 2, 3)
PER_WORD, PADS, REACH = 4, max(WIDTHS), max(WIDTHS) - 1
BLOCK_TEXTS, BLOCK_WORDS, ROUNDS, ROUND_RATE = 8_000, 8_000_000, 2, 2e-3
GRID, FIXED, STRETCH = 256, 2.0 ** 32, 400_000
PIECE, CACHE_WORDS, BATCH_WORDS, LEAST, SHRINK = 50_000, 120_000, 100_000, 10, 40
TEXT_PART = 1_000_000
WORDS = re.compile(r"\w+")
# Usual words of some languages, by which a text's own is guessed
USUAL = {
    "de": "der die das und ist nicht ein eine mit von den für auf dem zu sich des wir auch es".split(),
    "en": "the and of to is was that for with it on are this as by be at from have not".split(),
    "es": "el los las y en que del una por con para es su al lo se como más pero sus".split(),
    "fr": "le les et des est une dans que pour qui sur pas au avec par ce il sont ne se".split(),
}
LANGUAGES = ["", *USUAL]  # "": none of them
VOTES = {w: tuple(i for i, n in enumerate(LANGUAGES) if n and w in USUAL[n]) for ws in USUAL.values() for w in ws}


def rows_of(word: str) -> tuple[int, ...]:
    """Embedding rows of a lower-cased word; row 0 holds nothing and stands for the missing."""
    b = word.encode("utf-8", "replace")
    n, crc, m = len(b), zlib.crc32, ROWS - 1
    return (1 + crc(b) % m, 1 + crc(b[:4], 1) % m if n >= 4 else 0, 1 + crc(b[:5], 1) % m if n >= 5 else 0,
            1 + crc(b[:6], 1) % m if n >= 6 else 0)


def words_of(text: str | None) -> Iterator[list[str]]:
    """The lower-cased words of a whole text, a part of about ``TEXT_PART`` characters at a time."""
    text = text or ""
    lo = 0
    while lo < len(text):
        hi = min(lo + TEXT_PART, len(text))
        while hi < len(text) and (text[hi].isalnum() or text[hi] == "_"):
            hi += 1
        yield WORDS.findall(text[lo:hi].lower())
        lo = hi


class Coder(dict):
    """Numbers for words, from 1; 0 is the pad."""

    def __init__(self):
        super().__init__()
        self.rows: list[tuple[int, ...]] = [(0,) * PER_WORD]
        self.vote: dict[int, tuple[int, ...]] = {}

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self.rows)
        self.rows.append(rows_of(word))
        if word in VOTES:
            self.vote[n] = VOTES[word]
        return n

    def code(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def votes(self) -> np.ndarray:
        """(words, languages) votes of the words."""
        out = np.zeros((len(self.rows), len(LANGUAGES)), np.int32)
        for n, ks in self.vote.items():
            out[n, list(ks)] = 1
        return out


def language(counts: np.ndarray) -> int:
    """Place in ``LANGUAGES`` of the most voted language (ties: the first); 0 without votes."""
    return int(np.argmax(counts)) if counts.max() > 0 else 0


class ConvNet:
    """Hashed embeddings, convolutions of several widths, max pooling, logistic output."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.seed, self.constant, self.temperature = seed, None, 1.0
        self.thresholds = np.full(len(LANGUAGES), 0.5)
        self.emb = rng.normal(0, 0.1, (ROWS, DIM)).astype(np.float32)
        self.emb[0] = 0
        # one (DIM, FILTERS) matrix for each place of each width
        self.offsets = [(k, o) for k, width in enumerate(WIDTHS) for o in range(width)]
        self.conv = rng.normal(0, 0.3, (len(self.offsets), DIM, FILTERS)).astype(np.float32)
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.out = rng.normal(0, 0.3, (len(WIDTHS), FILTERS)).astype(np.float32)
        self.shift = np.array([-1.0], np.float32)

    def products(self, rows: np.ndarray) -> np.ndarray:
        """(words, places, FILTERS) products of words given by their rows."""
        emb = self.emb[rows].sum(axis=1)
        return np.einsum("wd,odf->wof", emb, self.conv, optimize=True)

    def pooled(self, products: np.ndarray, ids: np.ndarray, first: np.ndarray, where: bool = False, cut: np.ndarray | int = 0):
        """Largest answer of each filter in each text; with ``where``, also its place.

        ``ids`` has ``PADS`` pads after each text; ``first`` has the texts' starts.  A text's
        windows start at its words and at its first pad, so none reaches the next text;
        its last ``cut`` windows are left out."""
        n = len(ids) - PADS + 1
        size = np.diff(np.r_[first, len(ids)]) - PADS + 1
        last = first + size - cut
        best = np.full((len(first), len(WIDTHS), FILTERS), -np.inf, np.float32)
        at = np.zeros(best.shape, np.int64)
        # a stretch of windows at a time, so memory does not grow with a text's windows
        for lo in range(0, n, STRETCH):
            hi = min(lo + STRETCH, n)
            some = np.flatnonzero((first < hi) & (last > lo))
            if not len(some):
                continue
            starts, ends = np.maximum(first[some], lo) - lo, np.minimum(last[some], hi) - lo
            segments = np.stack([starts, ends], axis=1).ravel()
            segments = segments[:-1] if segments[-1] == hi - lo else segments
            if where:
                text = np.clip(np.searchsorted(first[some], np.arange(lo, hi), "right") - 1, 0, None)
            for k in range(len(WIDTHS)):
                z = None
                for p, (kk, o) in enumerate(self.offsets):
                    if kk == k:
                        part = products[:, p][ids[lo + o:hi + o]]
                        z = part if z is None else z + part
                top = np.maximum.reduceat(z, segments, axis=0)[::2]
                if where:
                    order = np.where(z == top[text], np.arange(lo, hi)[:, None], n)
                    place = np.minimum.reduceat(order, segments, axis=0)[::2]
                    at[some, k] = np.where(top > best[some, k], place, at[some, k])
                best[some, k] = np.maximum(best[some, k], top)
        return (best, at) if where else best

    def logits(self, top: np.ndarray) -> np.ndarray:
        """Of (texts, widths, FILTERS) largest answers."""
        return (np.maximum(top + self.bias, 0) * self.out).sum(axis=(1, 2)) + self.shift

    def fit(self, rows: np.ndarray, texts: list[np.ndarray], y: np.ndarray, batch: int = 32, rate: float = 5e-3, decay: float = 1e-5,
            seen: int = 40_000, most: int = 12, epochs: int | None = None, seed: int | None = None) -> None:
        """``epochs`` passes; if not given, until ``seen`` texts were taken: six at least, ``most`` at most."""
        epochs = epochs or min(max(seen // max(len(texts), 1), 6), most)
        rng = np.random.default_rng(self.seed if seed is None else seed)
        params = ["emb", "conv", "bias", "out", "shift"]
        m = {p: np.zeros_like(getattr(self, p)) for p in params}
        v = {p: np.zeros_like(getattr(self, p)) for p in params}
        step = 0
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) ** 0.5
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), batch):
                some = order[lo:lo + batch]
                ids, first = lay([texts[i] for i in some])
                distinct, ids = np.unique(ids, return_inverse=True)
                own = rows[distinct]
                emb = self.emb[own].sum(axis=1)
                products = np.einsum("wd,odf->wof", emb, self.conv, optimize=True)
                top, at = self.pooled(products, ids, first, where=True)
                live = top + self.bias > 0
                z = self.logits(top)
                err = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) * weight[some] / len(some)).astype(np.float32)
                feat = np.maximum(top + self.bias, 0)
                back = err[:, None, None] * self.out * live
                g = {"out": (err[:, None, None] * feat).sum(axis=0) + decay * self.out, "shift": err.sum(keepdims=True), "bias": back.sum(axis=0)}
                d_emb, d_conv = np.zeros_like(emb), decay * self.conv
                for p, (k, o) in enumerate(self.offsets):
                    word = ids[at[:, k] + o]  # (texts, FILTERS)
                    for f in range(FILTERS):
                        gf = back[:, k, f]
                        if gf.any():
                            np.add.at(d_emb, word[:, f], gf[:, None] * self.conv[p, :, f])
                            d_conv[p, :, f] += gf @ emb[word[:, f]]
                used = np.flatnonzero(d_emb.any(axis=1))
                step += 1
                # embeddings: only the rows in use move (and keep their own moments)
                at_rows, inverse = np.unique(own[used].ravel(), return_inverse=True)
                d_rows = np.zeros((len(at_rows), DIM), np.float32)
                np.add.at(d_rows, inverse, np.repeat(d_emb[used], PER_WORD, axis=0))
                c1, c2 = 1 - 0.9 ** step, 1 - 0.999 ** step
                for p in params:
                    s = at_rows if p == "emb" else ...
                    grad = d_rows if p == "emb" else d_conv if p == "conv" else g[p]
                    m[p][s] = 0.9 * m[p][s] + 0.1 * grad
                    v[p][s] = 0.999 * v[p][s] + 0.001 * grad * grad
                    getattr(self, p)[s] -= rate * (m[p][s] / c1) / (np.sqrt(v[p][s] / c2) + 1e-8)
                self.emb[0] = 0

    def calibrate(self, z: np.ndarray, y: np.ndarray, spoken: np.ndarray, times: np.ndarray | None = None) -> None:
        """Temperature, then a threshold for each language, on texts kept from the fit;
        an entry stands for ``times`` texts (one, if not given)."""
        if not len(z):
            return
        times = np.ones(len(z)) if times is None else times
        sizes = np.exp(np.linspace(-1.5, 3, 181))
        loss = [np.average(np.logaddexp(0, np.where(y > 0, -z, z) / t), weights=times) for t in sizes]
        self.temperature = float(sizes[int(np.argmin(loss))])
        p = self.probability(z)
        self.thresholds[:] = best_threshold(p, y, times)
        for k in range(len(LANGUAGES)):
            mine = spoken == k
            n = min(times[mine & (y > 0)].sum(), times[mine & (y <= 0)].sum())
            if n >= LEAST:  # between its own and that of all, by how many texts speak for it
                own, all_ = np.clip([best_threshold(p[mine], y[mine], times[mine]), self.thresholds[0]], 1e-6, 1 - 1e-6)
                z = (n * np.log(own / (1 - own)) + SHRINK * np.log(all_ / (1 - all_))) / (n + SHRINK)
                self.thresholds[k] = 1 / (1 + np.exp(-z))

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z / self.temperature, -30, 30)))

    def scores(self, z: np.ndarray, spoken: np.ndarray) -> np.ndarray:
        """Calibrated probabilities, moved so that the language's threshold is at 0.5."""
        t = np.clip(self.thresholds[spoken], 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(np.clip(z / self.temperature, -30, 30) - np.log(t / (1 - t)))))


def best_threshold(p: np.ndarray, y: np.ndarray, times: np.ndarray | None = None) -> float:
    """Middle of the widest gap between probabilities at which F1 is best; 0.5 if nothing is to be told apart."""
    if len(np.unique(y)) < 2:
        return 0.5
    edges = np.unique(np.r_[0.0, p, 1.0])
    cuts = (edges[1:] + edges[:-1]) / 2
    times, order = np.ones(len(p)) if times is None else times, np.argsort(p)
    taken, caught = (np.r_[np.cumsum(w[order][::-1])[::-1], 0] for w in (times, times * (y > 0)))
    at = np.searchsorted(p[order], cuts)  # the first that is not below the cut
    hit = 2 * caught[at] / np.maximum(taken[at] + caught[0], 1)
    good = np.flatnonzero(hit >= hit.max() - 1e-12)
    return float(cuts[good[int(np.argmax(edges[good + 1] - edges[good]))]])


def lay(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of texts end to end with ``PADS`` pads after each, and the texts' starts."""
    sizes = np.array([len(t) for t in texts], np.int64) + PADS
    first = np.cumsum(sizes) - sizes
    ids = np.zeros(int(sizes.sum()), np.int64)
    for f, t in zip(first, texts, strict=True):
        ids[f:f + len(t)] = t
    return ids, first


PIECES_OF = [("conv", (sum(WIDTHS), DIM, FILTERS)), ("bias", (len(WIDTHS), FILTERS)), ("out", (len(WIDTHS), FILTERS)), ("shift", (1,))]
WEIGHTS = StructType([StructField("r", LongType())] + [StructField(f"v{i}", LongType()) for i in range(DIM)])


def weight_rows(net: ConvNet, before: ConvNet) -> pa.Table:
    """Weights in fixed point: a row for each embedding row that moved, and the others ``DIM`` a row after them."""
    moved = np.flatnonzero((net.emb != before.emb).any(axis=1))
    dense = np.concatenate([getattr(net, n).ravel() for n, _ in PIECES_OF])
    dense = np.r_[dense, np.zeros(-len(dense) % DIM)].reshape(-1, DIM)
    at = np.r_[moved, ROWS + np.arange(len(dense))].astype(np.int64)
    values = np.round(np.r_[net.emb[moved], dense].astype(np.float64) * FIXED).astype(np.int64)
    return pa.Table.from_arrays([pa.array(at)] + [pa.array(np.ascontiguousarray(values[:, i])) for i in range(DIM)], names=WEIGHTS.names)


def take_means(net: ConvNet, at: np.ndarray, values: np.ndarray) -> None:
    """Weights from mean rows of ``weight_rows``."""
    net.emb[at[at < ROWS]] = values[at < ROWS].astype(np.float32)
    dense = values[at >= ROWS][np.argsort(at[at >= ROWS])].ravel()
    lo = 0
    for name, shape in PIECES_OF:
        size = int(np.prod(shape))
        setattr(net, name, dense[lo:lo + size].reshape(shape).astype(np.float32))
        lo += size


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``id, kept, y, t, n``: the lower-cased words of every labelled text outside the held-out fifth."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(
        "id is not null and y in (0, 1)").where(crc32_mod("id", 5) != 0)
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").select("id", "y")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).where(
        "id is not null").where(crc32_mod("id", 5) != 0)
    # both grow with the input; the groups need no further shuffle
    texts = texts.join(known.hint("merge"), "id").groupBy("id").agg(F.min("t").alias("t"), F.min("y").alias("y"))
    kept = F.crc32(F.concat(F.lit("kept"), F.col("id").cast("string")).cast("binary")) % 5 == 0
    texts = texts.select("id", kept.alias("kept"), "y", "t")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 500):
            found = [[w for part in words_of(t) for w in part] for t in b.column(3).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array([" ".join(w) for w in found], pa.string()),
                                   pa.array([len(w) for w in found], pa.int64())], names=["id", "kept", "y", "t", "n"])

    schema = StructType([texts.schema["id"], StructField("kept", BooleanType()), StructField("y", IntegerType()),
                         StructField("t", StringType()), StructField("n", LongType())])
    return texts.mapInArrow(words, schema)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ConvNet:
    """The network of the labelled texts outside the held-out fifth."""
    spark = docs.sparkSession
    rows = store(labelled_texts(docs, labels, id_col, text_col, label_col), "toxicity-texts")
    size = rows.groupBy("kept", "y").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("words")).collect()
    net, learnt = ConvNet(), [r for r in size if not r["kept"]]
    if len(learnt) < 2:
        n = sum(r["texts"] for r in size)
        net.constant = sum(r["texts"] for r in size if r["y"]) / n if n else 0.5
        return net
    blocks = max(-(-sum(r["texts"] for r in learnt) // BLOCK_TEXTS), -(-sum(r["words"] for r in learnt) // BLOCK_WORDS), 1)
    dealt = rows.where("not kept").select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.col("id").cast("string").alias("id"), "y", "t")

    def learn(some: DataFrame, net: ConvNet, turn: int) -> None:
        """Mean weights after each of ``some`` blocks was learnt from those of ``net``."""
        shared = spark.sparkContext.broadcast(net)

        def block(part: pa.Table) -> pa.Table:
            part = part.sort_by("id")
            net, coder = pickle.loads(pickle.dumps(shared.value)), Coder()
            coded = [coder.code(t.as_py().split()) for t in part.column("t")]
            y = np.array(part.column("y").to_pylist(), np.float64)
            if turn:
                net.fit(np.array(coder.rows, np.int64), coded, y, rate=ROUND_RATE, epochs=1, seed=zlib.crc32(b"%d %d" % (turn, part.column("block")[0].as_py())))
            else:
                net.fit(np.array(coder.rows, np.int64), coded, y)
            return weight_rows(net, shared.value)

        means = some.groupBy("block").applyInArrow(block, WEIGHTS).groupBy("r").agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(f"v{i}").alias(f"v{i}") for i in range(DIM)]).toArrow()
        # one row for each embedding row at most, however many blocks there are
        values = np.stack([means.column(f"v{i}").to_numpy() for i in range(DIM)], axis=1) / FIXED / means.column("n").to_numpy()[:, None]
        shared.unpersist()
        if len(values):
            take_means(net, means.column("r").to_numpy(), values)

    learn(dealt.where("block = 0"), net, 0)
    for turn in range(1, ROUNDS + 1 if blocks > 1 else 1):
        learn(dealt, net, turn)
    shared = spark.sparkContext.broadcast(net)

    def heard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of (language, label, place on the grid)."""
        scorer, counts = Scorer(shared.value), Counter()
        for b in small_batches(batches, 500):
            z, spoken = scorer(b.column(1).to_pylist())
            counts.update(zip(spoken.tolist(), b.column(0).to_pylist(), np.round(np.clip(z, -100, 100) * GRID).astype(np.int64).tolist(), strict=True))
        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*[(*k, n) for k, n in counts.items()], strict=True)] if counts
                              else [pa.array([], pa.int64())] * 4, names=["spoken", "y", "z", "n"])

    # at most one row for each language, label and place on the grid
    grid = rows.where("kept").select("y", "t").mapInArrow(heard, "spoken long, y long, z long, n long").groupBy("spoken", "y", "z").agg(
        F.sum("n").alias("n")).orderBy("spoken", "y", "z").toArrow()
    spoken, y, z, n = (grid.column(c).to_numpy() for c in ("spoken", "y", "z", "n"))
    net.calibrate(z / GRID, y.astype(np.float64), spoken, n.astype(np.float64))
    return net


class Scorer:
    """Scores whole texts; products of words are kept between texts."""

    def __init__(self, net: ConvNet):
        self.net = net
        self._clear()

    def _clear(self) -> None:
        self.coder, self.made = Coder(), 0
        # a batch may bring as many new words as it has
        self.products = np.zeros((CACHE_WORDS + BATCH_WORDS + PIECE + PADS, len(self.net.offsets), FILTERS), np.float32)

    def _grow(self) -> None:
        """Products of words met since the last call."""
        new = np.array(self.coder.rows[self.made:], np.int64).reshape(-1, PER_WORD)
        self.products[self.made:self.made + len(new)] = self.net.products(new)
        self.made += len(new)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Logits and languages of texts."""
        top = np.full((len(texts), len(WIDTHS), FILTERS), -np.inf, np.float32)
        heard = np.zeros((len(texts), len(LANGUAGES)), np.int64)
        pieces, owners, cuts, held = [], [], [], 0

        def flush():
            nonlocal pieces, owners, cuts, held
            if pieces:
                self._grow()
                ids, first = lay(pieces)
                np.maximum.at(top, np.array(owners), self.net.pooled(self.products, ids, first, cut=np.array(cuts)))
                votes = self.coder.votes()
                for i, piece, cut in zip(owners, pieces, cuts, strict=True):
                    heard[i] += votes[piece[:len(piece) - REACH if cut else None]].sum(axis=0)
            if len(self.coder.rows) > CACHE_WORDS:  # bounded memory
                self._clear()
            pieces, owners, cuts, held = [], [], [], 0

        def take(i: int, words: list[str], cut: int):
            nonlocal held
            pieces.append(self.coder.code(words))
            owners.append(i)
            cuts.append(cut)
            held += len(words)
            if held > BATCH_WORDS:
                flush()

        for i, text in enumerate(texts):
            words: list[str] = []
            for part in words_of(text):
                words += part
                lo = 0
                while len(words) - lo > PIECE:
                    # windows over the seam belong to the next piece
                    take(i, words[lo:lo + PIECE], REACH + 1)
                    lo += PIECE - REACH
                words = words[lo:]
            take(i, words, 0)
        flush()
        return self.net.logits(top), np.array([language(h) for h in heard], np.int64)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``id_col, held_out, score, predicted, language, threshold`` per row; the threshold
    is that of the language on the calibrated probability, at 0.5 of the score."""
    net = fit(docs, labels, id_col, text_col, label_col)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        scorer = Scorer(net)
        for b in small_batches(batches, 500):
            z, spoken = scorer(b.column(2).to_pylist())
            p = np.full(len(z), net.constant) if net.constant is not None else net.scores(z.astype(np.float64), spoken)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32)),
                                   pa.array([LANGUAGES[k] for k in spoken], pa.string()), pa.array(net.thresholds[spoken])],
                                  names=["id", "held_out", "score", "predicted", "language", "threshold"])

    rows = docs.select(F.col(id_col).alias("id"), (crc32_mod(id_col, 5) == 0).alias("held_out"), F.col(text_col).cast("string").alias("t"))
    schema = StructType([rows.schema["id"], StructField("held_out", BooleanType()), StructField("score", DoubleType()),
                         StructField("predicted", IntegerType()), StructField("language", StringType()), StructField("threshold", DoubleType())])
    return rows.mapInArrow(score, schema).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
