"""Periodic runs of words and their collapse (operator 13).

A run is a stretch of words with smallest period q and at least ``max(min_words,
2 q)`` words that no neighbour extends.  Texts of a task are taken in batches of
about ``BATCH_WORDS`` words (a longer text is a batch of its own) and laid end to
end, each between separators that occur once, so that no match leaves its text.

1. Difference cover: only the suffixes at places whose remainder by ``COVER`` is in
   ``CLASSES`` are sorted, by blocks of ``COVER`` words and then by doubling.
2. LCE of two places: words are compared one by one until both places are
   sampled (``COVER - 1`` comparisons at most, one or two for most pairs); from
   there the answer is a range minimum of the sampled suffixes' common
   prefixes, out of a sparse table.  The words backwards have an index of their own.
   An index is built for the first pair that needs it.
3. Harmonic grid: a run of period p covers two grid places p apart, of which
   there are n/p; all p together have n log n pairs.  A pair of equal words is
   extended both ways by LCE; the stretch is kept when long enough.  The same
   stretch found at several p has the smallest of them as its period.

One map-side pass, no shuffle; memory is bounded by a batch and ``GRID`` pairs.

Defined results: null and empty texts have no words, no runs and an empty collapsed
text; repeated rows are answered one by one; a null id is altered (if asked) as
the text 'null'; other input columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from recordchecks.llm.common import blobs, read_table, small_batches

# a perfect difference set: every remainder by 31 is a difference of two of its members
COVER, CLASSES = 31, (1, 5, 11, 24, 25, 27)
BATCH_WORDS, GRID = 100_000, 1_000_000
Alter = Callable[[str, list[bytes]], list[bytes]]


def _shifts() -> np.ndarray:
    """``[a, b]``: the least shift that takes remainders a and b both into the cover."""
    inside = np.zeros(COVER, bool)
    inside[list(CLASSES)] = True
    at = np.arange(COVER)
    out = np.full((COVER, COVER), -1)
    for d in reversed(range(COVER)):
        ok = inside[(at[:, None] + d) % COVER] & inside[(at[None, :] + d) % COVER]
        out[ok] = d
    return out


SHIFT = _shifts()


class Extension:
    """Longest common extensions to the right in ``words``; each pair of places must
    meet a word that occurs once before the end."""

    def __init__(self, words: np.ndarray):
        self.words, self.ready = words, False

    def _build(self) -> None:
        """Order, common prefixes and sparse table of the sampled suffixes."""
        self.ready = True
        n = len(self.words)
        padded = np.r_[self.words, np.full(COVER, -1, self.words.dtype)]
        places = [np.arange(c, n, COVER) for c in CLASSES]
        place = np.concatenate(places)  # neighbours are COVER apart within a class
        m = len(place)
        succ = np.arange(1, m + 1)
        succ[np.cumsum([len(p) for p in places]) - 1] = m  # a class's last: the empty suffix, m
        blocks = padded[place[:, None] + np.arange(COVER)].astype(">i4")
        rank = np.unique(blocks.view(f"V{4 * COVER}").ravel(), return_inverse=True)[1]
        levels, jumps = [], []
        while True:
            levels.append(np.r_[rank, -1])
            jumps.append(np.r_[succ, m])
            if rank.max(initial=0) == m - 1:
                break
            # two suffixes with equal blocks as far as this level, ordered by what follows
            rank = np.unique(rank * (m + 1) + levels[-1][succ] + 1, return_inverse=True)[1]
            succ = jumps[-1][succ]
        order = np.argsort(rank)
        self.rank_at = np.full(n + 1, -1)
        self.rank_at[place] = rank
        # common prefix of neighbours in the order: whole blocks by level, then words
        a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(max(m - 1, 0), np.int64)
        for k in reversed(range(len(levels))):
            same = (levels[k][a] == levels[k][b]) & (a < m) & (b < m)
            common[same] += COVER << k
            a[same], b[same] = jumps[k][a[same]], jumps[k][b[same]]
        left, right = place[order[:-1]] + common, place[order[1:]] + common
        going = np.flatnonzero((left < n) & (right < n))
        for _ in range(COVER):
            going = going[padded[left[going]] == padded[right[going]]]
            common[going] += 1
            left[going] += 1
            right[going] += 1
            going = going[(left[going] < n) & (right[going] < n)]
        self.table = [common.astype(np.int64)]
        while 2 << len(self.table) - 1 <= len(common):
            half = 1 << len(self.table) - 1
            t = self.table[-1]
            self.table.append(np.minimum(t[:-half], t[half:]))

    def _minimum(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least common prefix among neighbours ``lo`` to ``hi - 1`` of the order."""
        k = np.frexp(hi - lo)[1] - 1
        out = np.empty(len(lo), np.int64)
        for level in np.unique(k):
            at, t = k == level, self.table[level]
            out[at] = np.minimum(t[lo[at]], t[hi[at] - (1 << level)])
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from places i and j on are equal, pair by pair (i != j)."""
        w, out = self.words, np.zeros(len(i), np.int64)
        shift = SHIFT[i % COVER, j % COVER]
        going = np.arange(len(i))
        sampled = []
        for d in range(COVER):
            there = shift[going] == d
            sampled.append(going[there])
            going = going[~there]
            going = going[w[i[going] + d] == w[j[going] + d]]
            out[going] += 1
            if not len(going):
                break
        at = np.concatenate(sampled)
        if len(at):
            if not self.ready:
                self._build()
            a, b = self.rank_at[i[at] + out[at]], self.rank_at[j[at] + out[at]]
            out[at] += self._minimum(np.minimum(a, b), np.maximum(a, b))
        return out


def runs_of(texts: list[np.ndarray], min_words: int = 12) -> list[np.ndarray]:
    """For each text, given as word numbers, its runs as rows (start, length, period) by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    top = max((int(t.max()) for t in texts if len(t)), default=0) + 1
    # a separator before each text and after the last one, each a number of its own
    laid = np.empty(int(sizes.sum()) + len(texts) + 1, np.int32)
    first = np.cumsum(sizes + 1) - sizes
    laid[np.r_[first - 1, len(laid) - 1]] = top + np.arange(len(texts) + 1)
    for f, t in zip(first, texts, strict=True):
        laid[f:f + len(t)] = t
    forward, backward = Extension(laid), Extension(laid[::-1].copy())
    # (text, period) with its number of grid pairs
    periods = np.where(sizes >= min_words, sizes // 2, 0)
    text = np.repeat(np.arange(len(texts)), periods)
    p = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    pairs = (sizes[text] - 1) // np.maximum(p, 1)
    done = np.cumsum(pairs)
    found = [np.zeros((0, 3), np.int64)]
    lo = 0
    while lo < len(pairs):
        hi = max(int(np.searchsorted(done, (done[lo - 1] if lo else 0) + GRID, "right")), lo + 1)
        n = pairs[lo:hi]
        step = np.repeat(p[lo:hi], n)
        i = np.repeat(first[text[lo:hi]], n) + (np.arange(len(step)) - np.repeat(np.cumsum(n) - n, n)) * step
        equal = np.flatnonzero(laid[i] == laid[i + step])
        i, step = i[equal], step[equal]
        right, left = forward(i, i + step), backward(len(laid) - i, len(laid) - i - step)
        length = left + step + right
        keep = length >= np.maximum(min_words, 2 * step)
        rows = np.stack([i - left, length, step], axis=1)[keep]
        found.append(_smallest(rows))
        lo = hi
    rows = _smallest(np.concatenate(found))
    cut = np.searchsorted(rows[:, 0], np.r_[first, len(laid)])
    out = []
    for k, f in enumerate(first):
        mine = rows[cut[k]:cut[k + 1]]
        out.append(mine - [f, 0, 0])
    return out


def _smallest(rows: np.ndarray) -> np.ndarray:
    """Of rows (start, length, period) with the same stretch that of the least period; by start, then period."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)][:len(rows)]
    rows = rows[new]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stand in no run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:n]) == 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 12,
                  alter: Alter | None = None) -> DataFrame:
    """``id_col, n_words, runs, collapsed`` per row: the runs as structs (start,
    length, period) by start, then period, and the kept words joined by one space.

    ``alter`` maps an id (as text) and the words of its row to the words to look at."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
            numbers: dict[bytes, int] = {}
            coded = [np.array([numbers.setdefault(w, len(numbers)) for w in t], np.int32) for t in texts]
            found = runs_of(coded, min_words)
            collapsed = []
            for t, r in zip(texts, found, strict=True):
                if len(r):
                    t = [t[k] for k in np.flatnonzero(kept_words(len(t), r))]
                collapsed.append(b" ".join(t))
            flat = np.concatenate([*found, np.zeros((0, 3), np.int64)])
            structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
            offsets = pa.array(np.r_[0, np.cumsum([len(r) for r in found])], pa.int32())
            return pa.record_batch([pa.concat_arrays(ids), pa.array([len(t) for t in texts], pa.int64()),
                                    pa.ListArray.from_arrays(offsets, structs), pa.array(collapsed, pa.binary()).cast(pa.string())],
                                   names=["id", "n_words", "runs", "collapsed"])

        ids, texts, held = [], [], 0
        for b in small_batches(batches, 500):
            names = b.column(1).to_pylist()
            for k, t in enumerate(blobs(b.column(2))):
                words = t.split()
                if alter:
                    words = alter(names[k] or "null", words)
                if texts and held + len(words) > BATCH_WORDS:
                    yield answer(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(b.column(0).slice(k, 1))
                texts.append(words)
                held += len(words)
        if texts:
            yield answer(ids, texts)

    rows = docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("name"), F.col(text_col).cast("string").alias("t"))
    run_type = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])
    schema = StructType([rows.schema["id"], StructField("n_words", LongType()), StructField("runs", ArrayType(run_type)),
                         StructField("collapsed", StringType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def with_tail(name: str, words: list[bytes]) -> list[bytes]:
    """The words, for one id in ten with a tail made periodic."""
    h, n = zlib.crc32(name.encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + k % p] for k in range(n - a))]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(read_table(spark, sf_dir, "documents"), alter=with_tail)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"), F.floor(1000 * F.col("best.length") / -F.col("best.p")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
