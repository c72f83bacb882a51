"""Quality rules with line sequence labelling (operator 10).

Counts of a text come first (words, symbols, repeated lines, repeated 3-word
windows) and fail it under two fixed limits.  For the others a linear-chain
conditional random field labels every line as content or boilerplate; the
Viterbi path decides, and a text is kept when content lines hold at least
``min_share`` of its words.

The field has two states, binary line features and learnt transitions.  It is
fitted in numpy on a bounded sample of labelled documents (``max_labelled`` by
hash order of the id, each of ``max_lines`` lines at most).  Only documents have
labels; the states of their lines are latent and found by hard expectation
maximisation (``learn``): emissions alone first, with each line in the state of its
document, then lines get the likeliest states under which content holds at least
half of the words of a document of quality 1 and less than half in one of quality 0,
and the field is fitted again.  So a clean line in a bad document counts as
content, and transitions between the states are seen.  Counting, labelling and
decoding cover every line of every text.

Defined results: null text counts as empty (no words, fails the first limit);
blank lines are labelled but weigh nothing; repeated rows are judged one by
one; without labels of both classes every line is content; other input columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from recordchecks.llm.common import read_table, small_batches

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
CONTENT, BOILERPLATE = 1, 0
SYMBOLS = re.compile(r"[#*$%&|<>]")
SPACE = re.compile(r"[\x20\x09-\x0D]")
NOTICE = re.compile(r"licen[sc]e|copyright|all rights reserved|cookie|privacy|subscribe|click here|terms of", re.I)
FEATURES = 24


def line_features(line: str, again: bool) -> int:
    """Binary features of a line as bits; ``again``: it equals an earlier line."""
    words = line.split()
    n, chars = len(words), max(len(line), 1)
    if not n:
        return 1 | 2
    symbols, letters = len(SYMBOLS.findall(line)), sum(map(str.isalpha, line))
    capitals = sum(map(str.isupper, line))
    length = sum(map(len, words)) / n
    on = (True, False, n < 4, n < 10, n >= 40, again, symbols > 0, 20 * symbols > n, 5 * symbols > n, 2 * symbols > n,
          2 * letters < chars, 5 * letters < 4 * chars, 5 * capitals > letters, 2 * capitals > letters, line.rstrip()[-1] in ".!?:;\"”»",
          "|" in line, "!!" in line, bool(NOTICE.search(line)), any(map(str.isdigit, line)), length < 3, length > 9,
          n >= 6 and 2 * len(set(words)) < n, n >= 6 and 4 * len(set(words)) < n, n >= 4 and sum(map(str.__eq__, words, words[1:])) * 3 > n)
    return sum(1 << i for i, x in enumerate(on) if x)


def lines_of(text: str) -> tuple[list[int], list[int], int]:
    """Features and words of each line, and the number of repeated lines with a word."""
    seen: set[str] = set()
    masks, words, dup = [], [], 0
    for line in text.split("\n"):
        n = len(line.encode().split())
        again = n > 0 and line in seen
        dup += again
        seen.add(line)
        masks.append(line_features(line, again))
        words.append(n)
    return masks, words, dup


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    key = ids[:n]
    for k in range(1, WINDOW):  # dense numbers keep the products below 2^63
        key = np.unique(key * len(number) + ids[k:k + n], return_inverse=True)[1]
    twice = np.bincount(key)[key] > 1
    if not twice.any():
        return 0
    inside = np.zeros(len(words), bool)
    for k in range(WINDOW):
        inside[k:k + n] |= twice
    return int(inside.sum())


def unpack(masks: np.ndarray) -> np.ndarray:
    return ((masks[:, None] >> np.arange(FEATURES)) & 1).astype(np.float64)


class Crf:
    """Linear-chain conditional random field with two states."""

    def __init__(self):
        self.emit, self.move = np.zeros((FEATURES, 2)), np.zeros((2, 2))

    def fit(self, masks: list[np.ndarray], states: list, steps: int = 150, decay: float = 1e-3, chain: bool = True) -> Crf:
        """Maximise the mean log-likelihood of whole sequences from the present
        parameters; a sequence's states are one for all lines or an array.  Without
        ``chain`` only emissions are fitted."""
        if len({int(s) for some in states for s in np.unique(some)}) < 2:
            self.emit[0, CONTENT] = 1.0
            return self
        order = sorted(range(len(masks)), key=lambda i: -len(masks[i]))
        size = np.array([len(masks[i]) for i in order])
        full = [np.broadcast_to(states[i], len(masks[i])) for i in order]
        longest, total = int(size[0]), int(size.sum())
        alive = [int((size > t).sum()) for t in range(longest)]  # longest first: the first rows live on
        y = [np.array([full[i][t] for i in range(alive[t])]) for t in range(longest)]
        moves = np.zeros((2, 2))
        for t in range(1, longest):
            np.add.at(moves, (y[t - 1][:alive[t]], y[t]), 1)
        x = [unpack(np.array([masks[order[i]][t] for i in range(alive[t])], np.int64)) for t in range(longest)]
        params, m, v = np.concatenate([self.emit.ravel(), self.move.ravel()]), 0.0, 0.0
        for step in range(1, steps + 1):
            emit, move = params[:-4].reshape(FEATURES, 2), params[-4:].reshape(2, 2)
            e = [f @ emit for f in x]
            a = [e[0]]
            for t in range(1, longest):
                k = alive[t]
                a.append(e[t] + np.logaddexp(a[-1][:k, :1] + move[0], a[-1][:k, 1:] + move[1]))
            b: list = [None] * longest
            for t in range(longest - 1, -1, -1):
                b[t] = np.zeros((alive[t], 2))
                if t + 1 < longest:
                    k = alive[t + 1]
                    nxt = e[t + 1] + b[t + 1]
                    b[t][:k] = np.logaddexp(nxt[:, :1] + move[:, 0], nxt[:, 1:] + move[:, 1])
            z = np.logaddexp.reduce(a[0] + b[0], axis=1)
            g_emit, g_move = np.zeros((FEATURES, 2)), moves.copy()
            for t in range(longest):
                k = alive[t]
                p = -np.exp(a[t] + b[t] - z[:k, None])
                p[np.arange(k), y[t]] += 1
                g_emit += x[t].T @ p
                if t + 1 < longest:
                    k = alive[t + 1]
                    joint = a[t][:k, :, None] + move + (e[t + 1] + b[t + 1])[:, None, :] - z[:k, None, None]
                    g_move -= np.exp(joint).sum(axis=0)
            g = np.concatenate([g_emit.ravel(), g_move.ravel() * chain]) / total - decay * params
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            params = params + 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        self.emit, self.move = params[:-4].reshape(FEATURES, 2), params[-4:].reshape(2, 2)
        return self

    def viterbi(self, masks: list[int]) -> list[int]:
        """Likeliest states of a sequence; ties go to content."""
        scores = (unpack(np.array(masks, np.int64)) @ self.emit).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        s0, s1 = scores[0]
        back = []
        for e0, e1 in scores[1:]:
            p0, p1 = s0 + m00 <= s1 + m10, s0 + m01 <= s1 + m11
            back.append((p0, p1))
            s0, s1 = (s1 + m10 if p0 else s0 + m00) + e0, (s1 + m11 if p1 else s0 + m01) + e1
        state = int(s1 >= s0)
        path = [state]
        for step in reversed(back):
            state = int(step[state])
            path.append(state)
        return path[::-1]


def constrained(crf: Crf, masks: np.ndarray, words: np.ndarray, label: int) -> np.ndarray:
    """States of a labelled document's lines: the likeliest path, of which lines are
    turned, the least certain first, until the label's side holds half of the words."""
    path = np.array(crf.viterbi(masks.tolist()))
    e = unpack(masks) @ crf.emit
    certain = e[:, 1 - label] - e[:, label]
    held, needed = int(words[path == label].sum()), int(words.sum()) / 2
    for i in np.argsort(certain, kind="stable"):
        if held >= needed if label == CONTENT else held > needed:
            break
        if path[i] != label:
            path[i], held = label, held + int(words[i])
    return path


def learn(masks: list[np.ndarray], words: list[np.ndarray], labels: list[int], rounds: int = 2) -> Crf:
    """The field of documents with one label each and latent line states."""
    crf = Crf().fit(masks, labels, chain=False)
    for _ in range(rounds if len(set(labels)) > 1 else 0):
        states = [constrained(crf, m, w, y) for m, w, y in zip(masks, words, labels, strict=True)]
        crf.fit(masks, states, steps=75)
    return crf


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        max_labelled: int = 4_000, max_lines: int = 1_000) -> Crf:
    """The field of a bounded sample of labelled documents."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").select("id", "y")
    sample = known.orderBy(F.xxhash64("id"), "id").limit(max_labelled)

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 200):
            x = [lines_of(t or "")[:2] for t in b.column(2).to_pylist()]
            few = pa.array([len(m) <= max_lines for m, _ in x])
            lists = [pa.array([part[k] for part in x], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.record_batch([b.column(0), b.column(1), *lists], names=["id", "y", "x", "w"]).filter(few)

    # max_labelled rows at most, so broadcasting the sample is safe
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(sample), "id")
    rows = texts.select("id", "y", "t").mapInArrow(masks, f"id {docs.schema[id_col].dataType.simpleString()}, y int, x array<long>, w array<long>")
    rows = rows.groupBy("id").agg(F.min(F.struct("y", "x", "w")).alias("r")).select("id", "r.*").collect()
    rows = sorted((str(r["id"]), r["y"], r["x"], r["w"]) for r in rows)
    return learn([np.array(r[2], np.int64) for r in rows], [np.array(r[3], np.int64) for r in rows], [r[1] for r in rows])


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", min_share: float = 0.5, max_labelled: int = 4_000) -> DataFrame:
    """``id_col``, the counts, ``base_failed``, ``content_share`` and ``kept`` per row."""
    crf = fit(docs, labels, id_col, text_col, label_col, max_labelled)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_content_words"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 200):
            rows = []
            for t in b.column(1).to_pylist():
                t = t or ""
                words = t.encode().split()
                masks, per_line, dup = lines_of(t)
                content = sum(n for n, s in zip(per_line, crf.viterbi(masks), strict=True) if s == CONTENT)
                rows.append((len(words), len(t) - len(SPACE.findall(t)), len(SYMBOLS.findall(t)), dup, repeated_words(words), content))
            cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))]
            yield pa.record_batch([b.column(0), *cols], names=["id", *names])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    schema = StructType([rows.schema["id"], *(StructField(n, LongType()) for n in names)])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    share = F.when(F.col("n_words") > 0, F.col("n_content_words") / F.col("n_words")).otherwise(0.0)
    return rows.mapInArrow(judge, schema).select(
        F.col("id").alias(id_col), *names[:-1], failed.alias("base_failed"), share.alias("content_share"),
        (~failed & (share >= min_share)).cast(BooleanType()).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
