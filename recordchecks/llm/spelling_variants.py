"""Grouping of spelling variants by a variable-length gram index (operator 11).

1. Words (runs of Latin letters) are counted map-side in bounded tables, then summed
   by word; words of at least ``min_length`` code points and ``min_count``
   occurrences are the vocabulary, a table of any size.
2. Gram dictionary: the grams of ``QMIN`` code points, and every longer one (``QMAX`` at
   most) whose beginning is frequent, i.e. occurs more than T times in the
   vocabulary.  Frequent grams thus go on to longer ones and no list of words grows
   hot.  Only the frequent grams are broadcast: T is at least the number of gram
   occurrences over ``FREQUENT``, so there are at most ``FREQUENT`` of a length.
3. A word is cut at each place into the longest gram of the dictionary there; grams
   inside another one are left out.
4. Affected-gram bound: for each place and gap of the word, the grams that one edit
   there may change: those over it, those right of it that a new gram over the
   edit could swallow, the last one if it could go on.  The largest number is the
   word's bound B; all but B of its grams are also grams of any near word, in place
   or shifted by one.
5. List merging: with the grams in one order (rare first), the first common gram of two
   near words is among the first B + 1 of both.  Only these enter lists, keyed by
   gram, place and length, and one join merges them.  Two words whose bounds
   both cover all their grams need not share one: such words (half of a vocabulary or
   more) also enter ``PARTS`` lists of all but one of as many parts of the word, as an
   edit leaves all but one as they are.
6. Every pair of a list is verified by edit distance before it is kept, after two bit
   masks (one edit changes 2 of a word's letters and 4 of its letter pairs at most);
   pairs are then made distinct.  A word's form is its most frequent near word, if that is ``ratio``
   times as frequent; roots follow forms by pointer jumping.

Defined results: null and empty texts have no words; repeated rows count one by one;
a null id is altered (if asked) as the text 'null'; ties in frequency go to the
smallest word in code-point order; an empty table gives an empty result; other input
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordchecks.llm.common import read_table, small_batches, store

QMIN, QMAX = 2, 6
LEAST_FREQUENT, FREQUENT, PARTS = 1_000, 50_000, 4
FLUSH_WORDS = 300_000
# All letters of a run are in Latin-1: there, other characters become spaces and A-Z small
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
Alter = Callable[[bytes, bytes], bytes]


def runs(text: str | None) -> list[bytes]:
    """The runs of a text, A-Z in small letters, in Latin-1."""
    return (text or "").encode("latin-1", "replace").translate(LETTERS).split()


def count_words(docs: DataFrame, id_col: str, text_col: str, min_length: int, min_count: int, alter: Alter | None) -> DataFrame:
    """``word, n`` of the words with ``min_length`` code points and ``min_count`` occurrences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.record_batch({"word": pa.array([w.decode("latin-1") for w in seen], pa.string()),
                                    "n": pa.array(list(seen.values()), pa.int64())})

        for b in small_batches(batches, 500):
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                # an altered word may lose one code point
                of_text = Counter(w for w in runs(text) if len(w) >= min_length)
                if alter:
                    prefix = f"{name or 'null'}:".encode()
                    for w, n in of_text.items():
                        w = alter(prefix, w)
                        if len(w) >= min_length:
                            seen[w] += n
                else:
                    seen.update(of_text)
                if len(seen) > FLUSH_WORDS:  # bounded memory
                    yield rows()
                    seen.clear()
        yield rows()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def frequent_grams(words: DataFrame, qmin: int = QMIN, qmax: int = QMAX) -> dict[str, int]:
    """Grams shorter than ``qmax`` that are in more than T places of the words, with how many."""
    total = words.agg(F.sum(F.length("word"))).first()[0] or 0
    least = max(LEAST_FREQUENT, total // FREQUENT)
    out = {}
    for q in range(qmin, qmax):
        starts = words.where(F.length("word") >= q).select("word", F.explode(F.sequence(F.lit(1), F.length("word") - (q - 1))).alias("i"))
        grams = starts.select(F.substring("word", F.col("i"), F.lit(q)).alias("g"))
        # at most total / least <= FREQUENT rows
        out |= {r["g"]: r["c"] for r in grams.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > least).collect()}
    return out


def decompose(word: str, frequent: dict[str, int], qmin: int = QMIN, qmax: int = QMAX) -> list[tuple[int, int]]:
    """Variable-length grams of a word as (start, end)."""
    out, last = [], 0
    for a in range(len(word) - qmin + 1):
        b = a + qmin
        while b < len(word) and b - a < qmax and word[a:b] in frequent:
            b += 1
        if b > last:
            out.append((a, b))
            last = b
    return out


def affected(word: str, grams: list[tuple[int, int]], frequent: dict[str, int], qmin: int = QMIN, qmax: int = QMAX) -> int:
    """The most grams that one inserted, deleted or replaced code point may change."""
    def swallowed(a: int, b: int, rest: int) -> bool:
        """May a gram that reaches over an edit just before ``rest`` hold word[a:b]?"""
        middle = word[rest:b - 1]  # of that gram without its ends
        return b - rest < qmax and (len(middle) < qmin or middle in frequent)

    most = 0
    for i in range(len(word)):  # a deleted or replaced place
        most = max(most, sum(a <= i < b or (a > i and swallowed(a, b, i + 1)) for a, b in grams))
    for i in range(len(word) + 1):  # a gap
        most = max(most, sum(a < i < b or (a >= i and swallowed(a, b, i))
                             or (i == len(word) == b and b - a < qmax and word[a:b] in frequent) for a, b in grams))
    return most


def keys_of(word: str, frequent: dict[str, int], qmin: int = QMIN, qmax: int = QMAX) -> list[tuple[str, int]]:
    """Lists that a word enters: (gram, start) of its rarest grams, as many as needed, and
    the word without one of its parts (start below -1) where its bound covers all its grams.

    Parts are those of the shorter word of a pair, so a word enters the lists for its own
    length m and for one less; what stands right of the part is counted from the end."""
    grams = decompose(word, frequent, qmin, qmax)
    bound = affected(word, grams, frequent, qmin, qmax)
    order = sorted(grams, key=lambda g: (frequent.get(word[g[0]:g[1]], 0), word[g[0]:g[1]], g[0]))
    out = [(word[a:b], a) for a, b in order[:bound + 1]]
    if bound >= len(grams):
        for m in (len(word), len(word) - 1):
            for k in range(PARTS):
                lo, hi = m * k // PARTS, m * (k + 1) // PARTS
                out.append((f"{word[:lo]} {word[len(word) - m + hi:]}", -2 - m * PARTS - k))
    return out


def masks(word: str) -> tuple[int, int]:
    """Bit sets of a word's letters and of its letter pairs, hashed to 63 bits."""
    letters = pairs = 0
    last = 0
    for c in map(ord, word):
        letters |= 1 << c % 63
        pairs |= 1 << (last * 31 + c) % 63
        last = c
    return letters, pairs | 1 << last * 31 % 63


def near_pairs(words: DataFrame, qmin: int = QMIN, qmax: int = QMAX) -> DataFrame:
    """``a, an, b, bn``: each pair of near words once, with their counts."""
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast(frequent_grams(words, qmin, qmax))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 2000):
            if not b.num_rows:
                continue
            keys = [keys_of(w, shared.value, qmin, qmax) for w in b.column(0).to_pylist()]
            gram = pa.array([[g for g, _ in k] for k in keys], pa.list_(pa.string()))
            start = pa.array([[s for _, s in k] for k in keys], pa.list_(pa.int32()))
            letters, pairs = zip(*map(masks, b.column(0).to_pylist()), strict=True)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(letters), pa.array(pairs), gram, start],
                                  names=["word", "n", "letters", "pairs", "gram", "start"])

    lists = words.select("word", "n").mapInArrow(run, "word string, n long, letters long, pairs long, gram array<string>, start array<int>")
    lists = lists.select("word", "n", "letters", "pairs", F.length("word").alias("size"), F.explode(F.arrays_zip("gram", "start")).alias("k"))
    lists = store(lists.select("word", "n", "letters", "pairs", "size", "k.gram", "k.start"), "variant-lists")
    index = lists.select(F.col("word").alias("b"), F.col("n").alias("bn"), F.col("letters").alias("bl"), F.col("pairs").alias("bp"), "gram", "start", "size")
    # an equal length keeps places; in a word longer by one, they stay left of the edit and move by one right of it
    steps = F.when(F.col("start") < -1, F.array(*[F.struct(F.lit(d).alias("size"), F.lit(0).alias("start")) for d in (0, 1)])).otherwise(
        F.array(*[F.struct(F.lit(d).alias("size"), F.lit(s).alias("start")) for d, s in ((0, 0), (1, 0), (1, 1))]))
    probe = lists.select(F.col("word").alias("a"), F.col("n").alias("an"), "letters", "pairs", "gram", "start", "size", F.explode(steps).alias("d"))
    probe = probe.select("a", "an", "letters", "pairs", "gram", (F.col("start") + F.col("d.start")).alias("start"), (F.col("size") + F.col("d.size")).alias("size"),
                         (F.col("d.size") > 0).alias("longer"))
    alike = (F.bit_count(F.col("letters").bitwiseXOR(F.col("bl"))) <= 2) & (F.bit_count(F.col("pairs").bitwiseXOR(F.col("bp"))) <= 4)
    met = probe.join(index, ["gram", "start", "size"]).where(alike & (F.col("longer") | (F.col("a") < F.col("b"))))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "an", "b", "bn").distinct()


def variant_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_count: int = 5,
                   ratio: int = 5, alter: Alter | None = None) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each word of the vocabulary.

    ``alter`` maps an id (as the bytes ``<id>:``) and a run (Latin-1) to the word to count.
    ``ratio`` must be above 1, so that forms lead to ever more frequent words."""
    if ratio < 2 or min_length < 2 * QMIN:
        raise ValueError("ratio must be 2 or more, min_length 4 or more")
    words = store(count_words(docs, id_col, text_col, min_length, min_count, alter), "variant-words")
    pairs = store(near_pairs(words), "variant-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("an").alias("n"), F.col("b").alias("near"), F.col("bn").alias("near_n")).union(
        pairs.select("b", "bn", "a", "an"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("best"))
    out = words.join(best, "word", "left")
    has = -F.col("best.m") >= ratio * F.col("n")
    out = out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.w")).alias("form"),
                     F.when(has, -F.col("best.m")).alias("form_n"))
    out = store(out, "variant-forms")
    # pointer jumping over the words with a form; each round doubles the steps taken
    links = out.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        jump = links.join(links.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        jump = store(jump.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        links = jump.select("word", "root")
        if not jump.where("moved").limit(1).count():
            break
    return out.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def with_slips(prefix: bytes, word: bytes) -> bytes:
    """The word, for one (document, word) in 199 with a code point left out."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), zlib.crc32(prefix))
    if h % 199:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(read_table(spark, sf_dir, "documents"), alter=with_slips)
