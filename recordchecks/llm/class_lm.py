"""Language-model scoring with Brown classes (operator 5).

1. Every word of every training text is counted (map-side partial counts, one
   sum by word).  The ``HEAD`` most frequent words with their counts fit in a
   broadcast of bounded size; the others stay in the table.
2. Texts are coded once: head words by number, the others by place in the text's
   list of them.
3. A first clustering has as units the ``TOP`` most frequent words, one bucket for
   each hash of another word's last three bytes, and the end of a text.  Unit
   bigrams are counted in one matrix a task (9 MB in memory, sent packed), summed in a
   tree of fan-in 64.
   Exchange clustering moves units between ``CLASSES`` classes, each to where
   the class-bigram likelihood of the corpus is largest, until a sweep moves none
   or ``SWEEPS`` are done.  The end of a text is a class of its own.  From there
   sweeps over the texts count the class contexts of every head word (19 MB a
   task) and move it to its best class, while the likelihood rises, ``ROUNDS`` at
   most.  Words outside the head get theirs in one such sweep in a table of any
   size.  Only words seen less than ``MIN_COUNT`` times, and not among the
   ``TOP``, are left to the buckets.
4. ``P(w_i | w_i-1) = P(c_i | c_i-1) P(w_i | c_i)``.  Transitions are smoothed with
   ``PRIOR`` counts of the class's share, emissions with one count for each
   known word of the class and one for all unknown ones.
5. The words outside the head meet their counts and classes in one join and return
   to their text, of which only a byte a token (its class) and the places of these words
   move; a map-side pass then scores whole class sequences.

Defined results: null text counts as empty and has the end token alone; a null
id is hashed as the text 'null'; repeated rows are scored one by one (and counted
one by one in training); without training texts every token is unknown; other
input columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from recordchecks.llm.common import blobs, crc32_mod, packed, read_table, small_batches, store, unpacked

HEAD, TOP, BUCKETS, CLASSES, SWEEPS, PRIOR = 60_000, 1_199, 336, 40, 20, 20.0
MIN_COUNT, ROUNDS = 5, 3
UNITS = 1 + TOP + BUCKETS  # unit 0: the end of a text
BLOCKS, FAN_IN, FLUSH_WORDS, FLUSH_CONTEXTS = 64, 64, 300_000, 3_000_000
END = b""  # no word is empty


def bucket_of(word: bytes) -> int:
    """Bucket of a word without a class of its own."""
    return zlib.crc32(word[-3:]) % BUCKETS


def count_words(texts: DataFrame) -> DataFrame:
    """``word, n`` over all tokens of the text column ``t``, ends included."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.record_batch({"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

        for b in small_batches(batches, 500):
            for t in blobs(b.column(0)):
                seen.update(t.lower().split())
            seen[END] += b.num_rows
            if len(seen) > FLUSH_WORDS:  # bounded memory
                yield rows()
                seen.clear()
        yield rows()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def encode(rows: DataFrame, head: dict[bytes, int]) -> DataFrame:
    """``row, id, held_out, codes, word, times, bucket`` of ``id, held_out, t``.  A code
    is a head index (0: the end, the last of each text) or -1 - the place in ``word``,
    the text's other distinct words."""
    shared = rows.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for b in small_batches(batches, 200):
            codes, tails = [], []
            for t in blobs(b.column(2)):
                line, tail = [], {}
                for w in t.lower().split():
                    code = words.get(w)
                    if code is None:
                        at = tail.setdefault(w, [-1 - len(tail), 0])
                        at[1] += 1
                        code = at[0]
                    line.append(code)
                line.append(0)
                codes.append(line)
                tails.append(tail)
            yield pa.record_batch([
                b.column(0), b.column(1), pa.array(codes, pa.list_(pa.int32())), pa.array([list(x) for x in tails], pa.list_(pa.binary())),
                pa.array([[n for _, n in x.values()] for x in tails], pa.list_(pa.int64())),
                pa.array([[bucket_of(w) for w in x] for x in tails], pa.list_(pa.int32()))],
                names=["id", "held_out", "codes", "word", "times", "bucket"])

    schema = StructType([rows.schema["id"], StructField("held_out", BooleanType()), StructField("codes", ArrayType(IntegerType())),
                         StructField("word", ArrayType(BinaryType())), StructField("times", ArrayType(LongType())),
                         StructField("bucket", ArrayType(IntegerType()))])
    # written, so that the row number is fixed before it is used twice
    return store(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "class-lm-coded")


def flat(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and the length of each list."""
    column = b.column(b.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def places(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of a batch of texts, which of them are no head words, and the places of these among all lists of words."""
    codes, n = flat(b, "codes")
    many = flat(b, "bucket")[1]
    tail = codes < 0
    return codes, tail, np.repeat(np.cumsum(many) - many, n)[tail] - 1 - codes[tail]


def tokens_of(b: pa.RecordBatch, head_row: np.ndarray, bucket_row: np.ndarray) -> np.ndarray:
    """What ``head_row`` and ``bucket_row`` hold for each token."""
    codes, tail, at = places(b)
    out = head_row[np.maximum(codes, 0)].astype(np.int64)
    out[tail] = bucket_row[flat(b, "bucket")[0][at]]
    return out


def before(tokens: np.ndarray) -> np.ndarray:
    """The token before each; before a text stands an end, number 0."""
    return np.r_[0, tokens[:-1]]


def count_keys(coded: DataFrame, numbers: int, keys: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """How often each number below ``numbers`` is among ``keys`` of all batches of texts.

    A task folds its counts and sends the numbers it met, packed; they are summed in a
    tree of fan-in ``FAN_IN``, so that no group grows with the number of tasks."""
    size = -(-numbers // BLOCKS)
    tasks = coded.select(F.spark_partition_id().alias("part")).agg(F.max("part")).first()[0] or 0

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        total = np.zeros(BLOCKS * size, np.float32)
        for b in small_batches(batches, 1000):
            if b.num_rows:
                np.add.at(total, keys(b), np.float32(1))
        part = TaskContext.get().partitionId()
        yield pa.record_batch({"block": pa.array(range(BLOCKS), pa.int32()), "part": pa.array([part] * BLOCKS, pa.int64()),
                               "counts": pa.array([packed(v) for v in total.reshape(BLOCKS, size)], pa.binary())})

    def add(key, table):
        counts = sum(unpacked(v, size) for v in table["counts"].to_pylist())
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()),
                         "counts": pa.array([packed(counts)], pa.binary())})

    schema = "block int, part long, counts binary"
    parts = coded.mapInArrow(fold, schema)
    while tasks:
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("block", "part").applyInArrow(add, schema)
        tasks //= FAN_IN
    out = np.zeros((BLOCKS, size))
    for r in parts.collect():  # BLOCKS rows
        out[r["block"]] += unpacked(r["counts"], size)
    return out.ravel()[:numbers]


def class_steps(between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the smoothed transitions of class pairs, and the tokens of each class."""
    mass = between.sum(axis=0)
    share = (mass + 1) / (mass.sum() + len(mass))
    return np.log((between + PRIOR * share) / (between.sum(axis=1, keepdims=True) + PRIOR)), mass


def gains(left: np.ndarray, right: np.ndarray, old: np.ndarray, step: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """(words, classes) log-likelihood of words with ``left`` and ``right`` class contexts; ``old``: their classes."""
    n = left.sum(axis=1)[:, None]
    gain = left @ step + right @ step.T - n * np.log(np.maximum(mass + n * (np.arange(len(mass)) != old[:, None]), 1))
    gain[:, 0] = -np.inf
    return gain


def refine(training: DataFrame, head_row: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all rows (head words, then buckets) and class pair counts: sweeps move
    each row to its best class by its class contexts in all texts, while the
    likelihood rises, ``ROUNDS`` at most."""
    classes, size = CLASSES, len(cls)
    head, best = size - BUCKETS, None
    for turn in range(ROUNDS + 1):
        def keys(b: pa.RecordBatch, cls: np.ndarray = cls) -> np.ndarray:
            at = tokens_of(b, head_row, head + np.arange(BUCKETS))
            prev = before(at)
            return np.r_[at * classes + cls[prev], size * classes + prev * classes + cls[at]]

        left, right = count_keys(training, 2 * size * classes, keys).reshape(2, size, classes)
        between = left.T @ np.eye(classes)[cls]
        likelihood = xlogx(between).sum() - 2 * xlogx(between.sum(axis=0)).sum()
        if best is not None and likelihood <= best[0] + 1e-6:
            break
        best = likelihood, cls, between
        if turn == ROUNDS:
            break
        step, mass = class_steps(between)
        gain = gains(left, right, cls, step, mass)
        new = np.argmax(gain, axis=1)
        rows = np.arange(size)
        move = (left.sum(axis=1) > 0) & (rows > 0)
        move[move] = gain[rows[move], new[move]] > gain[rows[move], cls[move]] + 1e-6
        if not move.any():
            break
        cls = np.where(move, new, cls)
    return best[1], best[2]


def tail_classes(training: DataFrame, head_class: np.ndarray, bucket_class: np.ndarray, between: np.ndarray) -> DataFrame:
    """``word, class`` of the words outside the head with ``MIN_COUNT`` or more: the best by their class contexts."""
    classes = CLASSES
    step, mass = class_steps(between)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[bytes, int] = {}
        seen: list[np.ndarray] = []

        def rows() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate([*seen, np.zeros(0, np.int64)]), return_counts=True)
            number, first = np.unique(key // (2 * classes), return_index=True)
            offsets = pa.array(np.r_[first, len(key)], pa.int32())
            words = pa.array(list(numbers), pa.binary()).take(pa.array(number))
            return pa.record_batch([words, pa.ListArray.from_arrays(offsets, pa.array(key % (2 * classes), pa.int32())),
                                    pa.ListArray.from_arrays(offsets, pa.array(n, pa.int32()))], names=["word", "code", "n"])

        held = 0
        for b in small_batches(batches, 1000):
            if not b.num_rows:
                continue
            _, tail, at = places(b)
            cls = tokens_of(b, head_class, bucket_class)
            where = np.nonzero(tail)[0]  # never a text's last token
            words = b.column(b.schema.get_field_index("word")).flatten().dictionary_encode()
            own = np.array([numbers.setdefault(w, len(numbers)) for w in words.dictionary.to_pylist()], np.int64)
            number = own[words.indices.to_numpy(zero_copy_only=False)[at]] if len(own) else np.zeros(0, np.int64)
            seen.append(np.r_[number * 2 * classes + before(cls)[where], (number * 2 + 1) * classes + cls[where + 1]])
            held += len(seen[-1])
            if held > FLUSH_CONTEXTS or len(numbers) > FLUSH_WORDS:  # bounded memory
                yield rows()
                seen, held = [], 0
                numbers.clear()
        yield rows()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 5000):
            code, many = flat(b, "code")
            seen = np.zeros((b.num_rows, 2 * classes))
            np.add.at(seen, (np.repeat(np.arange(b.num_rows), many), code), flat(b, "n")[0])
            best = gains(seen[:, :classes], seen[:, classes:], np.full(b.num_rows, -1), step, mass).argmax(axis=1)
            keep = seen[:, :classes].sum(axis=1) >= MIN_COUNT
            yield pa.record_batch([b.column(0), pa.array(best, pa.int32())], names=["word", "class"]).filter(pa.array(keep))

    # a row a task and word; a word has at most 2 * CLASSES numbers of each
    rows = training.mapInArrow(contexts, "word binary, code array<int>, n array<int>")
    rows = rows.groupBy("word").agg(F.flatten(F.collect_list("code")).alias("code"), F.flatten(F.collect_list("n")).alias("n"))
    return store(rows.mapInArrow(choose, "word binary, class int"), "class-lm-tail")


def xlogx(n: np.ndarray) -> np.ndarray:
    return n * np.log(np.maximum(n, 1e-300))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit; unit 0 alone in class 0, the others in classes 1 and up."""
    n = pairs.sum(axis=0)
    units = len(n)
    order = [int(u) for u in np.argsort(-n, kind="stable") if u]
    cls = np.zeros(units, np.int64)
    for rank, u in enumerate(order):
        cls[u] = 1 + rank % (classes - 1)
    member = np.eye(classes)[cls]
    between = member.T @ pairs @ member
    mass = member.T @ n
    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not n[u]:
                continue
            old = cls[u]
            out = np.bincount(cls, pairs[u], classes)
            into = np.bincount(cls, pairs[:, u], classes)
            own = pairs[u, u]
            out[old] -= own
            into[old] -= own
            # without u
            between[old] -= out
            between[:, old] -= into
            between[old, old] -= own
            mass[old] -= n[u]
            row, col = xlogx(between + out) - xlogx(between), xlogx(between.T + into) - xlogx(between.T)
            gain = row.sum(axis=1) - np.diag(row) + col.sum(axis=1) - np.diag(col)
            both = np.diag(between)
            gain += xlogx(both + out + into + own) - xlogx(both) - 2 * (xlogx(mass + n[u]) - xlogx(mass))
            gain[0] = -np.inf
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-6:
                new = int(old)
            moved += new != old
            cls[u] = new
            between[new] += out
            between[:, new] += into
            between[new, new] += own
            mass[new] += n[u]
        if not moved:
            break
    return cls


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), (crc32_mod(id_col, 7) == 2).alias("held_out"), F.col(text_col).cast("string").alias("t"))
    counts = store(count_words(rows.where(~F.col("held_out")).select("t")), "class-lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    frequent = counts.where(F.length("word") > 0).orderBy(F.desc("n"), "word").limit(HEAD).collect()  # HEAD rows at most
    head = {bytes(r["word"]): i for i, r in enumerate(frequent, 1)}  # 0: the end
    ends = counts.where(F.length("word") == 0).first()
    head_n = np.array([ends["n"] if ends else 0, *(r["n"] for r in frequent)], np.float64)
    buckets = np.array([bucket_of(w) for w in [END, *head]], np.int64)
    rank = np.arange(len(buckets))
    coded = encode(rows, head)
    training = coded.where(~F.col("held_out")).select("codes", "bucket", "word")
    top, units = min(TOP, len(head)), UNITS
    head_unit, bucket_unit = np.where(rank <= top, rank, 1 + top + buckets), 1 + top + np.arange(BUCKETS)

    def bigrams(b: pa.RecordBatch) -> np.ndarray:
        at = tokens_of(b, head_unit, bucket_unit)
        return before(at) * units + at

    unit_class = exchange(count_keys(training, units * units, bigrams).reshape(units, units))
    # the rows of the sweeps: head words of their own, then the buckets of the others
    head_row = np.where((rank <= top) | (head_n >= MIN_COUNT), rank, len(rank) + buckets)
    cls, between = refine(training, head_row, unit_class[np.r_[head_unit, bucket_unit]])
    head_class, bucket_class = cls[head_row], cls[len(rank):]
    known = counts.join(tail_classes(training, head_class, bucket_class, between), "word", "left")

    # words and tokens of each class: the head here, the others where they are
    def classes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for b in batches:
            c = [-1 if not w or w in words else int(bucket_class[bucket_of(w)]) if k is None else k
                 for w, k in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.record_batch([pa.array(c, pa.int32()), b.column(1)], names=["c", "n"])

    shared = spark.sparkContext.broadcast(head)
    class_n, class_v = np.bincount(head_class, head_n, CLASSES), np.bincount(head_class, head_n > 0, CLASSES)
    for r in known.select("word", "n", "class").mapInArrow(classes_of, "c int, n long").where("c >= 0").groupBy("c").agg(F.sum("n"), F.count(F.lit(1))).collect():
        class_n[r[0]] += r[1]
        class_v[r[0]] += r[2]

    # the other words of a text meet their counts and classes
    rest = coded.select("row", F.posexplode(F.arrays_zip("word", "times")).alias("pos", "z")).select("row", "pos", "z.word", F.col("z.times").cast("int").alias("times"))
    rest = rest.join(known, "word").groupBy("row").agg(
        F.sum("times").alias("rest_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rest_own"),
        F.collect_list(F.when(F.col("class").isNotNull(), F.struct("pos", F.col("class").cast("short").alias("class")))).alias("own"))
    log_n = np.log10(head_n + 1)

    # only a byte a token is moved to meet them, and the places of the other words
    def slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 1000):
            if not b.num_rows:
                continue
            codes, n = flat(b, "codes")
            is_head, at = codes >= 0, np.maximum(codes, 0)
            cls = tokens_of(b, head_class, bucket_class).astype(np.uint8).tobytes()
            first = np.cumsum(n) - n
            tails = np.add.reduceat(~is_head, first)
            where = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(tails)], pa.int32()), pa.array((np.arange(len(codes)) - np.repeat(first, n))[~is_head], pa.int32()))
            place = pa.ListArray.from_arrays(where.offsets, pa.array(-1 - codes[~is_head], pa.int32()))
            yield pa.record_batch([
                *(b.column(b.schema.get_field_index(c)) for c in ("row", "id", "held_out")), pa.array(n),
                pa.array(np.add.reduceat((is_head & (head_n[at] > 0)).astype(np.int64), first)), pa.array(np.add.reduceat(np.where(is_head, log_n[at], 0.0), first)),
                pa.array([cls[f:f + k] for f, k in zip(first, n, strict=True)], pa.binary()), where, place], names=slim_schema.names)

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 1000):
            out = []
            column = {c: b.column(b.schema.get_field_index(c)).to_pylist() for c in ("classes", "at", "place", "pos", "class")}
            for cls, at, place, pos, own in zip(*column.values(), strict=True):
                if pos:
                    cls = np.frombuffer(cls, np.uint8).copy()
                    of_place = np.full(max(max(place), max(pos)) + 1, -1)
                    of_place[pos] = own
                    mine = of_place[place]
                    cls[np.array(at)[mine >= 0]] = mine[mine >= 0]
                    cls = cls.tobytes()
                out.append(cls)
            yield pa.record_batch([*(b.column(b.schema.get_field_index(c)) for c in texts_schema.names[:-1]), pa.array(out, pa.binary())], names=texts_schema.names)

    slim_schema = StructType([StructField("row", LongType()), rows.schema["id"], StructField("held_out", BooleanType()), StructField("n_tokens", LongType()),
                              StructField("known", LongType()), StructField("own", DoubleType()), StructField("classes", BinaryType()),
                              StructField("at", ArrayType(IntegerType())), StructField("place", ArrayType(IntegerType()))])
    texts_schema = StructType([*slim_schema.fields[1:6], slim_schema["classes"]])
    none = F.array().cast("array<int>")
    texts = coded.select("row", "id", "held_out", "codes", "bucket").mapInArrow(slim, slim_schema).join(
        rest.select("row", "rest_known", "rest_own", F.col("own.pos").alias("pos"), F.col("own.class").cast("array<int>").alias("class")), "row", "left").select(
        "id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rest_known", F.lit(0))).cast("long").alias("known"),
        (F.col("own") + F.coalesce("rest_own", F.lit(0.0))).alias("own"), "classes", "at", "place", F.coalesce("pos", none).alias("pos"), F.coalesce("class", none).alias("class"))
    texts = store(texts.mapInArrow(filled, texts_schema), "class-lm-texts")
    classes = CLASSES

    def pairs_of(b: pa.RecordBatch) -> np.ndarray:
        """Class pair of each token of a batch."""
        c = np.frombuffer(b"".join(b.column(b.schema.get_field_index("classes")).to_pylist()), np.uint8).astype(np.int64)
        return before(c) * classes + c

    between = count_keys(texts.where(~F.col("held_out")), classes * classes, pairs_of).reshape(classes, classes)
    prior = (class_n + 1) / (class_n.sum() + CLASSES)
    # log10 of the transition and of the emission's denominator, by class pair
    chain = np.log10((between + PRIOR * prior) / (between.sum(axis=1, keepdims=True) + PRIOR)) - np.log10(class_n + class_v + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 1000):
            if b.num_rows:
                n = b.column(2).to_numpy(zero_copy_only=False)
                yield pa.record_batch([*b.columns[:5], pa.array(np.add.reduceat(chain.ravel()[pairs_of(b)], np.cumsum(n) - n))],
                                      names=["id", "held_out", "n_tokens", "known", "own", "chain"])

    schema = StructType([*texts_schema.fields[:5], StructField("chain", DoubleType())])
    return texts.mapInArrow(score, schema).select(
        F.col("id").alias(id_col), "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("own") - F.col("n_tokens") * float(np.log10(total + distinct + 1))).alias("base_score"), (F.col("own") + F.col("chain")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(read_table(spark, sf_dir, "documents"))
