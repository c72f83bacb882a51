"""Token counts by a map-side two-tier lookup (operator 2).

The unit of lookup is a white-space-free run of bytes.  The pre-tokenizers of
the supported library never join over ASCII white space, and Unicode
normalization never composes across it, so the token count of a text is the
sum of the counts of its runs.

Tier 1 is a broadcast table of the lengths of frequent runs, at most
``head_words`` entries whatever the corpus size.  It is filled from the runs of
a bounded sample (the first input split) and only saves work: a run that is
missing from it gets the same length from tier 2.  Tier 2 is a cache in each
Python worker, of ``cache_words`` entries at most, filled by encoding misses
with the library itself.  Nothing is shuffled.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows
are counted one by one; special strings inside a text are handled as the
library does by default; other input columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from recordchecks.llm.common import blobs, read_table, small_batches, worker_state


def _tokenizer(spec: str):
    """Tokenizer and cache of this Python worker, kept between tasks."""
    from tokenizers import Tokenizer
    state = worker_state()
    if state.get("token_spec") != spec:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        state.update(token_spec=spec, tokenizer=Tokenizer.from_str(spec), token_lengths={})
    return state["tokenizer"], state["token_lengths"]


def lengths(tok, runs: list[bytes]) -> list[int]:
    """Token counts of runs, by the library."""
    encode = getattr(tok, "encode_batch_fast", tok.encode_batch)
    return [len(e.ids) for e in encode([r.decode("utf-8") for r in runs], add_special_tokens=False)]


def frequent_runs(docs: DataFrame, text_col: str, n: int) -> list[bytes]:
    """Up to ``n`` frequent runs of the first input split that has any."""
    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in small_batches(batches, 500):
            seen.update(chain.from_iterable(t.split() for t in blobs(b.column(0))))
            if len(seen) > 20 * n:  # bounded memory: forget the rare half
                seen = Counter(dict(seen.most_common(10 * n)))
        yield pa.record_batch({"run": pa.array([r for r, _ in seen.most_common(n)], pa.binary())})

    rows = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(top, "run binary").take(n)
    return [bytes(r[0]) for r in rows]


def token_counts(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048,
                 head_words: int = 50_000, cache_words: int = 400_000) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` per row.

    ``spec``: the text of a tokenizer file of the ``tokenizers`` library; it
    travels by broadcast, so executors need no file.  ``limit``: the token
    count above which ``over_limit`` is true.
    """
    from tokenizers import Tokenizer
    spark = docs.sparkSession
    head_runs = frequent_runs(docs, text_col, head_words)
    head = dict(zip(head_runs, lengths(Tokenizer.from_str(spec), head_runs), strict=True)) if head_runs else {}
    shared = spark.sparkContext.broadcast((spec, head))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec_, head_ = shared.value
        tok, cache = _tokenizer(spec_)
        for b in small_batches(batches, 500):
            texts = blobs(b.column(1))
            split = [t.split() for t in texts]
            missing = [r for r in set(chain.from_iterable(split)).difference(cache) if r not in head_]
            if len(cache) + len(missing) > cache_words:
                cache.clear()
                missing = [r for r in set(chain.from_iterable(split)) if r not in head_]
            for i in range(0, len(missing), 10_000):
                part = missing[i:i + 10_000]
                cache.update(zip(part, lengths(tok, part), strict=True))
            n = [sum([head_[r] if r in head_ else cache[r] for r in runs]) for runs in split]
            yield pa.record_batch([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64())],
                                  names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    schema = StructType([rows.schema["id"], StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])
    return rows.mapInArrow(count, schema).select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    import public_tokenizers
    with open(public_tokenizers.path(tokenizer), encoding="utf-8") as f:
        spec = f.read()
    return token_counts(read_table(spark, sf_dir, "documents"), spec)
