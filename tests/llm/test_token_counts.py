import pytest

from recordchecks.llm import token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def spec():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def expected(spec, texts):
    from tokenizers import Tokenizer
    return [len(e.ids) for e in Tokenizer.from_str(spec).encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_librarys(make_docs, edge_rows, spec):
    texts = ["a<|endoftext|>b <|startoftext|>", "it's we'll 123 --- ###", "é ́x Å", "İstanbul ΣΣ \x85 \x1c z"]
    rows = edge_rows + [(100 + i, t, "s") for i, t in enumerate(texts)]
    got = token_counts.token_counts(make_docs(rows), spec, limit=3).collect()
    want = expected(spec, [t or "" for _, t, _ in rows])
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == sorted(
        (i or -1, len((t or "").encode()), n, n > 3) for (i, t, _), n in zip(rows, want, strict=True))


def test_small_tiers_give_the_same(make_docs, edge_rows, spec):
    docs = make_docs(edge_rows)
    whole = token_counts.token_counts(docs, spec)
    tiny = token_counts.token_counts(docs, spec, head_words=2, cache_words=10)
    assert sorted(map(str, whole.collect())) == sorted(map(str, tiny.collect()))


def test_empty_table(make_docs, spec):
    assert token_counts.token_counts(make_docs([]), spec).collect() == []
