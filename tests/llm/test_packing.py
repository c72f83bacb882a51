import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from recordchecks.llm import packing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_block(sizes):
    sizes = sorted(sizes, reverse=True)
    where, offset, lengths = packing.pack_block(sizes, (16, 32, 64), 2)
    for b, length in enumerate(lengths):
        inside = sorted((offset[i], sizes[i]) for i in range(len(sizes)) if where[i] == b)
        assert inside and inside[0][0] == 0
        assert all(a + n == c for (a, n), (c, _) in zip(inside, inside[1:], strict=False))
        used = sum(n for _, n in inside)
        assert length == min(x for x in (16, 32, 64) if x >= used)  # downsized


def test_best_fit_prefers_the_fullest():
    where, offset, lengths = packing.pack_block([60, 50, 10, 4], (64,), 0)
    assert where == [0, 1, 1, 0] and offset == [0, 0, 50, 60] and lengths == [64, 64]


def test_lone_small_piece_opens_a_small_bin():
    assert packing.pack_block([5], (16, 32, 64), 2)[2] == [16]
    assert packing.open_length(5, [], (16, 32, 64), 2) == 16
    assert packing.open_length(20, sorted([20] * 5), (32, 64), 4) == 64  # three fill it


def test_the_look_ahead_fills_a_bin_of_many_small_pieces():
    assert packing.open_length(100, [100] * 99, (512, 1024, 2048, 4096), 8) == 4096
    assert packing.pack_block([100] * 80)[2] == [4096, 4096]
    assert packing.open_length(7, sorted([7] * 20 + [3] * 37), (64, 256), 4) == 256  # 255 words of 256, or 63 of 64


def test_every_word_is_placed_once(make_docs, edge_rows):
    rows = edge_rows + [(None, "a b c", "b")] * 30 + [(400 + i, "w " * (i * 7 % 900), "s") for i in range(300)]
    got = packing.pack(make_docs(rows), lengths=(256, 512, 1024)).collect()
    want = {}
    for i, t, _ in rows:
        n = len((t or "").encode().split())
        if n:
            want.setdefault((i, n), []).append(n)
    words = {}
    for r in got:
        words.setdefault((r["doc_id"], r["copy"]), []).append((r["piece"], r["first_word"], r["n_words"]))
    totals = {}
    for (i, _), pieces in words.items():
        pieces.sort()
        # several rows of one id may have equal copy numbers if their sizes differ; sum by id
        totals[i] = totals.get(i, 0) + sum(n for _, _, n in pieces)
    assert totals == {i: sum(sum(v) for (j, _), v in want.items() if j == i) for i, _ in want}
    bins = {}
    for r in got:
        bins.setdefault(r["bin_id"], []).append((r["bin_offset"], r["n_words"], r["bin_length"], r["bin_used"]))
    for places in bins.values():
        places.sort()
        ends = np.cumsum([n for _, n, _, _ in places])
        assert [a for a, *_ in places] == [0, *ends[:-1]] and {u for *_, u in places} == {ends[-1]} and ends[-1] <= places[0][2]
    assert len({r["bin_length"] for r in got} - {256, 512, 1024}) == 0


def test_empty_table(make_docs):
    assert packing.pack(make_docs([])).collect() == [] and packing.pack(make_docs([(1, None, "s"), (2, " \n", "s")])).collect() == []
