"""Blocks of any size are compared in bounded memory, with the result of the whole table of distances."""
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from specmap.functions import blocks, kernels
from specmap.sources import views


def whole(a, a_ids, b, b_ids, k, metric):
    d = kernels.METRICS[metric][0](a, b).astype(np.float64)
    d[a_ids[:, None] == b_ids[None, :]] = np.inf
    return kernels.merge_top(np.full((len(a), k), np.inf), np.full((len(a), k), -1), d, b_ids, k)


def folded(a, a_ids, b, b_ids, k, metric, limit=None):
    lists = np.full((len(a), k), np.inf), np.full((len(a), k), -1)
    kernels.fold_nearest(*lists, a, a_ids, b, b_ids, k, metric, limit)
    return lists


def peak(run):
    tracemalloc.start()
    run()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


@pytest.mark.parametrize("metric", ["l1", "l2"])
@pytest.mark.parametrize("kind", ["uniform", "copies", "constant", "far", "one column", "huge", "nan"])
def test_tiles_equal_the_whole_table(kind, metric, monkeypatch):
    monkeypatch.setattr(kernels, "TILE", (16, 50))
    rng = np.random.default_rng(3)
    x = rng.random((230, 1 if kind == "one column" else 7)).astype(kernels.METRICS[metric][1])
    x = {"copies": x[rng.integers(0, 9, 230)], "constant": np.ones_like(x), "far": x + 1e6 * (np.arange(230) % 2)[:, None].astype(x.dtype),
         "huge": x * np.logspace(-8, 8, x.shape[1]).astype(x.dtype)}.get(kind, x)
    if kind == "nan":
        x[5, 0] = np.nan
    ids = rng.permutation(230)
    for a, b in ((slice(0, 230), slice(0, 230)), (slice(0, 40), slice(60, 230)), (slice(0, 100), slice(50, 53))):
        for k in (1, 4, 20):
            want = whole(x[a], ids[a], x[b], ids[b], k, metric)
            for limit in (None, np.where(np.isfinite(want[0][:, -1]), want[0][:, -1], np.inf)):
                got = folded(x[a], ids[a], x[b], ids[b], k, metric, limit)
                assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])


def test_memory_of_a_block_does_not_grow_with_its_rows():
    assert blocks.block_rows(10 ** 8, 26, 64, 12) <= blocks.BLOCK_ROWS
    x = np.random.default_rng(1).random((4096, 4), np.float32)
    ids = np.arange(4096)
    assert peak(lambda: folded(x, ids, x, ids, 3, "l1")) < 16 << 20          # the whole table has 128 MB


def test_letters_are_counted_piece_by_piece(monkeypatch):
    texts = ["abcA" * 3, None, "", "z" * 100, "héllo", "", "x", None]
    want = [[(t or "").lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]
    for size in (1, 3, 7, 1 << 20):
        monkeypatch.setattr(views, "TEXT_BYTES", size)
        assert views.letter_counts(pa.array(texts)).tolist() == want
        assert views.letter_counts(pa.array(["qq", *texts, "rr"]).slice(1, 8)).tolist() == want
        assert views.letter_counts(pa.array([], pa.string())).shape == (0, 26)
    monkeypatch.undo()
    long = pa.array(["abc def " * 1_000_000] * 2)
    assert peak(lambda: views.letter_counts(long)) < 64 << 20                # at once, 16 MB of text took 366 MB


@pytest.mark.parametrize("columns", [16, 19, 70])
def test_sums_of_columns_spare_most_of_the_work(columns, monkeypatch):
    rng = np.random.default_rng(columns)
    x = rng.random((6, columns)).cumsum(axis=1)[rng.integers(0, 6, 900)]                 # smooth curves around six others
    x = (x + 0.02 * rng.random((900, columns)).cumsum(axis=1)).astype(np.float32)
    x[::9] = x[4]                                                                        # some of them copies
    ids, k = rng.permutation(900), 5
    want = whole(x, ids, x, ids, k, "l1")
    numbers, apart = [], kernels._Levels.apart
    monkeypatch.setattr(kernels, "TILE", (64, 256))
    monkeypatch.setattr(kernels._Levels, "apart", lambda self, rows, cols: numbers.append(
        self.a.shape[1] * (rows.stop - rows.start) * (cols.stop - cols.start)) or apart(self, rows, cols))
    for limit in (None, want[0][:, -1]):
        numbers.clear()
        got = folded(x, ids, x, ids, k, "l1", limit)
        assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])
    assert sum(numbers) < 0.5 * columns * 900 * 900                                      # all columns of all pairs before


def test_pairs_have_the_bits_of_the_table():
    x = np.random.default_rng(0).normal(size=(600, 193)).astype(np.float32) * np.logspace(-3, 3, 193, dtype=np.float32)
    table = kernels.l1_cross(x, x)
    for n in (0, 1, 2, 7, 255, 256, 257, 513):
        row, col = np.random.default_rng(n).integers(0, 600, (2, n))
        assert np.array_equal(kernels.l1_picked(x, x, row, col), table[row, col])
        assert np.array_equal(kernels.l1_matched(x[row], x[col]), table[row, col])
    assert kernels.l1_matched(x[:3, :0], x[:3, :0]).tolist() == [0, 0, 0]
