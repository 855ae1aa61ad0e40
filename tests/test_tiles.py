"""What tasks on pairs of blocks are sent does not grow with the number of pairs."""
import numpy as np
import pytest

from specmap.functions import blocks
from specmap.operators import coordinates as co, distance as dm, geodesics as geo, neighbours as nb


@pytest.fixture
def dealt(spark, monkeypatch):
    """The tables that exact searches deal to their tasks."""
    seen, sort = [], type(spark.range(0)).sortWithinPartitions

    def spied(self, *columns, **more):
        if "lb" in columns:
            seen.append(self)
        return sort(self, *columns, **more)

    monkeypatch.setattr(type(spark.range(0)), "sortWithinPartitions", spied)
    return seen


@pytest.mark.parametrize("held", [1 << 26, 70_000])
def test_a_block_is_sent_once_to_a_group(table, dealt, monkeypatch, held):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 40)
    monkeypatch.setattr(nb, "HELD_BYTES", held, raising=False)
    pairs, made = [], nb._block_pairs
    monkeypatch.setattr(nb, "_block_pairs", lambda *a: pairs.append(made(*a)) or pairs[-1])
    x = np.random.default_rng(2).normal(size=(2600, 9)).astype(np.float32)       # 41 blocks or more, few pairs excluded
    found = nb.neighbours(table(x), 3).collect()
    apart = np.abs(x[:, None, :].astype(np.float64) - x[None]).sum(axis=2)
    np.fill_diagonal(apart, np.inf)
    assert len(found) == 3 * len(x)
    want = np.sort(apart, axis=1)
    assert all(abs(r["dist"] - want[r["star_id"], r["rank"] - 1]) < 1e-5 and abs(apart[r["star_id"], r["nbr_id"]] - r["dist"]) < 1e-5 for r in found)
    sent, all_pairs = dealt[0].count(), pairs[0].count()
    assert sent < (0.3 if held > 70_000 else 0.8) * all_pairs                      # one for each pair before


def test_a_small_side_is_one_group_or_few(spark, table, dealt, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 40)
    x = np.random.default_rng(3).normal(size=(2000, 5)).astype(np.float32)
    few = np.random.default_rng(4).normal(size=(30, 5)).astype(np.float32)
    vectors = table(x, "vec", None).selectExpr("star_id", "cast(vec as array<float>) vec")
    asked = table(few, "vec", None).selectExpr("star_id + 5000 star_id", "cast(vec as array<float>) vec")
    found = {r["star_id"] - 5000: r for r in nb.nearest(asked, vectors, 1).collect()}
    apart = np.abs(few[:, None, :].astype(np.float64) - x[None]).sum(axis=2)
    assert all(found[i]["nbr_id"] == apart[i].argmin() and abs(found[i]["dist"] - apart[i].min()) < 1e-5 for i in range(30))


def test_paths_are_relaxed_in_bounded_memory():
    import tracemalloc
    rng = np.random.default_rng(5)
    n, edges, marks = 500, 60_000, 128
    into, target = rng.integers(0, n, (2, edges))
    target.sort()
    weight = rng.random(edges)
    dist = np.full((n, marks), np.inf)
    dist[rng.integers(0, n, marks), np.arange(marks)] = 0.0
    want, before = dist.copy(), np.zeros(0)
    while not np.array_equal(want, before):                                       # rounds of all edges
        before = want.copy()
        np.minimum.at(want, target, before[into] + weight[:, None])
    tracemalloc.start()
    geo._relax(dist, np.isfinite(dist), target, into, weight)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(dist, want) and most < 96 << 20                         # all landmarks at once: 120 MB


def test_offers_to_one_star_are_merged(spark, monkeypatch):
    monkeypatch.setattr(geo, "MERGE_ROWS", 5)
    rows = [(b, 0, [7, 9, 7], [0, 0, 2], [float(5 + s), 2.0 * s, 1.0]) for b in (0, 1) for s in range(6)]
    news = spark.createDataFrame(rows, "block long, part int, stars array<long>, cols array<int>, ds array<double>")
    got = {r["block"]: sorted(zip(r["stars"], r["cols"], r["ds"])) for r in geo._merged(news, 3).collect()}
    assert got == {b: [(7, 0, 5.0), (7, 2, 1.0), (9, 0, 0.0)] for b in (0, 1)}
    star = np.array([3, 3, 3, 5, 5, 8])                                           # blocks of stars, by their edges
    first, ends = np.array([0, 2, 4, 10, 11, 12]), np.array([2, 4, 10, 11, 12, 20])
    assert list(geo._pieces(star, first, ends, 4)) == [(0, 2), (2, 3), (3, 5), (5, 6)]


def test_blocks_of_all_pairs_are_sent_once_to_a_group(spark, table, monkeypatch):
    sent, deal = [], type(spark.range(0)).repartition
    monkeypatch.setattr(type(spark.range(0)), "repartition", lambda self, *a: sent.append(self) or deal(self, *a))
    x = np.random.default_rng(6).normal(size=(400, 3)).astype(np.float32)
    full = dm.pairwise(table(x), block=8)
    rows = [df.count() for df in sent]
    want = np.abs(x[:, None, :].astype(np.float64) - x[None]).sum(axis=2)
    got = full.collect()
    assert len({(r["star_id"], r["other_id"]) for r in got}) == len(got) == 400 * 400
    assert all(abs(r["dist"] - want[r["star_id"], r["other_id"]]) < 1e-5 for r in got)
    assert sum(rows) < 50 * 20                                                    # 50 blocks beside 50: 2,550 before


def test_scaling_of_all_points_writes_no_distances(spark, table, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 3)) * [3.0, 2.0, 1.0]
    names = spark.createDataFrame([(i, (7 * i) % 300) for i in range(300)], "star_id long, ord long")
    written, write = [], co.cut
    monkeypatch.setattr(co, "cut", lambda df: written.append(df) or write(df))
    for limit in (1000, 100):                                                     # on the driver, by subspace iteration
        written.clear()
        again = dm.pairwise_rows(table(x, "c"), names, 32, column="c", again=True)
        coords, values = co.landmark_mds(again, names, 3, group=32, limit=limit)
        got = np.array([r["c"] for r in coords.orderBy("star_id").collect()])
        apart = lambda p: np.linalg.norm(p[:, None] - p[None], axis=2)
        assert np.abs(apart(got) - apart(x)).max() < 1e-5
        assert limit == 1000 or not any("d" in df.columns for df in written)
    long = dm.pairwise_rows(table(x, "c"), names, 32, column="c")
    assert np.allclose(co.landmark_mds(long, names, 3, group=32, limit=100)[1][:3], values[:3])


def test_the_best_pairs_of_every_star():
    star, other = np.array([4, 4, 4, 4, 2, 2]), np.array([9, 1, 9, 3, 5, 6])
    dist = np.array([2.0, 1.0, 2.0, 1.0, 7.0, 0.5], np.float32)
    got = nb._best_pairs(star, other, dist, 2)
    assert [c.tolist() for c in got] == [[2, 2, 4, 4], [6, 5, 1, 3], [0.5, 7.0, 1.0, 1.0]]
    assert all(len(c) == 0 for c in nb._best_pairs(star[:0], other[:0], dist[:0], 2))


def test_a_vector_is_sent_to_a_cell_once(spark, table, monkeypatch):
    monkeypatch.setattr(nb, "TESTED_ROWS", 500, raising=False)
    sent, sort = [], type(spark.range(0)).sortWithinPartitions
    monkeypatch.setattr(type(spark.range(0)), "sortWithinPartitions", lambda self, *a, **b: sent.append(self) or sort(self, *a, **b))
    x = np.random.default_rng(9).normal(size=(700, 6)).astype(np.float32)
    found = nb.neighbours(table(x), 5, "nndescent").collect()
    apart = np.abs(x[:, None, :].astype(np.float64) - x[None]).sum(axis=2)
    np.fill_diagonal(apart, np.inf)
    right = {(i, j) for i, row in enumerate(np.argsort(apart, axis=1)[:, :5]) for j in row}
    assert len(found) == 5 * 700 and sum((r["star_id"], r["nbr_id"]) in right for r in found) > 0.99 * 3500
    rounds = [df for df in sent if {"kth", "vec"} <= set(df.columns)]
    assert rounds and rounds[0].where("vec is not null").count() < 30 * 700       # about 71 a star before


def test_a_star_that_comes_twice_sits_in_a_group_twice(spark, table, monkeypatch):
    """Its own copy is then one of its neighbours, at distance 0, and nobody else's pairs are counted twice."""
    x = np.random.default_rng(10).normal(size=(12, 4)).astype(np.float32)
    once = table(x, "vec", None).selectExpr("star_id", "cast(vec as array<float>) vec")
    lists_ = spark.createDataFrame([(i, (i + s) % 12, 99.0, 1) for i in range(12) for s in (1, 2, 3)], "star_id long, nbr_id long, dist double, fresh int")
    cells = spark.createDataFrame([(i, i // 6) for i in range(12)], "star_id long, cell long")
    got = nb._local_join(lists_, once.unionByName(once.where("star_id = 5")), cells, 2, 3, 0).collect()
    assert {r["star_id"] for r in got if r["star_id"] == r["nbr_id"]} == {5}
