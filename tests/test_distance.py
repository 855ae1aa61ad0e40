import numpy as np
import pytest
from brute import l1_table, lists_of, nearest_in

from specmap.operators import distance as dm, neighbours as nb, preprocess as pp
from specmap.sources.spectra import from_arrays


def test_features_reproduce_pixel_distances(spark, matrix):
    rng = np.random.default_rng(0)
    flux, good = 1 - 0.5 * rng.random((60, 40)), rng.random((60, 40)) > 0.05
    spectra = from_arrays(spark, flux, good)
    chunkings = [pp.segment_chunks([0] * 40, (n,)) for n in (2, 5)]
    features, info = dm.build_features(spectra, chunkings)
    phi = matrix(features, "phi").astype(float)
    pairs = spark.createDataFrame([(i, 59 - i) for i in range(30)], "i long, j long")
    total = np.zeros(30)
    for bounds, medians in zip(chunkings, ([r[-1] for r in info.of(i)] for i in range(len(chunkings)))):
        for row in dm.w1_pixel(spectra, bounds, pairs).collect():
            total[row["i"]] += row["w1"] / medians[row["chunk"]]
    assert np.allclose(np.abs(phi[:30] - phi[59:29:-1]).sum(axis=1), total, rtol=2e-4, atol=1e-4)
    assert info.length == phi.shape[1] == 80 and info.summary()["n_pairs_median"] == 60 * 59 // 2


def curve_by_loop(flux, good, bounds, weights=None):
    """Running sums of the depth over good pixels, over the whole sum of their chunk; zero where that is tiny."""
    depth = np.where(good, 1 - flux.astype(np.float32).astype(float), 0)
    if weights is not None:
        depth = depth * np.where(good, weights, 0)
    parts = []
    for a, b in bounds:
        run = np.cumsum(depth[:, a:b], axis=1)
        whole = run[:, -1:]
        parts.append(np.where(np.abs(whole) < 1e-3, 0, run / np.where(np.abs(whole) < 1e-3, 1, whole)))
    return np.concatenate(parts, axis=1)


def test_curves_equal_a_loop(spark, matrix):
    rng = np.random.default_rng(12)
    flux, good = rng.uniform(0.2, 1.2, (25, 18)), rng.random((25, 18)) > 0.25
    flux[3], good[4] = 1.0, False
    bounds = [(0, 7), (7, 18)]
    got = matrix(dm.cumulative_curves(from_arrays(spark, flux, good), [bounds]), "curve")
    assert np.allclose(got, curve_by_loop(flux, good, bounds), atol=1e-5)
    err = rng.uniform(0.01, 0.2, flux.shape)
    one, scaled = (matrix(dm.cumulative_curves(from_arrays(spark, flux, good, e), [bounds], True), "curve") for e in (err, 7 * err))
    assert np.allclose(one, scaled, atol=1e-5) and not np.allclose(one, got, atol=1e-3)


def test_medians_do_not_depend_on_blocks(spark, table):
    x = np.random.default_rng(2).normal(size=(200, 12))
    curves = table(x).withColumnRenamed("phi", "curve")
    bounds = [[(0, 5), (5, 12)]]
    want = [np.median(l1_table(x[:, a:b])[np.triu_indices(200, 1)]) for a, b in bounds[0]]
    for block in (512, 70):
        rows = dm.chunk_medians(curves, bounds, range(200), block).orderBy("chunk").collect()
        assert [r["median"] for r in rows] == want


@pytest.mark.parametrize("k", [4, 30])
def test_exact_search_with_copies_equals_brute_force(table, k):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(450, 3)) @ rng.normal(size=(3, 12))).astype(np.float32)
    x[100:250] = x[5]                                  # a third of the rows are copies of one
    x[300:303] = x[7]
    ids, dist = lists_of(nb.neighbours(table(x), k), k)
    want_ids, want = nearest_in(l1_table(x), k)
    assert np.array_equal(ids, want_ids) and np.array_equal(dist, want)


@pytest.mark.parametrize("rows, dims, k", [(2000, 20, 30), (1500, 8, 100), (1200, 32, 10)])
def test_descent_recall_and_distances(table, rows, dims, k):
    x = np.random.default_rng(k).normal(size=(rows, dims)).astype(np.float32)
    features = table(x)
    ids, dist = lists_of(nb.neighbours(features, k, "nndescent"), k)
    whole = l1_table(x)
    want, _ = nearest_in(whole, k)
    shared = np.mean([len(set(a) & set(b)) / k for a, b in zip(ids, want)])
    assert shared > 0.99
    assert np.array_equal(dist, np.take_along_axis(whole, ids, 1))


def test_invalid_searches(table):
    features = table(np.eye(4))
    for k in (0, -1, 4, 1.5):
        for search in ("exact", "nndescent"):
            with pytest.raises(ValueError, match="positive integer"):
                nb.neighbours(features, k, search)
    with pytest.raises(ValueError, match="unknown search"):
        nb.neighbours(features, 2, "ball")


def test_rescore_and_pairwise(spark, table):
    x = np.random.default_rng(4).normal(size=(30, 7)).astype(np.float32)
    want = l1_table(x)
    pairs = spark.createDataFrame([(i, (3 * i) % 30) for i in range(30)], "star_id long, nbr_id long")
    assert all(r["dist"] == want[r["star_id"], r["nbr_id"]] for r in dm.rescore(pairs, table(x)).collect())
    full = dm.pairwise(table(x), block=8).collect()
    assert len(full) == 900 and all(r["dist"] == want[r["star_id"], r["other_id"]] for r in full)


def test_landmark_query_measures_only_to_its_landmarks(spark, monkeypatch):
    from specmap.operators import distance
    from specmap.plans import catalogue

    def whole(*_, **__):
        raise AssertionError("all pairs")

    monkeypatch.setattr(distance, "pairwise", whole)
    path = "/root/testdata/sf0.001"
    rows = {r["vec_id"]: np.array(r["embedding"][:3], float) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()}
    got = {r["star_id"]: r["separation"] for r in catalogue.landmark_mds(spark, path).collect()}
    assert got.keys() == rows.keys()
    assert all(abs(got[i] - np.linalg.norm(x - rows[min(rows)])) < 2e-5 for i, x in rows.items())


def test_tables_made_by_blocks(spark, table):
    """Centred blocks are the centred table; wide rows are the table by groups of columns, whatever the ids."""
    x = np.random.default_rng(9).normal(size=(29, 5)).astype(np.float32)
    square = l1_table(x).astype(float) ** 2
    want = -0.5 * (square - square.mean(axis=0) - square.mean(axis=1)[:, None] + square.mean())
    got = dm.pairwise_centred(table(x), block=8).collect()
    assert len({(r["i"], r["j"]) for r in got}) == len(got) == 29 * 29
    assert all(abs(r["b"] - want[r["i"], r["j"]]) < 1e-9 for r in got)
    assert not dm.pairwise_centred(table(x).limit(0), block=8).collect()
    names = spark.createDataFrame([(i, 28 - i) for i in range(29)], "star_id long, ord long")
    rows = {(r["star_id"], r["part"]): r["d"] for r in dm.pairwise_rows(table(x), names, 10).collect()}
    assert {len(d) for (_, part), d in rows.items() if part < 2} == {10} and len(rows) == 3 * 29
    apart = np.linalg.norm(x[:, None].astype(float) - x[None].astype(float), axis=2)
    for i in range(29):
        np.testing.assert_allclose(sum((rows[i, part] for part in range(3)), []), apart[i, ::-1], atol=1e-6)


def test_scaling_queries_move_no_pairs(spark, monkeypatch):
    """The long table of all pairs is neither written nor joined on the way to the scaling queries."""
    from specmap.operators import coordinates, distance
    from specmap.plans import catalogue

    def long_table(*_, **__):
        raise AssertionError("long table")

    for module, name in ((distance, "pairwise"), (coordinates, "double_centre"), (coordinates, "classical_mds")):
        monkeypatch.setattr(module, name, long_table)
    path = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{path}/embeddings.parquet").count()
    assert catalogue.classical_mds(spark, path).count() == n and catalogue.mds_centering(spark, path).count() == n * n


def test_blocks_are_not_sent_through_the_driver(spark, table):
    full = dm.pairwise(table(np.random.default_rng(5).normal(size=(40, 6)).astype(np.float32)), block=8)
    assert full.count() == 1600
    full.collect()
    assert "Broadcast" not in full._jdf.queryExecution().executedPlan().toString()
