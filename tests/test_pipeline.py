import json

import numpy as np
import pytest

from specmap import Config, fit
from specmap.operators import evaluate as ev
from specmap.sources.spectra import from_arrays


def test_config_round_trip(tmp_path):
    config = Config(chunkings=((2, 2), (4, 4)), renorm_chunking=(2, 2), k_refine=7)
    config.save(tmp_path / "c.json")
    assert Config.load(tmp_path / "c.json") == config and config.k_prop_eff == 7
    with pytest.raises(ValueError, match="unknown configuration key"):
        Config.from_dict({"colour": 1})


def test_fit_end_to_end(spark, table, tmp_path):
    side = np.linspace(0, 1, 15)
    grid = np.array([(a, b) for a in side for b in side])
    pixels, rng, flux = np.arange(96), np.random.default_rng(0), np.ones((len(grid), 96))
    for line in range(24):
        depth = 0.15 + 0.12 * grid[:, line % 2]
        flux -= depth[:, None] * np.exp(-0.5 * ((pixels - (2 + 4 * line)) / 0.8) ** 2)
    flux += 0.001 * rng.normal(size=flux.shape)
    config = Config(chunkings=((3,), (6,)), d=2, k_lattice=10, k_refine=15, n_pca=6, n_landmarks=60)
    spectra, truth = from_arrays(spark, flux), table(grid, "y")
    out = fit(spectra, [0] * 96, config, log=None)
    assert out.C.count() == len(grid) and out.refine_residual.max() <= 1e-7
    assert set(out.timings) >= {"normalise", "features", "neighbours", "lattice", "geodesics", "mds", "refine", "total"}
    assert out.propagation_weights() is out.W
    labelled = truth.where("star_id % 7 = 0")
    r2 = [r["r2"] for r in ev.error_r2(truth, out.propagate(labelled)).collect()]
    assert min(r2) > 0.8
    with pytest.raises(ValueError, match="too few"):
        out.propagate(labelled, k_prop=40)
    with pytest.raises(ValueError):
        out.propagate(truth.selectExpr("star_id + 1000 AS star_id", "y"))
    out.save(str(tmp_path / "fit"))
    meta = {r["key"]: json.loads(r["json"]) for r in spark.read.parquet(str(tmp_path / "fit/meta")).collect()}
    assert Config.from_dict(meta["config"]) == config and spark.read.parquet(str(tmp_path / "fit/C")).count() == len(grid)


def test_fit_rejects_unknown_continuum(spark):
    with pytest.raises(ValueError, match="spline"):
        fit(from_arrays(spark, np.ones((4, 8))), [0] * 8, Config(continuum="spline"), log=None)
