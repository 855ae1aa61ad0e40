"""Scores of coordinates and transferred labels. Only sums and a few quantiles reach the driver."""
from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.arrays import lists, map_batches, matrix
from ..functions.ranks import exact_quantiles, with_rank
from .neighbours import check_k, kth_nearest


def error(residuals: DataFrame, column: str = "e") -> DataFrame:
    """(axis, err): half the 16th-84th percentile range per element of an array column, NaN ignored."""
    cells = residuals.select(F.posexplode(column).alias("axis", "v"))
    q = exact_quantiles(cells, "v", [0.16, 0.84], by="axis")
    return q.groupBy("axis").agg(((F.max("q") - F.min("q")) / 2).alias("err"))


def error_r2(truth: DataFrame, predicted: DataFrame, column: str = "y") -> DataFrame:
    """(axis, err, r2) of predicted against reference labels, both (star_id, y ARRAY<DOUBLE>)."""
    both = truth.select("star_id", F.col(column).alias("_y")).join(predicted.select("star_id", F.col(column).alias("_p")), "star_id")
    cells = both.select(F.posexplode(F.arrays_zip("_y", "_p")).alias("axis", "v"))
    cells = cells.select("axis", F.col("v._y").alias("y"), (F.col("v._p") - F.col("v._y")).alias("e"))
    sums = cells.groupBy("axis").agg((1 - F.try_divide(F.sum(F.col("e") * F.col("e")), F.var_pop("y") * F.count("y"))).alias("r2"))
    q = exact_quantiles(cells, "e", [0.16, 0.84], by="axis")
    return q.groupBy("axis").agg(((F.max("q") - F.min("q")) / 2).alias("err")).join(sums, "axis")


def terms(d: int, degree: int) -> list[tuple[int, ...]]:
    """The monomials of a polynomial basis: constant, coordinates, then products of two and of three."""
    return [t for k in range(degree + 1) for t in combinations_with_replacement(range(d), k)]


def design(coords: DataFrame, degree: int, column: str = "c") -> DataFrame:
    """(star_id, a): the polynomial basis of each star's coordinates."""
    d = len(coords.first()[column])
    def product(t):
        out = F.lit(1.0)
        for i in t:
            out = out * F.col(column)[i]
        return out
    return coords.select("star_id", F.array(*[product(t) for t in terms(d, degree)]).alias("a"))


def _moments(df: DataFrame, column: str, d: int) -> tuple[np.ndarray, np.ndarray]:
    row = df.agg(*[F.avg(F.col(column)[j]) for j in range(d)], *[F.stddev_pop(F.col(column)[j]) for j in range(d)]).first()
    return np.array(row[:d], float), np.array(row[d:], float)


def _fit(both: DataFrame, d: int, n_labels: int, degree: int, centre: np.ndarray, spread: np.ndarray):
    """Least squares of centred labels on the basis of standardised coordinates, from one pass of products."""
    basis = terms(d, degree)
    y_mean, _ = _moments(both, "y", n_labels)

    def stage(batch):
        z = (matrix(batch["c"], np.float64) - centre) / spread
        a = np.stack([np.prod(z[:, list(t)], axis=1) for t in basis], axis=1)
        full = np.concatenate([a, matrix(batch["y"], np.float64) - y_mean], axis=1)
        return {"g": lists((full.T @ full).reshape(1, -1))}

    parts = map_batches(both.select("c", "y"), stage, "g array<double>")
    rows = parts.select(F.posexplode("g").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
    size = len(basis) + n_labels
    gram = np.zeros(size * size)
    for r in rows:
        gram[r["at"]] = r["v"]
    gram = gram.reshape(size, size)
    p = len(basis)
    coef = np.linalg.lstsq(gram[:p, :p], gram[:p, p:], rcond=1e-13)[0]
    sse = np.diag(gram[p:, p:]) - 2 * (coef * gram[:p, p:]).sum(axis=0) + (coef * (gram[:p, :p] @ coef)).sum(axis=0)
    return coef, y_mean, 1 - sse / np.diag(gram[p:, p:])


def linear_probe_r2(coords: DataFrame, labels: DataFrame) -> np.ndarray:
    """R^2 of the best affine map from coordinates to each label, on the stars that have both."""
    both = coords.select("star_id", "c").join(labels.select("star_id", "y"), "star_id")
    head = both.first()
    d, n_labels = len(head["c"]), len(head["y"])
    mean, std = _moments(both, "c", d)
    return _fit(both, d, n_labels, 1, mean, np.where(std > 0, std, 1.0))[2]


def quadratic_map(coords: DataFrame, labels: DataFrame, degree: int = 2):
    """(mapped, r2, n_terms): the polynomial map from standardised coordinates to labels."""
    both = coords.select("star_id", "c").join(labels.select("star_id", "y"), "star_id")
    head = both.first()
    d, n_labels = len(head["c"]), len(head["y"])
    mean, std = _moments(both, "c", d)
    spread = std + 1e-12
    coef, y_mean, r2 = _fit(both, d, n_labels, degree, mean, spread)
    basis = terms(d, degree)

    def stage(batch):
        z = (matrix(batch["c"], np.float64) - mean) / spread
        a = np.stack([np.prod(z[:, list(t)], axis=1) for t in basis], axis=1)
        return {"star_id": batch["star_id"], "y": lists(a @ coef + y_mean)}

    return map_batches(both.select("star_id", "c"), stage, "star_id bigint, y array<double>"), [float(v) for v in r2], len(basis)


def repeat_separation(coords: DataFrame) -> DataFrame:
    """(pair, jitter): |c_a - c_b| / sqrt 2 of consecutive rows (in star_id order): two spectra of one star."""
    ranked = with_rank(coords.select("star_id", "c"), ["star_id"]).withColumn("pair", F.floor(F.col("rnk") / 2))
    two = ranked.groupBy("pair").agg(F.min_by("c", "rnk").alias("a"), F.max_by("c", "rnk").alias("b"), F.count(F.lit(1)).alias("n"))
    square = F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    return two.select("pair", (F.sqrt(square) / F.sqrt(F.lit(2.0))).alias("jitter"), "n")


def pair_jitter(coords: DataFrame, is_main: str = "is_main", is_pair: str = "is_pair") -> float:
    """Median separation of repeat spectra over the median distance to the 10th nearest main star."""
    repeats = repeat_separation(coords.where(F.col(is_pair)))
    if repeats.where("n <> 2").limit(1).count():
        raise ValueError("repeat spectra come in pairs")
    main = coords.where(F.col(is_main)).select("star_id", F.col("c").alias("vec"))
    total = main.count()
    check_k(10, total)
    tenth = kth_nearest(main, 10, len(main.first()["vec"]), total)
    jitter = exact_quantiles(repeats, "jitter", [0.5]).first()["q"]
    spacing = exact_quantiles(tenth, "dist", [0.5]).first()["q"]
    return float(jitter / spacing)


def oriented(coords: DataFrame, labels: DataFrame, axes: Sequence[tuple[int, int]] = ((0, 0), (1, 1))) -> DataFrame:
    """Flip coordinate axes so that each (coordinate, label) pair of `axes` correlates positively."""
    both = coords.join(labels.select("star_id", "y"), "star_id")
    corr = both.agg(*[F.corr(F.col("c")[i], F.col("y")[j]) for i, j in axes]).first()
    flip = {i for (i, _), r in zip(axes, corr) if r is not None and r < 0}
    d = len(coords.first()["c"])
    return coords.select("star_id", F.array(*[-F.col("c")[i] if i in flip else F.col("c")[i] for i in range(d)]).alias("c"))
