"""The normalised flux: every profile divided by a locally fitted continuum.

All per-star work is narrow (one Arrow stage over the scan, no shuffle); only the per-pixel statistics over the
sample are aggregated, first per batch inside the task and then across tasks, so what is shuffled is one row per
pixel and batch.
"""
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.arrays import lists, map_batches, matrix
from ..session import cut

Bounds = list[tuple[int, int]]

# Fixed values of the method.
MIN_GOOD_KNOT = 10      # a running-continuum knot needs at least this many good pixels
MIN_GOOD_LINE = 10      # the local line uses the quantile only with more good pixels than this
LINE_RIDGE = 1e-6


def segment_chunks(segments: Sequence[int], per_segment: Sequence[int]) -> Bounds:
    """Half-open pixel ranges: per_segment[s] chunks of equal width in every detector segment s."""
    segments = np.asarray(segments)
    if segments.size and segments.max() >= len(per_segment):
        raise ValueError(f"pixels lie in segments up to {segments.max()} but {len(per_segment)} chunk count(s) "
                         "were given: give one count per segment")
    bounds: Bounds = []
    for segment, count in enumerate(per_segment):
        where = np.flatnonzero(segments == segment)
        if not where.size:
            raise ValueError(f"segment {segment} has no pixels")
        edges = np.linspace(where[0], where[-1] + 1, count + 1).astype(int).tolist()
        bounds.extend(zip(edges[:-1], edges[1:]))
    return bounds


def _row_quantile(values: np.ndarray, use: np.ndarray, q: float) -> np.ndarray:
    """Linearly interpolated quantile of the used entries of every row (garbage where a row has none)."""
    ordered = np.sort(np.where(use, values, np.inf), axis=1)
    last = np.maximum(use.sum(axis=1) - 1, 0)
    pos = q * last
    low = np.floor(pos).astype(int)
    rows = np.arange(len(values))
    a, b = ordered[rows, low], ordered[rows, np.minimum(low + 1, last)]
    with np.errstate(invalid="ignore"):
        return np.where(pos > low, a + (b - a) * (pos - low), a)


def _running_knots(a: int, b: int, half: int, step: int) -> np.ndarray:
    knots = np.arange(a + half // 2, b - half // 2, step)
    return knots if len(knots) >= 2 else np.array([a, b - 1])


def _running_level(flux: np.ndarray, good: np.ndarray, segments: np.ndarray, window: int, q: float,
                   step: int | None) -> np.ndarray:
    """The continuum of every row: quantiles at the knots, straight lines between them, NaN where unusable."""
    half, step = window // 2, step or max(window // 4, 8)
    level = np.ones(flux.shape)
    for segment in np.unique(segments):
        where = np.flatnonzero(segments == segment)
        a, b = int(where[0]), int(where[-1]) + 1
        knots = _running_knots(a, b, half, step)
        at_knot = np.full((len(flux), len(knots)), np.nan)
        for column, knot in enumerate(knots):
            span = slice(max(a, knot - half), min(b, knot + half))
            use = good[:, span]
            value = _row_quantile(flux[:, span], use, q)
            usable = (use.sum(axis=1) >= MIN_GOOD_KNOT) & np.isfinite(value) & (value > 0)
            at_knot[usable, column] = value[usable]
        pixels = np.arange(a, b, dtype=float)
        for row, values in enumerate(at_knot):
            known = np.isfinite(values)
            level[row, a:b] = np.interp(pixels, knots[known], values[known]) if known.any() else np.nan
    return np.where(np.isfinite(level) & (level > 0), level, np.nan)


def running_continuum(spectra: DataFrame, segments: Sequence[int], window_px: int = 300, q: float = 0.90,
                      step: int | None = None) -> DataFrame:
    """(star_id, flux, continuum): each profile over its running upper quantile, per detector segment."""
    axis = np.asarray(segments)

    def stage(batch):
        flux, good = matrix(batch["flux"], np.float64), matrix(batch["good"], bool)
        level = _running_level(flux, good, axis, window_px, q, step)
        return {"star_id": batch["star_id"], "flux": lists(flux / level), "continuum": lists(level)}

    return map_batches(spectra.select("star_id", "flux", "good"), stage,
                       "star_id bigint, flux array<double>, continuum array<double>")


def pixel_cover(spectra: DataFrame) -> DataFrame:
    """(pix, cover): the fraction of stars in which each pixel is good."""
    def stage(batch):
        good = matrix(batch["good"], bool)
        return {"n": [len(good)], "cnt": lists(good.sum(axis=0, dtype=np.int64)[None, :])}

    partial = map_batches(spectra.select("good"), stage, "n bigint, cnt array<bigint>")
    return (partial.select("n", F.posexplode("cnt").alias("pix", "cnt")).groupBy("pix")
            .agg((F.sum("cnt") / F.sum("n")).alias("cover")))


def prepare(spectra: DataFrame, segments: Sequence[int], window_px: int = 100, q: float = 0.90,
            min_cover: float = 0.9, lo: float = 0.0, hi: float = 1.5):
    """Spectra with their instrumental response to a clean common grid.

    Returns (spectra, segments, common): bad flux and errors set to one, the segments of the kept pixels, and the
    mask of kept pixels. Only the per-pixel cover (one number per pixel) is collected.
    """
    axis = np.asarray(segments)

    def normalise(batch):
        flux, good = matrix(batch["flux"], np.float64), matrix(batch["good"], bool)
        level = _running_level(flux, good, axis, window_px, q, None)
        with np.errstate(invalid="ignore", divide="ignore"):
            ratio = flux / level
            ok = good & np.isfinite(ratio) & (ratio > lo) & (ratio < hi)
            err = matrix(batch["err"], np.float64) / np.where(np.isfinite(level), level, 1.0)
        return {"star_id": batch["star_id"], "flux": lists(np.where(ok, ratio, 1.0).astype(np.float32)),
                "good": lists(ok), "err": lists(np.where(ok, err, 1.0).astype(np.float32))}

    clean = cut(map_batches(spectra.select("star_id", "flux", "good", "err"), normalise,
                            "star_id bigint, flux array<float>, good array<boolean>, err array<float>"))
    cover = {r["pix"]: r["cover"] for r in pixel_cover(clean).collect()}       # one row per pixel of the axis
    common = np.array([cover.get(p, 0.0) > min_cover for p in range(len(axis))])
    return select_pixels(clean, common), axis[common].tolist(), common


def select_pixels(spectra: DataFrame, mask: np.ndarray) -> DataFrame:
    """Keep the pixels of `mask` in every array."""
    if mask.all():
        return spectra

    def stage(batch):
        return {"star_id": batch["star_id"], "flux": lists(matrix(batch["flux"], np.float32)[:, mask]),
                "good": lists(matrix(batch["good"], bool)[:, mask]),
                "err": lists(matrix(batch["err"], np.float32)[:, mask])}

    return map_batches(spectra, stage, "star_id bigint, flux array<float>, good array<boolean>, err array<float>")


def _local_line(flux: np.ndarray, good: np.ndarray, q: float, floor: float) -> np.ndarray:
    """The straight continuum of one chunk for every row, by the closed form of the 2 x 2 ridge system."""
    x = np.linspace(-1, 1, flux.shape[1])
    threshold = np.where(good.sum(axis=1) > MIN_GOOD_LINE, _row_quantile(flux, good, q), -np.inf)
    with np.errstate(invalid="ignore"):
        use = good & (flux >= threshold[:, None])
    weight, value = use.astype(float), np.where(use, flux, 0.0)
    s0, s1, s2 = weight.sum(axis=1) + LINE_RIDGE, weight @ x, weight @ (x * x) + LINE_RIDGE
    t0, t1 = value.sum(axis=1), value @ x
    det = s0 * s2 - s1 * s1
    level, slope = (s2 * t0 - s1 * t1) / det, (s0 * t1 - s1 * t0) / det
    return np.maximum(level[:, None] + slope[:, None] * x, floor)


def local_renormalise(spectra: DataFrame, bounds: Bounds, q: float = 0.85, floor: float = 0.2) -> DataFrame:
    """Divide flux and error by a line through the upper-quantile good pixels of every chunk."""
    def stage(batch):
        flux, good = matrix(batch["flux"], np.float64), matrix(batch["good"], bool)
        err = matrix(batch["err"], np.float64)
        out, out_err = flux.copy(), err.copy()
        with np.errstate(invalid="ignore"):
            for a, b in bounds:
                line = _local_line(flux[:, a:b], good[:, a:b], q, floor)
                out[:, a:b] /= line
                out_err[:, a:b] /= line
        return {"star_id": batch["star_id"], "flux": lists(out.astype(np.float32)), "good": batch["good"],
                "err": lists(out_err.astype(np.float32))}

    return map_batches(spectra.select("star_id", "flux", "good", "err"), stage,
                       "star_id bigint, flux array<float>, good array<boolean>, err array<float>")


def pixel_means(spectra: DataFrame) -> DataFrame:
    """(pix, mean): the mean good flux of each pixel over the sample, one where no star has it good."""
    def stage(batch):
        flux, good = matrix(batch["flux"], np.float64), matrix(batch["good"], bool)
        return {"cnt": lists(good.sum(axis=0, dtype=np.int64)[None, :]),
                "total": lists(np.where(good, flux, 0.0).sum(axis=0)[None, :])}

    partial = map_batches(spectra.select("flux", "good"), stage, "cnt array<bigint>, total array<double>")
    cell = F.posexplode(F.arrays_zip("cnt", "total")).alias("pix", "c")
    mean = F.try_divide(F.sum("c.total"), F.sum("c.cnt").cast("double"))
    return partial.select(cell).groupBy("pix").agg(F.coalesce(mean, F.lit(1.0)).cast("float").alias("mean"))


def fill_bad(spectra: DataFrame, means: np.ndarray | None = None) -> DataFrame:
    """(star_id, flux): bad pixels replaced by the sample mean of the pixel."""
    if means is None:
        rows = pixel_means(spectra).orderBy("pix").collect()                   # one row per pixel of the axis
        means = np.array([r["mean"] for r in rows], np.float32)

    def stage(batch):
        flux, good = matrix(batch["flux"], np.float32), matrix(batch["good"], bool)
        return {"star_id": batch["star_id"], "flux": lists(np.where(good, flux, means[None, :]))}

    return map_batches(spectra.select("star_id", "flux", "good"), stage, "star_id bigint, flux array<float>")
