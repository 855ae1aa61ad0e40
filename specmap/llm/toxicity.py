"""Severity of toxic texts by cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w . x - theta_k): one weight vector shared by all thresholds, which stay in order because their
gaps are exponentials. Features are hashes of words (ASCII letters lowered, outer punctuation left out) and of their
first six bytes, valued log(1 + count); the features that tell toxic training texts from others best are kept. The
expected severity adds P(grade > k) over the thresholds, times the step from one given grade to the next.

Labels that only say toxic or not become grades by rule (`graded`): 0 for texts that are not toxic; for toxic ones 1, 2 or
3 by thirds of how often they use features that are typical of toxic texts.

Cases: null and empty texts have no features and get the severity of the intercepts; a null id stays null; repeated rows
each give a row; labels that are null or name no text teach nothing; labels of one grade give that grade to every text, and without a feature seen in three
texts the commoner of toxic and not is given; an
empty table gives an empty one; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specmap.llm.words import Words, mix, slices

#: About so many labelled texts (those whose hash falls below a share) teach the model.
FIT_TEXTS = 6_000
#: Features that are kept.
FEATURES = 4_096
PREFIX = 6
_OUTER = np.zeros(256, bool)
_OUTER[[i for i in range(128) if not chr(i).isalnum()]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature hash), one for each occurrence."""
    w = Words(data, offsets, lower=True)
    starts, ends = w.starts.copy(), w.ends.copy()
    # leave out punctuation at both ends, one byte a round
    while len(live := np.flatnonzero((starts < ends) & _OUTER[w.data[np.minimum(starts, len(w.data) - 1)]])):
        starts[live] += 1
    while len(live := np.flatnonzero((starts < ends) & _OUTER[w.data[np.maximum(ends - 1, 0)]])):
        ends[live] -= 1
    full = starts < ends
    starts, ends, text = starts[full], ends[full], w.text[full]
    words = w.span_hash(starts, ends)
    heads = mix(w.span_hash(starts, np.minimum(ends, starts + PREFIX)) + np.uint64(PREFIX))
    return np.concatenate([text, text]), np.concatenate([words, heads])


def _counted(text: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences summed: (text number, feature, count)."""
    order = np.lexsort((feature, text))
    t, f = text[order], feature[order]
    lead = np.ones(len(t), bool)
    lead[1:] = (t[1:] != t[:-1]) | (f[1:] != f[:-1])
    at = np.flatnonzero(lead)
    return t[at], f[at], np.diff(np.append(at, len(t)))


@dataclass
class Ordinal:
    """The kept features (ascending), their shared weights, the ordered thresholds, and the grades that these part."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray | None = None

    def __post_init__(self) -> None:
        if self.grades is None:
            self.grades = np.arange(len(self.thresholds) + 1)

    @classmethod
    def constant(cls, grade: int) -> "Ordinal":
        return cls(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), np.array([grade]))

    def log_odds(self, text: np.ndarray, feature: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        """w . x for each of n texts."""
        if not len(self.features):
            return np.zeros(n)
        at = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
        hit = self.features[at] == feature
        return np.bincount(text[hit], self.weights[at[hit]] * np.log1p(count[hit]), n)

    def exceeds(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k), a row per text."""
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds[None, :], -60, 60)))


def fit(row: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, n_columns: int, ridge: float = 2e-5, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of largest penalised likelihood, by Adam on the whole sample; grades run from 0 to K."""
    n, top = len(grade), int(grade.max()) if len(grade) else 0
    share = np.array([(grade > k).mean() for k in range(top)])
    base = -np.log(np.clip(share, 1e-4, 1 - 1e-4) / (1 - np.clip(share, 1e-4, 1 - 1e-4)))
    p = np.concatenate([np.zeros(n_columns), base[:1], np.log(np.maximum(np.diff(base), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, rounds + 1):
        w, first, gaps = p[:n_columns], p[n_columns], np.exp(p[n_columns + 1 :])
        theta = np.concatenate([[first], first + np.cumsum(gaps)])
        z = np.bincount(row, value * w[column], n)
        inner = 1 / (1 + np.exp(-np.clip(z[:, None] - theta[None, :], -40, 40)))
        upper = np.concatenate([np.ones((n, 1)), inner, np.zeros((n, 1))], axis=1)
        at = np.arange(n)
        above, below = upper[at, grade], upper[at, grade + 1]
        chance = np.maximum(above - below, 1e-9)
        slope = upper * (1 - upper)
        d_theta = np.zeros((n, top + 2))
        d_theta[at, grade] += slope[at, grade] / chance
        d_theta[at, grade + 1] -= slope[at, grade + 1] / chance
        d_theta = d_theta[:, 1:-1]
        d_z = -d_theta.sum(axis=1) / n
        d_theta = d_theta.sum(axis=0) / n
        g = np.concatenate([np.bincount(column, value * d_z[row], n_columns) + ridge * w, [d_theta.sum()], [d_theta[k + 1 :].sum() * gaps[k] for k in range(top - 1)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    first, gaps = p[n_columns], np.exp(p[n_columns + 1 :])
    return p[:n_columns], np.concatenate([[first], first + np.cumsum(gaps)])


def select(text: np.ndarray, feature: np.ndarray, bad: np.ndarray, most: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """(features, log-odds): those whose presence differs most between bad and other texts, in standard errors."""
    names, column = np.unique(feature, return_inverse=True)
    n1, n0 = bad.sum(), (~bad).sum()
    a = np.bincount(column, bad[text], len(names))
    b = np.bincount(column, ~bad[text], len(names))
    odds = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))
    error = np.sqrt(1 / (a + 0.5) + 1 / (n1 - a + 0.5) + 1 / (b + 0.5) + 1 / (n0 - b + 0.5))
    pick = np.sort(np.argsort(-np.abs(odds / error), kind="stable")[:most])
    pick = pick[(a + b)[pick] >= 3]
    return names[pick], odds[pick]


def graded(text: np.ndarray, feature: np.ndarray, count: np.ndarray, names: np.ndarray, odds: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Grades from labels that only say bad or not: 0, or 1 to 3 by thirds of the uses of typical features."""
    typical = names[odds > 2]
    if len(typical):
        at = np.minimum(np.searchsorted(typical, feature), len(typical) - 1)
        hit = typical[at] == feature
        uses = np.bincount(text[hit], count[hit], len(bad))
    else:
        uses = np.zeros(len(bad))
    low, high = np.quantile(uses[bad], [1 / 3, 2 / 3]) if bad.any() else (0, 0)
    return np.where(bad, 1 + (uses > low) + (uses > high), 0).astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_texts: int = FIT_TEXTS, binary: bool = True) -> Ordinal:
    """The model of about `fit_texts` labelled texts. `binary`: the labels are 0 and 1, and grades are made by rule;
    else they are the grades, 0 and up."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id IS NOT NULL AND _y IS NOT NULL")
    share = min(1.0, fit_texts / max(1, known.count()))
    drawn = known.filter(F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)))
    taught = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(drawn, "_id").select("text", "_y")

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                t, f, n = _counted(*features(data, offsets))
                ends = np.searchsorted(t, np.arange(rows.num_rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (f.view(np.int64), n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([rows.column("_y"), *lists], ["y", "f", "n"])

    table = taught.mapInArrow(stage, "y int, f array<long>, n array<int>").toArrow().combine_chunks()
    y = table.column("y").to_numpy()
    if not len(y):
        return Ordinal.constant(0)
    y = (y > 0).astype(np.int64) if binary else np.maximum(y, 0).astype(np.int64)
    if y.min() == y.max():
        return Ordinal.constant(int(y[0]))
    flat = lambda c: table.column(c).combine_chunks()
    sizes = np.array([len(x) for x in flat("f")])
    text = np.repeat(np.arange(len(y)), sizes)
    feature = flat("f").flatten().to_numpy().view(np.uint64)
    count = flat("n").flatten().to_numpy()
    bad = y > y.min()
    names, odds = select(text, feature, bad)
    if not len(names):
        return Ordinal.constant(int(np.sort(y)[len(y) // 2]))
    grades, grade = np.unique(graded(text, feature, count, names, odds, bad) if binary else y, return_inverse=True)
    at = np.minimum(np.searchsorted(names, feature), len(names) - 1)
    hit = names[at] == feature
    weights, thresholds = fit(text[hit], at[hit], np.log1p(count[hit]), grade, len(names))
    return Ordinal(names, weights, thresholds, grades)


def score(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text", least: float = 0.4) -> DataFrame:
    """(id, severity, grade, p_toxic, toxic) for every row: the expected grade, the median grade, P(grade > 0), and
    whether that is at least `least`."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                text, feature = features(data, offsets)
                if len(model.features):
                    # only kept features need counting
                    at = np.minimum(np.searchsorted(model.features, feature), len(model.features) - 1)
                    hit = model.features[at] == feature
                    text, feature = text[hit], feature[hit]
                p = model.exceeds(model.log_odds(*_counted(text, feature), rows.num_rows))
                severity = model.grades[0] + p @ np.diff(model.grades).astype(float)
                grade = model.grades[(p >= 0.5).sum(axis=1)].astype(np.int32)
                some = p[:, 0] if len(model.thresholds) and model.grades[0] == 0 else np.full(rows.num_rows, float(model.grades[0] > 0))
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(severity), pa.array(grade), pa.array(some), pa.array(some >= least)], ["id", "severity", "grade", "p_toxic", "toxic"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(stage, "id long, severity double, grade int, p_toxic double, toxic boolean").withColumnRenamed("id", id_col)
