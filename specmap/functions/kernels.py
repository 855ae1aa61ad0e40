"""Dense distance kernels on small blocks of rows, used inside tasks.

Differences are taken in the storage type and accumulated in float64 one column after the other, so every route to
a distance (exact search, re-scoring, medians, bridges) gives the same bits for the same pair.
"""
import numpy as np

PICKED = 256               # pairs whose differences are held at once


def l1_cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """L1 distances between the rows of two float32 blocks, rounded to float32."""
    at, bt = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    total = np.zeros((a.shape[0], b.shape[0]))
    step = np.empty(total.shape, at.dtype)
    for left, right in zip(at, bt):
        np.subtract(left[:, None], right[None, :], out=step)
        np.abs(step, out=step)
        total += step
    return total.astype(np.float32)


def _line_sums(step: np.ndarray) -> np.ndarray:
    """The sum of each row of a few rows, one column after the other, in float64."""
    turned = step.T.astype(np.float64, order="C")
    if len(step) == 1:                                       # numpy would sum a single line pairwise
        return np.cumsum(turned[:, 0])[-1:]
    return np.add.reduce(turned, axis=0)


def l1_matched(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """L1 distance of row i of `a` to row i of `b`, rounded to float32."""
    every = np.arange(len(a))
    return l1_picked(a, b, every, every)


def l1_picked(a: np.ndarray, b: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """L1 distance of row `row[i]` of `a` to row `col[i]` of `b`, rounded to float32, so few at a time that caches hold them."""
    out = np.zeros(len(row), np.float32)
    for at in range(0, len(row) if a.shape[1] else 0, PICKED):
        step = a.take(row[at:at + PICKED], axis=0)
        step -= b.take(col[at:at + PICKED], axis=0)
        out[at:at + PICKED] = _line_sums(np.abs(step, out=step))
    return out


def l2_cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between the rows of two float64 blocks."""
    total = np.zeros((a.shape[0], b.shape[0]))
    for left, right in zip(a.T, b.T):
        total += (left[:, None] - right[None, :]) ** 2
    return np.sqrt(total)


# metric name -> (kernel, storage type of the vectors)
METRICS = {"l1": (l1_cross, np.float32), "l2": (l2_cross, np.float64)}


def merge_top(best_d, best_i, d, ids, k):
    """Fold a block of distances into running nearest lists.

    best_d, best_i  (n, k) current lists, padded with inf / -1;  d (n, m) new distances, ids (m,) their targets.
    Order is (distance, id); pairs to skip carry d = inf.
    """
    limit = best_d[:, -1]
    if d.shape[1] > k:
        limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1])
    row, col = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
    return merge_pairs(best_d, best_i, row, ids[col], d[row, col], k)


def merge_pairs(best_d, best_i, row, who, dist, k):
    """Fold single pairs (row of the lists, target, distance) into running nearest lists, in (distance, id) order."""
    n = best_d.shape[0]
    if not len(row):
        return best_d, best_i
    rows = np.concatenate([np.repeat(np.arange(n), k), row])
    dist = np.concatenate([best_d.ravel(), dist])
    who = np.concatenate([best_i.ravel(), who])
    order = np.lexsort((who, dist, rows))
    rows = rows[order]
    first = np.searchsorted(rows, np.arange(n))
    take = order[first[:, None] + np.arange(k)[None, :]]
    return dist[take], who[take]


TILE = 64, 2048            # rows and columns of distances held at once
MOST_LEVELS = 60_000       # what the whole numbers of a pair of rows may differ by, all columns together
MOST_COLUMNS = 5_000       # beyond, rounding could pass 16 bits
CROWD = 8                  # a tile where so many times k pairs a row pass is narrowed by its own nearest
MATCHED = 1 << 21          # numbers of pairs measured at once
GROUP = 4                  # neighbouring columns whose sums bound a distance from below
FEW = 16                   # columns below which their sums save nothing
PASSED = 0.08              # share of a tile's pairs beyond which all columns bound faster than measuring does


class _Levels:
    """Two blocks in 16-bit whole numbers of one step, and how far each row was moved by rounding.

    The sum of differences of whole numbers, times the step, is at most the two rows' moves away from their L1 distance. It
    is taken as twice the sum of the larger numbers less both rows' sums, in unsigned 16 bits, which it never passes.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        low, high = np.minimum(a.min(axis=0), b.min(axis=0)).astype(np.float64), np.maximum(a.max(axis=0), b.max(axis=0)).astype(np.float64)
        span = high - low
        self.step = max(span.sum() / MOST_LEVELS, span.max() / 32_000) or 1.0
        self.slack = 1e-12 * (np.abs(low).sum() + np.abs(high).sum())
        self.a, self.move_a = self._rounded(a, low)
        self.b, self.move_b = self._rounded(b, low)
        self.b = np.ascontiguousarray(self.b.T)
        self.sum_a, self.sum_b = self.a.sum(axis=1, dtype=np.uint16), self.b.sum(axis=0, dtype=np.uint16)

    def _rounded(self, x, low):
        exact = (x - low) / self.step
        whole = np.rint(exact)
        return whole.astype(np.uint16), np.abs(exact - whole).sum(axis=1)

    def apart(self, rows: slice, cols: slice) -> np.ndarray:
        left, right = np.ascontiguousarray(self.a[rows].T), self.b[:, cols]
        total = np.zeros((left.shape[1], right.shape[1]), np.uint16)
        step = np.empty(total.shape, np.uint16)
        for x, y in zip(left, right):
            np.maximum(x[:, None], y[None, :], out=step)
            total += step
        total += total
        total -= self.sum_a[rows, None]
        total -= self.sum_b[None, cols]
        return total

    def most(self, limit: np.ndarray, rows: slice, cols: slice) -> np.ndarray:
        """Per row the largest sum that a pair no farther than the limit can have."""
        moved = self.move_a[rows] + self.move_b[cols].max()
        most = np.floor((limit * (1 + 1e-6) + self.slack) / self.step + moved) + 1
        return np.clip(most, 0, 65_535).astype(np.uint16)[:, None]

    def kth(self, apart: np.ndarray, k: int, rows: slice, cols: slice) -> np.ndarray:
        """Per row a distance that at least k + 1 of the columns do not pass."""
        near = np.partition(apart, k, axis=1)[:, k].astype(np.float64)
        return ((near + self.move_a[rows] + self.move_b[cols].max()) * self.step + self.slack) * (1 + 1e-6)


def _tiles(n: int, m: int):
    for i in range(0, n, TILE[0]):
        for j in range(0, m, TILE[1]):
            yield slice(i, min(n, i + TILE[0])), slice(j, min(m, j + TILE[1]))


def _places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows and columns that are set, row by row."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


def _summed(x: np.ndarray) -> np.ndarray:
    """The sums of every GROUP neighbouring columns: their L1 distance is never above that of the columns."""
    return np.add.reduceat(x, np.arange(0, x.shape[1], GROUP), axis=1, dtype=np.float64)


def fold_nearest(best_d, best_i, a, a_ids, b, b_ids, k: int, metric: str, limit=None) -> None:
    """Fold the rows of block `b` into the nearest lists (n, k) of the rows of block `a`, in place, a tile at a time.

    A row is not its own neighbour. `limit` bounds each row's k-th distance from above, beside its list. L1 pairs are first
    bounded in 16-bit whole numbers; those that may enter a list are measured by `l1_picked`, so the result is that of
    the whole table of distances. Sums of neighbouring columns are bounded first; where they let many pairs of a tile pass,
    all columns are, and tiles where sums did not help are not tried more often than those where they did.
    """
    kernel, _ = METRICS[metric]
    if not len(a) or not len(b):
        return
    limit = np.full(len(a), np.inf) if limit is None else limit
    bounded = metric == "l1" and 0 < a.shape[1] <= MOST_COLUMNS and np.isfinite(a).all() and np.isfinite(b).all()
    levels = sums = None
    helped = 2 if bounded and a.shape[1] >= FEW else -1
    for rows, cols in _tiles(len(a), len(b)):
        if not bounded:
            d = kernel(a[rows], b[cols]).astype(np.float64)
            d[a_ids[rows, None] == b_ids[None, cols]] = np.inf
            best_d[rows], best_i[rows] = merge_top(best_d[rows], best_i[rows], d, b_ids[cols], k)
            continue
        most = np.minimum(best_d[rows, -1], limit[rows])
        row = None
        if helped >= 0 and np.isfinite(most).all():
            sums = sums or _Levels(_summed(a), _summed(b))
            may = sums.apart(rows, cols) <= sums.most(most, rows, cols)
            row, col = _places(may) if np.count_nonzero(may) <= PASSED * may.size else (None, None)
            helped += 1 if row is not None else -1
        if row is None:
            levels = levels or _Levels(a, b)
            apart = levels.apart(rows, cols)
            row, col = _places(apart <= levels.most(most, rows, cols))
            if len(row) > CROWD * k * apart.shape[0] and apart.shape[1] > k + 1:
                most = np.minimum(most, levels.kth(apart, k, rows, cols))
                row, col = _places(apart <= levels.most(most, rows, cols))
        step = max(1, MATCHED // a.shape[1])
        for at in range(0, len(row), step):
            r, c = row[at:at + step], col[at:at + step] + cols.start
            d = l1_picked(a, b, rows.start + r, c).astype(np.float64)
            keep = (a_ids[rows.start + r] != b_ids[c]) & (d <= best_d[rows.start + r, -1]) & np.isfinite(d)
            best_d[rows], best_i[rows] = merge_pairs(best_d[rows], best_i[rows], r[keep], b_ids[c[keep]], d[keep], k)
