"""Rows packed into bounded blocks of neighbours in a sort order.

Packing is one range shuffle: rows are sorted by the key columns across the cluster and every partition is cut into
runs of `rows` rows. Equal keys never pile up, because the sort ends in star_id; a group holding a third of the rows
is just a longer run of blocks.
"""
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .arrays import matrix
from .kernels import METRICS, fold_nearest

BLOCK_BYTES = 8 << 20      # vectors of one block
BLOCK_ROWS = 1 << 14       # rows of one block: its lists of neighbours and its bounds
BOUND_ROWS = 1 << 10       # rows among which a block bounds its members' k-th distances


def block_rows(n_rows: int, width: int, least: int, tasks: int, item: int = 4) -> int:
    """Rows per block: enough blocks to keep every core busy, at least `least`, at most BLOCK_BYTES of vectors
    and BLOCK_ROWS of them."""
    fair = -(-n_rows // (2 * tasks))
    return max(least, min(fair, BLOCK_ROWS, BLOCK_BYTES // max(1, item * width)))


def pack(df: DataFrame, sort: Sequence[str], rows: int, metric: str, pivots: np.ndarray | None = None, k: int = 0,
         inside: bool = True) -> DataFrame:
    """(block, n, ids, mat) or, with `pivots`, also (lo, hi, ub, ubs): one row per block.

    `df` has star_id, vec and the sort columns. lo / hi bound the members' distances to every pivot; ubs bounds the
    distance of each member to its k-th nearest other row, taken from the pivots (rows of the table searched) and, if
    `inside`, from the block itself; ub is the largest of them. Distances to the pivots are measured where they are
    needed: they take more bytes than most vectors, so they are neither shuffled nor written.
    """
    kernel, dtype = METRICS[metric]
    schema = "block bigint, n int, ids binary, mat binary"
    shipped = None
    if pivots is not None:
        schema += ", lo array<double>, hi array<double>, ub double, ubs binary"
        shipped = df.sparkSession.sparkContext.broadcast(pivots)

    def emit(seq, ids, vecs):
        out = {"block": [(TaskContext.get().partitionId() << 32) + seq], "n": pa.array([len(ids)], pa.int32()),
               "ids": [ids.tobytes()], "mat": [np.ascontiguousarray(vecs, dtype).tobytes()]}
        if shipped is not None:
            dists = kernel(vecs, shipped.value)
            out["lo"], out["hi"] = [dists.min(axis=0).astype(np.float64)], [dists.max(axis=0).astype(np.float64)]
            bounds = bound(ids, vecs, dists)
            out["ub"], out["ubs"] = [float(bounds.max())], [bounds.tobytes()]
        return pa.RecordBatch.from_pydict(out)

    def bound(ids, vecs, dists):
        best = np.full(len(vecs), np.inf)
        if dists.shape[1] > k:                       # one of the pivots may be the row itself
            best = np.partition(dists, k, axis=1)[:, k].astype(np.float64)
        if inside:
            for at in range(0, len(vecs), max(BOUND_ROWS, k + 1)):
                part = slice(at, at + max(BOUND_ROWS, k + 1))
                near = np.full((len(vecs[part]), k), np.inf)
                fold_nearest(near, np.full(near.shape, -1), vecs[part], ids[part], vecs[part], ids[part], k, metric, best[part])
                best[part] = np.minimum(best[part], near[:, -1])
        return best

    def run(batches):
        seq, held = 0, []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch["star_id"].to_numpy(), matrix(batch["vec"], dtype)))
            size += batch.num_rows
            if size >= rows:
                ids, vecs = (np.concatenate(parts) for parts in zip(*held))
                whole = size - size % rows
                for start in range(0, whole, rows):
                    cut_ = slice(start, start + rows)
                    yield emit(seq, ids[cut_], vecs[cut_])
                    seq += 1
                held, size = [(ids[whole:], vecs[whole:])], size - whole
        if size:
            yield emit(seq, *(np.concatenate(parts) for parts in zip(*held)))

    ordered = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    return ordered.select("star_id", "vec").mapInArrow(run, schema)
