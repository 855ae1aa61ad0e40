"""Nearest neighbours under the L1 (or Euclidean) distance.

Exact search. Identical vectors are collapsed first, so a large group of copies costs one row. The distinct vectors
are packed into bounded blocks that follow their nearest pivots. A block's distances to the pivots bound, by the
triangle inequality, its distance to any other block; a block is compared only with the blocks that could hold one of
its members' k nearest. Block pairs come from an equi-join on (pivot, distance bucket), a task compares a group of blocks
with a bounded number of others, and no result is dropped: the bounds are exact.

Approximate search. The same packing under several random pivot sets gives candidate lists, then rounds of
nearest-neighbour descent test pairs that share a neighbour. Distances are always the exact ones.
"""
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.arrays import lists, map_batches, matrix
from ..functions.blocks import block_rows, pack
from ..functions.kernels import METRICS, fold_nearest, merge_top
from ..functions.ranks import with_rank
from ..functions.skew import HUB_ROWS, hubs, salted_join
from ..session import cut, parallelism
from .halo import MOST_AXES, kth_distance

PIVOT_BYTES = 16 << 20     # vectors of all pivots, shipped to every task
MAX_PIVOTS = 64
BUCKETS = 32               # distance buckets per pivot
PAIRS_PER_TASK = 256       # pairs of full blocks one task compares at most
HELD_BYTES = 64 << 20      # of a group of blocks that a task holds while others pass by
TILES = 4                  # tasks per core once blocks have reached their full size
LEAST_PAIRS = 1 << 24      # pairs of rows that are worth a task
SPREAD = 4                 # partitions per task, so that few get two of them
SLACK = 1e-6               # rounding allowance of a bound, relative to the distances it is made of


def check_k(k, n: int) -> int:
    if isinstance(k, bool) or not isinstance(k, (int, np.integer)) or not 0 < k < n:
        raise ValueError(f"asked for {k} neighbours: give a positive integer below the {n} rows there are")
    return int(k)


def neighbours(features: DataFrame, k: int, search: str = "exact", seed: int = 0) -> DataFrame:
    """(star_id, rank, nbr_id, dist): every star's k nearest others in (distance, id) order, ranks from 1."""
    total = features.count()
    k = check_k(k, total)
    if search not in ("exact", "nndescent"):
        raise ValueError(f"unknown search {search!r}; there are 'exact' and 'nndescent'")
    vectors = features.select("star_id", F.col("phi").alias("vec"))
    if search == "exact":
        found = nearest(vectors, vectors, k, "l1", total=total)
    else:
        found = collapse_copies(vectors, k, lambda distinct, n: _descend(distinct, n, k, seed), total)
    return found.withColumn("dist", F.col("dist").cast("float"))


# ---------------------------------------------------------------- copies

def content_key(df: DataFrame) -> DataFrame:
    """Add a 128-bit content key of the vector."""
    return df.withColumn("_h", F.struct(F.xxhash64("vec"), F.xxhash64(F.lit(17), "vec")))


def collapse_copies(vectors: DataFrame, k: int, search, total: int) -> DataFrame:
    """Search among distinct vectors, then give every star its list back, copies included.

    `search(distinct, n)` returns (star_id, rank, nbr_id, dist) among the representatives (the smallest id of each
    group of copies). A group's list is made of the first k + 1 members of its own group and of its neighbouring
    groups; every member takes that list without itself.
    """
    keyed = content_key(vectors.select("star_id", "vec"))
    groups = keyed.groupBy("_h").agg(F.min("star_id").alias("rep"), F.count(F.lit(1)).alias("_copies"))
    distinct_n = groups.count()
    if distinct_n == total:
        return search(vectors, total)
    groups = cut(groups)
    hub = hubs(keyed, "_h", total)
    member = cut(salted_join(keyed.select("star_id", "_h"), groups, "_h", hub).select("star_id", "rep", "_copies"))
    reps = vectors.join(member.where("star_id = rep").select("star_id"), "star_id", "left_semi")
    order = Window.partitionBy("rep").orderBy("star_id")
    heads = (member.where("_copies > 1").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)
             .select("rep", F.col("star_id").alias("head")))
    found = cut(search(reps, distinct_n)) if distinct_n > 1 else None
    own = member.where("star_id = rep").select("star_id", F.col("star_id").alias("nbr_id"), F.lit(0.0).alias("dist"))
    lists_ = own if found is None else own.unionByName(found.select("star_id", "nbr_id", F.col("dist").cast("double")))
    by_group = lists_.withColumnRenamed("nbr_id", "rep")
    heads_of = heads.groupBy("rep").agg(F.collect_list("head").alias("_heads"))          # at most k + 1 each
    wide = salted_join(by_group, heads_of, "rep", hubs(by_group, "rep", distinct_n * (k + 1)), "left")
    opened = wide.select("star_id", "dist", F.explode(F.coalesce("_heads", F.array("rep"))).alias("nbr_id"))
    top = Window.partitionBy("star_id").orderBy("dist", "nbr_id")
    kept = opened.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= k + 1)
    per_rep = (kept.groupBy("star_id").agg(F.array_sort(F.collect_list(F.struct("dist", "nbr_id"))).alias("_l"))
               .withColumnRenamed("star_id", "rep"))
    spread = salted_join(member.select("star_id", "rep"), per_rep, "rep", hubs(member, "rep", total))
    mine = F.slice(F.filter("_l", lambda e: e["nbr_id"] != F.col("star_id")), 1, k)
    return (spread.select("star_id", F.posexplode(mine).alias("_p", "e"))
            .select("star_id", (F.col("_p") + 1).alias("rank"), "e.nbr_id", "e.dist"))


# ---------------------------------------------------------------- exact search by blocks

def _pivots(vectors: DataFrame, metric: str, seed: int, at_most: int) -> np.ndarray:
    """A bounded sample of rows, by seeded hash: at most `at_most` of them and PIVOT_BYTES of vectors."""
    rows = vectors.orderBy(F.xxhash64(F.lit(seed), "star_id"), "star_id").limit(at_most).collect()
    found = np.array([r["vec"] for r in rows], METRICS[metric][1])
    return found[:max(1, PIVOT_BYTES // found[0].nbytes)]


def pivot_count(n: int) -> int:
    return max(8, min(MAX_PIVOTS, n // 64))


def _near_pivots(vectors: DataFrame, pivots: np.ndarray, metric: str) -> DataFrame:
    """Add the sort key c1, c2, d1: nearest pivot, second nearest, distance."""
    kernel, dtype = METRICS[metric]
    broadcast = vectors.sparkSession.sparkContext.broadcast(pivots)

    def stage(batch):
        d = kernel(matrix(batch["vec"], dtype), broadcast.value).astype(np.float64)
        order = np.argsort(d, axis=1, kind="stable")
        return {"star_id": batch["star_id"], "vec": batch["vec"],
                "c1": order[:, 0].astype(np.int32), "c2": order[:, min(1, d.shape[1] - 1)].astype(np.int32),
                "d1": d[np.arange(len(d)), order[:, 0]]}

    kind = "float" if dtype is np.float32 else "double"
    return map_batches(vectors.select("star_id", "vec"), stage,
                       f"star_id bigint, vec array<{kind}>, c1 int, c2 int, d1 double")


KEY = ["c1", "c2", "d1", "star_id"]


def nearest(queries: DataFrame, targets: DataFrame, k: int, metric: str = "l1", total: int | None = None) -> DataFrame:
    """(star_id, rank, nbr_id, dist): the k nearest targets of every query, a star never its own neighbour.

    With `queries is targets` copies are collapsed first; otherwise each side is packed as it is.
    """
    if queries is targets:
        total = queries.count() if total is None else total
        return collapse_copies(queries, k, lambda distinct, n: _by_blocks(distinct, distinct, min(k, n - 1), metric, n), total)
    return _by_blocks(queries, targets, k, metric, targets.count())


def kth_nearest(points: DataFrame, k: int, d: int, total: int | None = None) -> DataFrame:
    """(star_id, dist): the Euclidean distance to the k-th nearest other star, from points(star_id, vec) of d numbers."""
    if d <= MOST_AXES:
        return kth_distance(points, k)
    return nearest(points, points, k, "l2", total).where(F.col("rank") == k).select("star_id", "dist")


def _by_blocks(queries: DataFrame, targets: DataFrame, k: int, metric: str, n_targets: int) -> DataFrame:
    spark = targets.sparkSession
    pivots = _pivots(targets, metric, 1, pivot_count(n_targets))
    rows = block_rows(n_targets, pivots.shape[1], max(64, k + 1), parallelism(spark), pivots.itemsize)

    def blocks_of(vectors):
        return cut(pack(_near_pivots(vectors, pivots, metric), KEY, rows, metric, pivots, k))

    t_blocks = blocks_of(targets)
    if queries is targets:
        q_blocks = t_blocks
    else:
        # the k-th nearest of a query must come from targets: only the pivots bound it
        q_blocks = cut(pack(_near_pivots(queries, pivots, metric), KEY, rows, metric, pivots, k, inside=False))
    pairs = cut(_block_pairs(q_blocks, t_blocks))
    return _compare(q_blocks, t_blocks, pairs, k, metric, pivots, rows, n_targets)


def _block_pairs(q_blocks: DataFrame, t_blocks: DataFrame) -> DataFrame:
    """(q, t, lb): the block pairs a bound cannot exclude.

    A block q has a home pivot. Any target block whose distances to that pivot stay outside
    [lo - ub, hi + ub] is excluded by it, so both sides meet on (pivot, bucket of distance); a pair that shares
    several buckets is kept in the first. The remaining pivots then sharpen the bound.
    """
    tops = t_blocks.select(F.posexplode("hi").alias("p", "v")).groupBy("p").agg(F.max("v").alias("v")).collect()
    width = F.lit([float(r["v"]) / BUCKETS or 1.0 for r in sorted(tops, key=lambda r: r["p"])])     # one per pivot
    home = F.array_position("hi", F.array_min("hi")).cast("int") - 1

    def bucket(value, p):
        return F.least(F.greatest(F.floor(value / F.get(width, p)), F.lit(0)), F.lit(BUCKETS)).cast("int")

    q = q_blocks.select(F.col("block").alias("q"), F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi"), "ub", home.alias("p"))
    reach = F.col("ub") + SLACK * (F.get("q_hi", "p") + F.col("ub"))
    q = q.withColumn("_r", F.when(F.col("ub") == float("inf"), F.lit(1e300)).otherwise(reach))
    q = (q.withColumn("b0", bucket(F.get("q_lo", "p") - F.col("_r"), F.col("p")))
          .withColumn("b1", bucket(F.get("q_hi", "p") + F.col("_r"), F.col("p")))
          .withColumn("bucket", F.explode(F.sequence("b0", "b1"))).drop("_r", "b1"))
    t = t_blocks.select(F.col("block").alias("t"), F.col("lo").alias("t_lo"), F.col("hi").alias("t_hi"),
                        F.posexplode("lo").alias("p", "_lo"))
    t = (t.withColumn("t0", bucket(F.col("_lo"), F.col("p")))
          .withColumn("t1", bucket(F.get("t_hi", "p"), F.col("p")))
          .withColumn("bucket", F.explode(F.sequence("t0", "t1"))).drop("_lo", "t1"))
    met = q.join(t, ["p", "bucket"]).where(F.col("bucket") == F.greatest("b0", "t0"))

    def gap(near, far):
        return F.array_max(F.zip_with(near, far, lambda a, b: a - b - SLACK * (a + b)))

    lb = F.greatest(gap("t_lo", "q_hi"), gap("q_lo", "t_hi"), F.lit(0.0))
    return met.withColumn("lb", lb).where(F.col("lb") <= F.col("ub")).select("q", "t", "lb")


def _groups(q_blocks: DataFrame, n_targets: int, rows: int, per_row: int) -> tuple[DataFrame, float]:
    """(q, grp): runs of blocks, neighbours in the sort order, that a task holds together; and the pairs of rows for a task.

    A block of the other side is sent once to each group, not to each block, so what is moved does not grow with the
    square of the number of blocks. While blocks have not reached their full size there are two groups per core, each for
    one task; later, tasks are tiles, as many groups as shares of the other side.
    """
    spark = q_blocks.sparkSession
    sizes = sorted((r["block"], r["n"]) for r in q_blocks.select("block", "n").collect())      # N / rows numbers
    total, cores = sum(n for _, n in sizes), parallelism(spark)
    whole = total == n_targets <= 2 * cores * rows
    few = 2 * cores if whole else math.ceil(math.sqrt(TILES * cores * min(1.0, total / max(1, n_targets))))
    most, at, held, out = min(-(-total // max(1, few)), HELD_BYTES // per_row), 0, 0, []
    for block, n in sizes:
        if held and held + n > most:
            at, held = at + 1, 0
        held += n
        out.append((block, at))
    each = PAIRS_PER_TASK * float(rows) * rows
    return spark.createDataFrame(out, "q bigint, grp bigint"), each if whole else min(each, max(LEAST_PAIRS, total * n_targets / (TILES * cores)))


def _compare(q_blocks: DataFrame, t_blocks: DataFrame, pairs: DataFrame, k: int, metric: str, pivots: np.ndarray, rows: int,
             n_targets: int) -> DataFrame:
    """Run the block pairs, a tile of distances at a time.

    A task holds a group of blocks and takes the others one after the other. A group with many pairs is repeated once per
    PAIRS_PER_TASK of them; rows of a block that a partner's pivot distances exclude stay out.
    """
    kernel, dtype = METRICS[metric]
    spark = pairs.sparkSession
    cores = parallelism(spark)
    per_row = pivots.itemsize * (pivots.shape[1] + len(pivots)) + 16 * (k + 1)
    groups, each = _groups(q_blocks, n_targets, rows, per_row)
    groups = F.broadcast(cut(groups))
    sized = (pairs.join(groups, "q").join(q_blocks.select(F.col("block").alias("q"), F.col("n").alias("_nq")), "q")
             .join(t_blocks.select(F.col("block").alias("t"), F.col("n").alias("_nt")), "t"))
    met = cut(sized.groupBy("grp", "t").agg(F.min("lb").alias("lb"), F.collect_list("q").alias("qs"),
                                            F.sum(F.col("_nq").cast("double") * F.col("_nt")).alias("_w")))   # a group's blocks
    shares = cut(met.groupBy("grp").agg(F.ceil(F.sum("_w") / each).cast("int").alias("shares")))
    most, tasks = shares.agg(F.max("shares"), F.sum("shares")).first()
    body, none = ["n", "ids", "mat"], F.lit(None)
    work = (met.join(F.broadcast(shares), "grp").withColumn("share", F.pmod(F.xxhash64("t"), F.col("shares")).cast("int"))
            .join(t_blocks.select(F.col("block").alias("t"), *body, "lo", "hi"), "t")
            .select("grp", "share", "lb", "qs", *body, "lo", "hi", none.cast("binary").alias("ubs")))
    left = (q_blocks.select(F.col("block").alias("q"), *body, "ubs").join(groups, "q").join(F.broadcast(shares), "grp")
            .withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
            .select("grp", "share", F.lit(-1.0).alias("lb"), F.array("q").alias("qs"), *body,
                    *[none.cast("array<double>").alias(c) for c in ("lo", "hi")], "ubs"))
    parts = max(cores, _partitions(pairs), min(SPREAD * (tasks or 1), 2 * SPREAD * SPREAD * cores))
    dealt = left.unionByName(work).repartition(parts, "grp", "share").sortWithinPartitions("grp", "share", "lb")
    shipped = spark.sparkContext.broadcast(pivots)

    def run(batches):
        current, held = None, {}

        def results():
            for ids, _, best_d, best_i, _, _ in held.values():
                keep = best_i >= 0
                rank = np.broadcast_to(np.arange(1, k + 1, dtype=np.int32), best_i.shape)
                yield pa.RecordBatch.from_pydict({
                    "star_id": np.broadcast_to(ids[:, None], best_i.shape)[keep], "rank": rank[keep],
                    "nbr_id": best_i[keep], "dist": best_d[keep]})
            held.clear()

        def may(pds, limit, lo, hi):
            """The rows that may have one of their k nearest in a block with these distances to the pivots."""
            gap = np.maximum(lo - pds - SLACK * (lo + pds), pds - hi - SLACK * (pds + hi)).max(axis=1)
            return np.flatnonzero(gap <= limit * (1 + SLACK))

        for batch in batches:
            for at in range(batch.num_rows):             # one block at a time leaves the batch
                row = batch.slice(at, 1).to_pylist()[0]
                key = (row["grp"], row["share"])
                other = np.frombuffer(row["ids"], np.int64)
                block = np.frombuffer(row["mat"], dtype).reshape(len(other), -1)
                if key != current:
                    yield from results()
                    current = key
                if row["lb"] < 0:                        # the blocks of the group sort first
                    held[row["qs"][0]] = (other, block, np.full((len(other), k), np.inf), np.full((len(other), k), -1, np.int64),
                                          np.frombuffer(row["ubs"], np.float64), kernel(block, shipped.value))
                    continue
                lo, hi = np.array(row["lo"]), np.array(row["hi"])
                for q in sorted(row["qs"]):
                    ids, mat, best_d, best_i, ubs, pds = held[q]
                    limit = np.minimum(best_d[:, -1], ubs)
                    some = may(pds, limit, lo, hi)
                    near_d, near_i = best_d[some], best_i[some]
                    fold_nearest(near_d, near_i, mat[some], ids[some], block, other, k, metric, limit[some])
                    best_d[some], best_i[some] = near_d, near_i
        yield from results()

    found = dealt.mapInArrow(run, "star_id bigint, rank int, nbr_id bigint, dist double")
    if (most or 1) == 1:
        return found
    top = Window.partitionBy("star_id").orderBy("dist", "nbr_id")
    return found.drop("rank").withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select(
        "star_id", "rank", "nbr_id", "dist")


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


# ---------------------------------------------------------------- approximate search

SEED_PASSES = 4            # packings under different pivots that supply the first candidate lists
EXTRA = 30                 # lists hold this many entries beyond k while they improve
CELL_BYTES = 64 << 20      # of vectors that the stars tested together can need
TESTED_ROWS = 1 << 19      # improvements that are reduced at once
STOP_RATE = 0.001          # share of list entries that must change for another round


def _pack_top(vectors: DataFrame, pivots: np.ndarray, rows: int, k: int) -> DataFrame:
    """Exact k nearest within each block of one packing."""
    kernel, dtype = METRICS["l1"]
    blocks = pack(_near_pivots(vectors, pivots, "l1"), KEY, rows, "l1")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                mat = np.frombuffer(row["mat"], dtype).reshape(len(ids), -1)
                d = kernel(mat, mat).astype(np.float64)
                np.fill_diagonal(d, np.inf)
                best_d, best_i = merge_top(np.full((len(ids), k), np.inf), np.full((len(ids), k), -1, np.int64), d, ids, k)
                keep = best_i >= 0
                yield pa.RecordBatch.from_pydict({"star_id": np.broadcast_to(ids[:, None], best_i.shape)[keep],
                                                  "nbr_id": best_i[keep], "dist": best_d[keep]})

    return blocks.mapInArrow(run, "star_id bigint, nbr_id bigint, dist double")


def _best_k(candidates: DataFrame, k: int) -> DataFrame:
    """The k best distinct candidates of every star; each task forwards at most k per star."""
    top = Window.partitionBy("star_id").orderBy("dist", "nbr_id")
    one = candidates.groupBy("star_id", "nbr_id").agg(F.min("dist").alias("dist"), F.min("fresh").alias("fresh"))
    return one.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)


def _descend(vectors: DataFrame, total: int, k: int, seed: int) -> DataFrame:
    """Nearest-neighbour descent among distinct vectors.

    Lists are kept a little longer than k. Every round tests all forward and as many reverse neighbours of a star
    against each other; it ends when the share of changed entries falls to STOP_RATE, and not before.
    """
    wanted = min(k, total - 1)
    k = min(k + EXTRA, total - 1)
    rows = 4 * (k + 1)
    fresh = F.lit(1).alias("fresh")
    seeds = None
    for turn in range(SEED_PASSES):
        near = _pack_top(vectors, _pivots(vectors, "l1", seed * 1000 + turn + 2, MAX_PIVOTS), rows, k)
        near = near.select("star_id", "nbr_id", "dist", fresh)
        seeds = near if seeds is None else seeds.unionByName(near)
    lists_ = cut(_best_k(seeds, k))
    width = max(1, len(vectors.first()["vec"]))
    stars = max(1, min(-(-total // (TILES * parallelism(vectors.sparkSession))), CELL_BYTES // ((2 * k + 1) * (4 * width + 16))))
    cells = cut(_cells(vectors, seed, stars))
    turn = 0
    while True:
        tested = cut(_local_join(lists_, vectors, cells, -(-total // stars), k, turn))
        old = lists_.select("star_id", "nbr_id", "dist", F.lit(0).alias("fresh"))
        lists_ = cut(_best_k(old.unionByName(tested.select("star_id", "nbr_id", "dist", fresh)), k))
        turn += 1
        if lists_.where("fresh = 1").count() <= STOP_RATE * total * k:
            break
    short = lists_.groupBy("star_id").count().where(F.col("count") < k).select("star_id")
    missing = vectors.select("star_id").join(lists_.select("star_id").distinct(), "star_id", "left_anti")
    short = cut(short.unionByName(missing))
    found = lists_.select("star_id", "rank", "nbr_id", "dist")
    if short.count():
        again = _by_blocks(vectors.join(short, "star_id", "left_semi"), vectors, k, "l1", total)
        found = found.join(short, "star_id", "left_anti").unionByName(again)
    return found.where(F.col("rank") <= wanted)


def _reverse(lists_: DataFrame, width: int, turn: int) -> DataFrame:
    """(star_id, nbr_id, fresh): at most `width` of the stars that list each star, new ones first, drawn anew per round."""
    back = lists_.select(F.col("nbr_id").alias("star_id"), F.col("star_id").alias("nbr_id"), "fresh")
    draw = Window.partitionBy("star_id").orderBy(F.col("fresh").desc(), F.xxhash64(F.lit(turn), "star_id", "nbr_id"))
    return back.withColumn("_r", F.row_number().over(draw)).where(F.col("_r") <= width).drop("_r")


def _cells(vectors: DataFrame, seed: int, stars: int) -> DataFrame:
    """(star_id, cell): runs of `stars` stars that share their nearest pivots, and so many of their neighbours."""
    keyed = _near_pivots(vectors, _pivots(vectors, "l1", seed * 1000 + 2, MAX_PIVOTS), "l1").select(*KEY)
    ranked = with_rank(keyed, KEY).select("star_id", F.floor(F.col("rnk") / stars).cast("bigint").alias("cell"))
    return ranked.groupBy("star_id").agg(F.min("cell").alias("cell"))          # a star that comes twice has one cell


def _best_pairs(star: np.ndarray, other: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first distinct pairs of every star, in (distance, id) order."""
    order = np.lexsort((other, dist, star))
    star, other, dist = star[order], other[order], dist[order]
    new = np.ones(len(star), bool)
    new[1:] = (star[1:] != star[:-1]) | (other[1:] != other[:-1])             # copies of a pair have one distance
    star, other, dist = star[new], other[new], dist[new]
    first = np.flatnonzero(np.diff(star, prepend=star[0] - 1)) if len(star) else np.zeros(0, np.int64)
    keep = np.arange(len(star)) - np.repeat(first, np.diff(np.append(first, len(star)))) < k
    return star[keep], other[keep], dist[keep]


def _local_join(lists_: DataFrame, vectors: DataFrame, cells: DataFrame, n_cells: int, k: int, turn: int) -> DataFrame:
    """(star_id, nbr_id, dist): improvements found by testing each star's neighbours, both ways, against each other.

    A star's group holds itself, its neighbours and up to k of the stars that name it; only pairs with a fresh entry are
    tested, and only distances that beat a member's current k-th are sent on, at most k of them per member and share of a
    task. The stars of a cell are tested together: each vector that they need is sent to the cell once, groups are ids.
    """
    kernel, dtype = METRICS["l1"]
    worst = lists_.groupBy("star_id").agg(F.max("dist").alias("kth"), F.count(F.lit(1)).alias("_n"))
    worst = worst.select("star_id", F.when(F.col("_n") < k, F.lit(float("inf"))).otherwise(F.col("kth")).alias("kth"))
    member = vectors.join(worst, "star_id").select(F.col("star_id").alias("nbr_id"), "vec", "kth")
    both = lists_.select("star_id", "nbr_id", "fresh").unionByName(_reverse(lists_, k, turn))
    first = both.groupBy("star_id", "nbr_id").agg(F.max("fresh").alias("fresh"))
    active = first.groupBy("star_id").agg(F.max("fresh").alias("_any")).where("_any = 1").select("star_id")
    first = first.join(active, "star_id", "left_semi")
    seats = first.unionByName(active.select("star_id", F.col("star_id").alias("nbr_id"), F.lit(1).alias("fresh")))
    seats = cut(seats.join(cells, "star_id").select("cell", "star_id", "nbr_id", "fresh"))
    needed = seats.select("cell", "nbr_id").distinct()                         # a star comes once per cell at most
    sent = salted_join(needed, member, "nbr_id", None if n_cells <= HUB_ROWS else hubs(needed, "nbr_id"))
    sent = sent.select("cell", F.lit(None).cast("bigint").alias("star_id"), "nbr_id", F.lit(0).alias("fresh"), "kth", "vec")
    kind = dict(vectors.dtypes)["vec"]
    told = seats.select("cell", "star_id", "nbr_id", "fresh", F.lit(None).cast("double").alias("kth"), F.lit(None).cast(kind).alias("vec"))
    parts = max(_partitions(vectors), min(SPREAD * n_cells, 4 * SPREAD * TILES * parallelism(vectors.sparkSession)))
    dealt = sent.unionByName(told).repartition(parts, "cell").sortWithinPartitions("cell", F.col("star_id").asc_nulls_first(), "nbr_id")

    def run(batches):
        cell, members, groups = None, [], []
        for batch in batches:
            at = batch["cell"].to_numpy()
            starts = np.append(np.flatnonzero(np.diff(at, prepend=at[0] - 1)), len(at)) if len(at) else np.zeros(0, int)
            for lo, hi in zip(starts[:-1], starts[1:]):
                if at[lo] != cell:
                    if groups:
                        yield from tested(members, groups)
                    cell, members, groups = at[lo], [], []
                part = batch.slice(lo, hi - lo)
                vecs = part["star_id"].null_count                              # the vectors of a cell sort first
                if vecs:
                    head = part.slice(0, vecs)
                    members.append((head["nbr_id"].to_numpy(), head["kth"].to_numpy(), matrix(head["vec"], dtype).copy()))
                if vecs < part.num_rows:
                    rest = part.slice(vecs)
                    groups.append((rest["star_id"].to_numpy(zero_copy_only=False).astype(np.int64), rest["nbr_id"].to_numpy().copy(), rest["fresh"].to_numpy() > 0))
        if groups:
            yield from tested(members, groups)

    def tested(members, groups):
        ids, kth, mat = (np.concatenate(c) for c in zip(*members))
        star, other, fresh = (np.concatenate(c) for c in zip(*groups))
        seat = np.searchsorted(ids, other)
        twice = bool((ids[1:] == ids[:-1]).any())
        if twice:                                                              # a star with several vectors sits there with each
            times = np.searchsorted(ids, other, "right") - seat
            star, fresh = np.repeat(star, times), np.repeat(fresh, times)
            seat = np.repeat(seat, times) + np.arange(len(star)) - np.repeat(np.cumsum(times) - times, times)
        starts = np.append(np.flatnonzero(np.diff(star, prepend=star[0] - 1)), len(star))
        held, size = [], 0

        def out(row, col, d):
            for at in range(0, len(row), TESTED_ROWS):
                part = slice(at, at + TESTED_ROWS)
                yield pa.RecordBatch.from_pydict({"star_id": ids[row[part]], "nbr_id": ids[col[part]], "dist": d[part].astype(np.float64)})

        for a, b in zip(starts[:-1], starts[1:]):
            every, new = seat[a:b], np.flatnonzero(fresh[a:b])
            old = np.flatnonzero(~fresh[a:b])
            vecs = mat[every]
            d = kernel(vecs[new], vecs)
            wanted = d < kth[every[new], None]
            wanted[np.arange(len(new)), new] = False
            row, col = np.nonzero(wanted)
            held.append((every[new[row]], every[col], d[row, col]))
            if len(old):                                                       # what fresh ones are to the others
                back = d[:, old]
                row, col = np.nonzero(back < kth[every[old]])
                held.append((every[old[col]], every[new[row]], back[row, col]))
                size += len(row)
            size += len(held[-1][0])
            if size > TESTED_ROWS and twice:                                   # pairs have no one distance: all are sent on
                yield from out(*(np.concatenate(c) for c in zip(*held)))
                held, size = [], 0
            elif size > TESTED_ROWS:
                held, size = [_best_pairs(*(np.concatenate(c) for c in zip(*held)), k)], 0
                owner, _, found = held[0]
                last = np.flatnonzero(np.diff(owner, append=-1))               # where a star has k by now, farther ones are none of them
                full = last[(last >= k - 1) & (owner[last - k + 1] == owner[last])]
                kth[owner[full]] = np.minimum(kth[owner[full]], np.nextafter(found[full].astype(np.float64), np.inf))
        if held:
            found = [np.concatenate(c) for c in zip(*held)]
            yield from out(*(found if twice else _best_pairs(*found, k)))

    return dealt.select("cell", "star_id", "nbr_id", "fresh", "kth", "vec").mapInArrow(run, "star_id bigint, nbr_id bigint, dist double")


def overlap_table(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(star_id, shared, same_first): how many of the first k neighbours two searches share, per star."""
    left = a.where(F.col("rank") <= k).select("star_id", "nbr_id", F.col("rank").alias("_ra"))
    right = b.where(F.col("rank") <= k).select("star_id", "nbr_id", F.col("rank").alias("_rb"))
    both = F.col("_rb").isNotNull()
    first = both & (F.col("_ra") == 1) & (F.col("_rb") == 1)
    return left.join(right, ["star_id", "nbr_id"], "left").groupBy("star_id").agg(
        F.count(F.when(both, 1)).alias("shared"), F.max(first).alias("same_first"))


def overlap(a: DataFrame, b: DataFrame, k: int) -> tuple[float, float]:
    """(mean share of the first k neighbours two searches have in common, share of equal first neighbours)."""
    row = overlap_table(a, b, k).agg(F.avg("shared") / k, F.avg(F.col("same_first").cast("double"))).first()
    return float(row[0]), float(row[1])


def feature_layout(features: DataFrame, rows: int) -> DataFrame:
    """(star_id, block): bounded blocks of stars that share their nearest pivots, for block-wise graph work."""
    vectors = features.select("star_id", F.col("phi").alias("vec"))
    keyed = _near_pivots(vectors, _pivots(vectors, "l1", 1, MAX_PIVOTS), "l1").select(*KEY)
    return with_rank(keyed, KEY).select("star_id", F.floor(F.col("rnk") / rows).cast("bigint").alias("block"))
