"""N-gram Jaccard self-join by rare-first prefix filtering, down to the components of its links.

A text's set is its distinct shingles of k words (ASCII letters lowered); a text of fewer words has one shingle, all of
it. Texts link when 100 * intersection >= share * union. Steps:

1. Texts with equal sets are one node, named by their smallest id: copies are grouped by a 128-bit digest, never paired.
2. Shingles are put in one global order, rare before frequent. How frequent they are is counted over all texts in a
   table of 262,144 counters (each shingle adds to the counter of its hash), so its size is fixed. The order decides
   only how much work there is, not which pairs are found.
3. Two texts that link share a shingle in the first n - ceil(share * n) + 1 of each (the prefix). A node's prefix is
   written once, beside its size and parities; every later step reads that table.
4. Stars: under each of a node's `FIRST` rarest shingles and `DRAWN` others of its prefix, the texts of like size form a
   group. The first rows of a group, in order of a hash, give its centres (the parities that most of a bunch of them have),
   and the texts closest to a centre are the group's middles. A text is verified against the `TRIED` closest middles of its
   groups. In a group of near copies the middle is the text that differs least from what all were copied from, so what is
   linked with any of them is as a rule linked with the middle, and members need not meet one another.
5. All prefix shingles that texts of two or more labels share are joined with themselves. Length, positional and
   suffix filter are in the join; the suffix filter bounds the Hamming distance of two sets from below by that of their
   parities (each shingle flips one of 256 bits). Every pair is made distinct, goes through the suffix filter by 4,096 bits
   and is verified once, so no link between labels is missed, and components are joined from all links.

A frequent shingle's texts are spread by the join itself (adaptive execution splits both sides of a key), and groups of
copies or near copies are one node or one label before any pair is formed.

Cases: null and empty texts have no shingle, link with nothing and are their own component; a null id stays null and is
not linked; different texts under one id count as one document; an empty table gives an empty one; other
columns of the input are ignored by `components_of`, kept by `keep_one`.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specmap.llm.words import Words, mix, slices, unused, whole_windows, window_hash
from specmap.session import cut

#: Leading bits of a shingle's hash that choose its counter.
SKETCH_BITS = 18
#: Words of 64 parity bits.
PARITY = 4
#: Words of 64 parity bits, of texts of pairs across components.
WIDE = 64
#: Shingles of a prefix under which texts meet first: so many of its rarest, and so many chosen by hash.
FIRST, DRAWN = 2, 8
#: Members of a group whose parities give its centres, and centres at most.
SAMPLE, MIDDLES = 64, 3
#: Middles that a text is verified against.
TRIED = 3
#: Texts whose sizes differ by less than about this factor meet first.
LIKE = 1.12
#: Bits of the map of shingles that several components share (as a binary logarithm).
OPEN_BITS = 24
#: Ids are broadcast up to so many rows; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The ascending distinct shingle hashes of each text."""
    w = Words(data, offsets, lower=True)
    h = w.hashes
    n = len(h) - k + 1
    ok = whole_windows(w.first, w.counts, k, n)
    windows = window_hash(h, k, seed=k)
    for first, count in zip(w.first[:-1].tolist(), w.counts.tolist(), strict=True):
        if count >= k:
            yield np.unique(windows[first : first + count - k + 1])
        elif count:
            yield window_hash(h[first : first + count], count, seed=count)
        else:
            yield np.zeros(0, np.uint64)
    assert ok.sum() == np.maximum(w.counts - k + 1, 0).sum()


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _parities(s: np.ndarray, words: int = PARITY) -> np.ndarray:
    """64 * `words` bits, each the parity of how many shingles hash to it."""
    odd = np.bincount((s & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


_BITS = [f"p{i}" for i in range(PARITY)]


def _surveyed(texts: DataFrame, k: int) -> DataFrame:
    """Per text its set size, digest and parities; per task one row with its counters."""
    names = ["id", "n", "digest", *_BITS, "counter", "times"]
    lists = pa.list_(pa.int32())

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                sets = list(shingle_sets(data, offsets, k))
                sketch += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
                sizes = pa.array([len(s) for s in sets], pa.int32())
                digests = pa.array([_digest(s) for s in sets], pa.binary())
                bits = np.array([_parities(s) for s in sets]).T
                yield pa.RecordBatch.from_arrays([rows.column("id"), sizes, digests, *(pa.array(np.ascontiguousarray(x)) for x in bits), pa.nulls(len(sets), lists), pa.nulls(len(sets), lists)], names)
        used = np.flatnonzero(sketch)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), *(pa.nulls(1, pa.int64()) for _ in _BITS), *(pa.ListArray.from_arrays(pa.array([0, len(used)], pa.int32()), pa.array(x.astype(np.int32))) for x in (used, sketch[used]))], names)

    return texts.mapInArrow(stage, "id long, n int, digest binary, " + ", ".join(f"{b} long" for b in _BITS) + ", counter array<int>, times array<int>")


def _prefixes(texts: DataFrame, k: int, share: int, counters: np.ndarray) -> DataFrame:
    """(id, digest, keys, star): the prefix of each text in the global order, and the places in it under which texts meet first."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                keys, star, digests = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], []
                for s in shingle_sets(data, offsets, k):
                    n = len(s)
                    often = counters[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    prefix = s[np.argsort(often, kind="stable")[: n - -(-share * n // 100) + 1 if n else 0]]
                    keys.append(prefix.view(np.int64))
                    like = prefix[: n - -(-2 * share * n // (100 + share)) + 1]            # texts of equal size meet here
                    star.append(np.append(np.arange(min(FIRST, len(like))), FIRST + np.argsort(mix(like[FIRST:]))[:DRAWN]).astype(np.int32))
                    digests.append(_digest(s))
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([len(x) for x in parts]).astype(np.int32)), pa.array(np.concatenate(parts))) for parts in (keys, star)]
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(digests, pa.binary()), *lists], ["id", "digest", "keys", "star"])

    return texts.mapInArrow(stage, "id long, digest binary, keys array<long>, star array<int>")


def _sets(texts: DataFrame, k: int) -> DataFrame:
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                sets = [s.view(np.int64) for s in shingle_sets(data, offsets, k)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                values = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.ListArray.from_arrays(pa.array(ends), values)], ["id", "set"])

    return texts.mapInArrow(stage, "id long, set array<long>")


def _few(df: DataFrame, times: int = 1) -> bool:
    """Whether `times` the rows of `df` may be broadcast; they are counted batch by batch in one job."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["rows"])

    rows = sum(r["rows"] for r in df.select(df.columns[0]).mapInArrow(stage, "rows long").collect())
    return times * rows <= BROADCAST_ROWS


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if _few(df) else df


def _enough(overlap: Column, a: Column, b: Column, share: int) -> Column:
    return (100 + share) * overlap >= share * (a + b)


def _long_enough(a: Column, b: Column, share: int) -> Column:
    return 100 * F.least(a, b) >= share * F.greatest(a, b)


def _apart(other: str) -> Column:
    """In how many parity bits two sides differ."""
    return sum((F.bit_count(F.col(b).bitwiseXOR(F.col(other + b))) for b in _BITS), F.lit(0))


def _close(share: int, other: str) -> Column:
    """The suffix filter on columns n and parities, and those of the other side."""
    return (100 + share) * _apart(other) <= (100 - share) * (F.col("n") + F.col(other + "n"))


def _fits(share: int) -> Column:
    """Length, positional and suffix filter on two rows (id, n, pos, label, parities), the other's columns marked _."""
    near = F.least("pos", "_pos") + 1 + F.least(F.col("n") - F.col("pos"), F.col("_n") - F.col("_pos")) - 1
    return (F.col("label") != F.col("_label")) & _long_enough(F.col("n"), F.col("_n"), share) & _enough(near, F.col("n"), F.col("_n"), share) & _close(share, "_")


def _marked(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.col(c).alias(f"_{c}") for c in rows.columns))


def _distinct_pairs(met: DataFrame, share: int) -> DataFrame:
    """(a, b, na, nb) once each, from rows that met under one key or several."""
    swap = F.col("id") > F.col("_id")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    pairs = met.select(pick("id", "_id").alias("a"), pick("_id", "id").alias("b"), pick("n", "_n").alias("na"), pick("_n", "n").alias("nb"), (pick("pos", "_pos").cast("long") * 2**32 + pick("_pos", "pos")).alias("places"))
    once = pairs.groupBy("a", "b", "na", "nb").agg(F.min("places").alias("places"))
    at_a, at_b = F.shiftright("places", 32), F.col("places").bitwiseAND(F.lit(2**32 - 1))
    return once.filter(_enough(F.least(F.col("na") - at_a, F.col("nb") - at_b), F.col("na"), F.col("nb"), share)).select("a", "b", "na", "nb")


def _ids(pairs: DataFrame) -> DataFrame:
    """The ids of written pairs, to choose texts by."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    return F.broadcast(ids) if _few(pairs, 2) else ids.distinct()


def _sides(pairs: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """`pairs` with `column` of both, as `column`_a and `column`_b."""
    whole = lambda side: rows.select(F.col("id").alias(side), F.col(column).alias(f"{column}_{side}"))
    return pairs.join(whole("a"), "a").join(whole("b"), "b")


def _near(pairs: DataFrame, texts: DataFrame, k: int, share: int) -> DataFrame:
    """The pairs (a, b, na, nb) that pass the suffix filter by `WIDE` words of parities too: the few of a node say little
    of texts of a thousand words."""
    held = cut(pairs)

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                bits = pa.array([_parities(s, WIDE).tobytes() for s in shingle_sets(data, offsets, k)], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column("id"), bits], ["id", "wide"])

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, WIDE) for c in ("wide_a", "wide_b"))
            n = batch.column("na").to_numpy().astype(np.int64) + batch.column("nb").to_numpy()
            may = (100 + share) * np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) <= (100 - share) * n
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(may))

    bits = texts.join(_ids(held), "id", "left_semi").mapInArrow(wide, "id long, wide binary").dropDuplicates()
    return _sides(held, cut(bits), "wide").mapInArrow(passing, "a long, b long, na int, nb int")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, share: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""
    held = cut(pairs.select("a", "b"))
    sets = cut(_sets(texts.join(_ids(held), "id", "left_semi"), k).dropDuplicates())
    both = _sides(held, sets, "set")
    return cut(both.filter(_enough(F.size(F.array_intersect("set_a", "set_b")), F.size("set_a"), F.size("set_b"), share)).select("a", "b"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select("b", "a"))


def _smallest(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node reaches over edges (a, b). Every round takes the smallest label
    around and the label of the own label, so a long chain halves each round."""
    both = _both(edges)
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")))
    while True:
        own = labels.select(F.col("node").alias("a"), F.explode(F.array("node", "label")).alias("b"))
        seen = both.union(own).join(labels, F.col("b") == F.col("node")).groupBy("a")
        moved = cut(seen.agg(F.min("label").alias("label"), F.max(F.when(F.col("a") == F.col("b"), F.col("label"))).alias("old")))
        labels = moved.select(F.col("a").alias("node"), "label")
        if moved.filter("label < old").isEmpty():
            return labels


def _centres(n: np.ndarray, bits: np.ndarray, share: int) -> np.ndarray:
    """The parities that most of the rows close to a row have: for the row with most others around, then for what is left."""
    apart = np.bitwise_count(bits[:, None] ^ bits[None, :]).sum(axis=2, dtype=np.int64)
    close = (100 + share) * apart <= (100 - share) * (n[:, None] + n[None, :])
    left, out = np.ones(len(n), bool), []
    while left.any() and len(out) < MIDDLES:
        around = close[np.argmax(close[:, left].sum(axis=1) * left)] & left
        each = np.unpackbits(bits[around].view(np.uint8), axis=1, bitorder="little")
        out.append(np.packbits(2 * each.sum(axis=0) > len(each), bitorder="little").view(np.uint64))
        left &= ~around
    return np.array(out)


def _middles(rows: DataFrame, share: int) -> DataFrame:
    """For each key of several rows (id, n, pos, parities, key) those that are closest to its centres.

    The rows of a key pass by in order of a hash, so the first ones are a sample, which gives the centres; of all rows the
    closest to each is kept. In a group of near copies that is the text that differs least from what all were copied from.
    """
    names = ["id", "n", "pos", *_BITS, "key"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), *(pa.int64() for _ in _BITS), pa.int64()]

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []                                             # rows of a key whose sample is not whole yet
        key, centres, best = None, np.zeros((0, PARITY), np.uint64), []

        def seen(part: list[np.ndarray]) -> None:
            bits = np.stack(part[3 : 3 + PARITY], axis=1).view(np.uint64)
            for at, centre in enumerate(centres):
                apart = np.bitwise_count(bits ^ centre).sum(axis=1, dtype=np.int64)
                i = int(np.argmin(apart))
                if best[at] is None or apart[i] < best[at][0]:
                    best[at] = (int(apart[i]), [x[i] for x in part])

        def ended() -> Iterator[pa.RecordBatch]:
            rows = [list(x) for x in dict.fromkeys(tuple(x.item() for x in row) for _, row in best)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        def passed(part: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, key, centres, best
            edges = np.flatnonzero(np.diff(part[-1])) + 1
            starts, ends = np.append(0, edges), np.append(edges, len(part[-1]))
            several = ends - starts > 1
            several[[0, -1]] = True                                             # their keys may go on in another batch
            held = []
            for i in np.flatnonzero(several).tolist():
                group = [x[starts[i] : ends[i]] for x in part]
                if key is None or group[-1][0] != key:
                    if i == len(starts) - 1 and not last and len(group[0]) < SAMPLE:
                        held = group
                        return
                    yield from ended()
                    key, centres = group[-1][0], np.zeros((0, PARITY), np.uint64)
                    if len(group[0]) > 1:
                        n, bits = group[1][:SAMPLE].astype(np.int64), np.stack([x[:SAMPLE] for x in group[3 : 3 + PARITY]], axis=1).view(np.uint64)
                        centres = _centres(n, bits, share)
                    best = [None] * len(centres)
                seen(group)

        for batch in batches:
            if batch.num_rows:
                part = [batch.column(c).to_numpy() for c in names]
                yield from passed([np.concatenate(x) for x in zip(held, part, strict=True)] if held else part, False)
        if held:
            yield from passed(held, True)
        yield from ended()

    schema = "id long, n int, pos int, " + ", ".join(f"{b} long" for b in _BITS) + ", key long"
    return rows.withColumn("turn", F.xxhash64("id")).sortWithinPartitions("key", "turn").select(*names).mapInArrow(stage, schema)


def _around(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node up to two edges (a, b) away. Nodes of one label are connected; not all that are
    connected have one label, which stars need not."""
    both = _both(edges)
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label"))
    return cut(both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("label")).select("node", F.least("node", "label").alias("label")))


def _stars(nodes: DataFrame, share: int) -> DataFrame:
    """(a, b, na, nb): each node and the closest, by parities, of the middles of the groups it is in. A group holds the
    texts of like size under one shingle."""
    size = F.floor(F.log(LIKE, "n"))
    rows = nodes.select("id", "n", *_BITS, size.alias("size"), F.explode("star").alias("pos"), "keys")
    rows = rows.select("id", "n", "pos", *_BITS, F.xxhash64(F.get("keys", "pos"), "size").alias("key")).repartition("key")     # serves both the choice and the join
    label = F.col("id").alias("label")
    met = rows.select("*", label).join(_marked(_middles(rows, share).select("*", label)), (F.col("key") == F.col("_key")) & _fits(share))
    near = met.groupBy("id", "n").agg(F.slice(F.array_sort(F.collect_set(F.struct(_apart("_").alias("apart"), "_id", "_n"))), 1, TRIED).alias("x"))     # a few middles of each shingle
    pairs = near.select("id", "n", F.explode("x").alias("x")).select("id", "n", "x._id", "x._n")
    swap = F.col("id") > F.col("_id")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return pairs.select(pick("id", "_id").alias("a"), pick("_id", "id").alias("b"), pick("n", "_n").alias("na"), pick("_n", "n").alias("nb")).distinct()


def _place(keys: np.ndarray) -> np.ndarray:
    """A shingle's bit in that map: by the low end of its hash, for prefixes gather where counters, its high end, are low."""
    return keys.view(np.uint64) & np.uint64((1 << OPEN_BITS) - 1)


def _open_bits(open_: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over the hashes of shingles that texts of several components share."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << OPEN_BITS, bool)
        for batch in batches:
            bits[_place(batch.column("key").to_numpy())] = True
        packed = np.packbits(bits, bitorder="little")
        used = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(packed[used].astype(np.int32))], ["at", "byte"])

    found = open_.select("key").mapInArrow(stage, "at int, byte int").groupBy("at").agg(F.bit_or("byte").alias("byte")).toArrow()      # a row per byte of the bitmap
    out = np.zeros(1 << (OPEN_BITS - 3), np.uint8)
    out[found.column("at").to_numpy()] = found.column("byte").to_numpy()
    return out


def _across(nodes: DataFrame, share: int) -> DataFrame:
    """Pairs of nodes of different labels under any shingle of both prefixes."""
    keys = nodes.select("label", F.explode("keys").alias("key"))
    open_ = cut(keys.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key"))
    bits = _open_bits(open_)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("keys")
            key = lists.flatten().to_numpy()
            length = lists.value_lengths().to_numpy()
            ends = np.cumsum(length)
            pos = np.arange(len(key)) - np.repeat(ends - length, length)
            at = _place(key)
            may = np.flatnonzero((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
            row = np.repeat(np.arange(len(length)), length)[may]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), pa.array(key[may]), pa.array(pos[may].astype(np.int32))], ["id", "key", "pos"])

    # shingles that the bitmap lets pass are few beside all; the join leaves the open ones alone
    rows = nodes.select("id", "keys").mapInArrow(stage, "id long, key long, pos int").join(open_, "key")
    live = cut(rows.join(nodes.select("id", "n", "label", *_BITS), "id"))
    return live.join(_marked(live), (F.col("key") == F.col("_key")) & (F.col("id") < F.col("_id")) & _fits(share))


def node_labels(docs: DataFrame, id_col: str, text_col: str, k: int, share: int) -> tuple[DataFrame, DataFrame]:
    """((id, n, digest) per row, (digest, n, label) per distinct set that has shingles)."""
    texts = _plain(docs, id_col, text_col)
    surveyed = cut(_surveyed(texts, k))
    rows = surveyed.filter("digest IS NOT NULL").drop("counter", "times")
    pairs = surveyed.filter("counter IS NOT NULL").select(F.explode(F.arrays_zip("counter", "times")).alias("x"))
    counted = pairs.groupBy(F.col("x.counter").alias("at")).agg(F.sum("x.times").alias("n")).toArrow()
    counters = np.zeros(1 << SKETCH_BITS, np.int64)
    counters[counted.column("at").to_numpy()] = counted.column("n").to_numpy()
    named = rows.filter("n > 0 AND id IS NOT NULL")
    known = texts.filter("id IS NOT NULL")
    sets = named.groupBy("digest", "n").agg(F.min("id").alias("id"), *(F.min(x).alias(x) for x in _BITS))
    nodes = cut(sets.join(_prefixes(known, k, share, counters).dropDuplicates(["id", "digest"]), ["id", "digest"]))
    links = _verified(_stars(nodes, share), known, k, share)
    first = _around(links).withColumnRenamed("node", "id")
    once = first.groupBy("id").agg(F.min("label").alias("label"))                # one by one already; lets the planner drop the join where no label is read
    joined = nodes.join(F.broadcast(once) if _few(links, 2) else once, "id", "left").withColumn("label", F.coalesce("label", "id"))
    more = _verified(_near(_distinct_pairs(_across(joined, share), share), known, k, share), known, k, share)
    labels = _smallest(links.union(more)).withColumnRenamed("node", "id")
    return rows.select("id", "n", "digest"), nodes.join(labels, "id", "left").select("digest", F.coalesce("label", "id").alias("label"))


def components_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, share: int = 85) -> DataFrame:
    """(id, n_shingles, component_id) for every row."""
    rows, of_node = node_labels(docs, id_col, text_col, k, share)
    out = rows.join(of_node, "digest", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("label", "id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, share: int = 85) -> DataFrame:
    """One row of each component: that of its smallest id (texts without shingles and rows with a null id all stay)."""
    found = components_of(docs, id_col, text_col, k, share)
    name = unused(docs.columns, "_gone")[0]
    gone = cut(found.filter(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias(name)).distinct())
    return docs.join(_small(gone), F.col(id_col) == F.col(name), "left_anti")
