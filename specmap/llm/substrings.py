"""Substring deduplication by window hashes in distributed reference blocks.

Every window of 20 consecutive words whose sequence also starts earlier in the corpus (smaller id, or the same document
further left) is a duplicate, and every word it covers goes. The search works on pieces:

* A piece is a run of windows with the same anchor: the word 8-gram that comes first, among the thirteen in a window, in
  an order of rare before frequent. Equal windows have equal anchors, so all occurrences of a window meet in one block.
  How frequent 8-grams are is counted over all texts in 65,536 counters; common lines are therefore never the anchor of
  windows that also hold other words, and no block fills up with them.
* The reference blocks are the groups of one anchor. In a block, pieces come in corpus order and every window is
  tested by its hash against all windows before it: runs of windows that stand earlier are the factors. Neighbouring
  windows of a factor may stand in different documents; no reference position is kept.
* Equal pieces of a slice of the input are collapsed before the shuffle: all but the first are duplicates already, so a
  passage that a third of all documents share reaches its block once per slice.

Windows are compared by two 64-bit hashes, of the anchor and of all twenty words.

Cases: null and empty texts have no words; texts of fewer than 20 words lose none; documents with a null id come last, in
no order among themselves, and are the earlier occurrence for nobody (a hash of their text tells them apart: equal texts
lose the same words); rows that repeat an id are the same document, and
equal starts in it are not earlier than each other; an empty table gives an empty one; other columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specmap.llm.words import Words, mix, slices, whole_windows, window_hash
from specmap.session import cut

WINDOW = 20
ANCHOR = 8
SKETCH_BITS = 16
#: Bytes of text in which equal pieces are collapsed.
SLICE = 1 << 21
#: Rows of a block's windows that are factored in one go.
WINDOWS_AT_ONCE = 1 << 20
#: Spans are broadcast up to so many documents and limits together; beyond, both sides are shuffled.
BROADCAST_NUMBERS = 1_000_000
_LAST = 2**63 - 1


def _ordered(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows by id, null as the last."""
    ids = pc.fill_null(batch.column("id"), _LAST)
    return pa.RecordBatch.from_arrays([ids, batch.column("key"), batch.column("text")], ["id", "key", "text"]).take(pc.array_sort_indices(ids))


def _frequencies(texts: DataFrame, anchor: int, window: int) -> np.ndarray:
    """Level (binary logarithm) of each counter of anchor hashes, over all texts."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for _, data, offsets in slices(batch, "text"):
                w = Words(data, offsets)
                g = window_hash(w.hashes, anchor, seed=anchor)
                g = g[whole_windows(w.first, w.counts, anchor, len(g))]
                total += np.bincount((g >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], ["counters"])

    counted = texts.select("text").mapInArrow(stage, "counters array<long>").select(F.posexplode("counters").alias("at", "n"))
    out = np.zeros(1 << SKETCH_BITS)
    table = counted.groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out[table.column("at").to_numpy()] = table.column("n").to_numpy()
    return np.log2(out + 1).astype(np.uint64)


def _pieces(w: Words, levels: np.ndarray, anchor: int, window: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, first window, number of windows) of each piece, and the hash of every window."""
    h = w.hashes
    n = len(h) - window + 1
    whole = np.flatnonzero(whole_windows(w.first, w.counts, window, n))
    if not len(whole):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none.astype(np.uint64)
    g = window_hash(h, anchor, seed=anchor)
    rank = (levels[(g >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] << np.uint64(58)) | (g >> np.uint64(6))
    best, at = rank[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window - anchor + 1):
        here = rank[j : j + n]
        less = here < best
        at[less] = j
        np.minimum(best, here, out=best)
    place = whole + at[whole]
    fresh = np.ones(len(whole), bool)
    fresh[1:] = (np.diff(whole) != 1) | (np.diff(place) != 0)
    begin = np.flatnonzero(fresh)
    return g[place[begin]], whole[begin], np.diff(np.append(begin, len(whole))), window_hash(h, window, seed=window)


def _piece_rows(texts: DataFrame, levels: np.ndarray, anchor: int, window: int) -> DataFrame:
    """Pieces for the blocks (`hashes` of their windows), and spans that a slice itself shows to be duplicates (null)."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(_ordered(batch), "text", SLICE):
                ids, keys = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("id", "key"))
                w = Words(data, offsets)
                block, first, count, hashes = _pieces(w, levels, anchor, window)
                if not len(block):
                    continue
                text = np.searchsorted(w.first, first, "right") - 1
                doc, key, place = ids[text], keys[text], (first - w.first[text]).astype(np.int32)
                # the first and the last window of a piece hold all its words
                content = mix(hashes[first] ^ mix(hashes[first + count - 1] + mix(block + count.astype(np.uint64))))
                order = np.argsort(content, kind="stable")
                lead = np.ones(len(order), bool)
                lead[1:] = content[order][1:] != content[order][:-1]
                head = np.empty(len(order), np.int64)
                head[order] = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]
                sent = head == np.arange(len(order))
                other = (doc != doc[head]) | (key != key[head]) | (place != place[head])
                sent |= other & (doc[head] == _LAST)
                later = ~sent & other
                sizes = count[sent]
                ends = np.concatenate([[0], np.cumsum(sizes)])
                inside = np.arange(ends[-1]) - np.repeat(ends[:-1], sizes) + np.repeat(first[sent], sizes)
                packed = pa.Array.from_buffers(pa.binary(), int(sent.sum()), [None, pa.py_buffer((ends * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(hashes[inside]))])
                names = ["block", "doc", "key", "place", "count", "hashes"]
                yield pa.RecordBatch.from_arrays([pa.array(block[sent].view(np.int64)), pa.array(doc[sent]), pa.array(key[sent]), pa.array(place[sent]), pa.array(sizes.astype(np.int32)), packed], names)
                if later.any():
                    spread = mix((doc[later] ^ key[later]).view(np.uint64)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(doc[later]), pa.array(key[later]), pa.array(place[later]), pa.array(count[later].astype(np.int32)), pa.nulls(int(later.sum()), pa.binary())], names)

    return texts.mapInArrow(stage, "block long, doc long, key long, place int, count int, hashes binary")


def _factored(blocks: np.ndarray, doc: np.ndarray, keys: np.ndarray, place: np.ndarray, count: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Factors (doc, key, place, count): runs of windows that stand earlier in their block. Rows come by block, doc, place."""
    row = np.repeat(np.arange(len(count)), count)
    ends = np.cumsum(count)
    inside = np.arange(len(row)) - np.repeat(ends - count, count)
    key = mix(hashes ^ mix(blocks[row].view(np.uint64)))
    order = np.argsort(key, kind="stable")
    lead = np.ones(len(order), bool)
    lead[1:] = key[order][1:] != key[order][:-1]
    head = np.empty(len(order), np.int64)
    head[order] = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]
    at_doc, at = doc[row], place[row] + inside
    again = (at_doc != at_doc[head]) | (at != at[head]) if len(row) else np.zeros(0, bool)
    again &= at_doc[head] != _LAST
    begins = again.copy()
    begins[1:] &= ~again[:-1] | (row[1:] != row[:-1])
    closes = again.copy()
    closes[:-1] &= ~again[1:] | (row[1:] != row[:-1])
    a, b = np.flatnonzero(begins), np.flatnonzero(closes)
    return at_doc[a], keys[row[a]], at[a], b - a + 1


def _factors(pieces: DataFrame) -> DataFrame:
    """(doc, key, place, count): all duplicate spans, in windows."""

    def out(doc: np.ndarray, key: np.ndarray, place: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), pa.array(key.astype(np.int64)), pa.array(place.astype(np.int32)), pa.array(count.astype(np.int32))], ["doc", "key", "place", "count"])

    def parsed(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows:
            packed = table.column("hashes").combine_chunks()
            if isinstance(packed, pa.ChunkedArray):
                packed = pa.concat_arrays(packed.chunks)
            col = lambda c: table.column(c).to_numpy()
            hashes = np.frombuffer(b"".join(packed.to_pylist()), np.uint64)
            yield out(*_factored(col("block"), col("doc"), col("key"), col("place").astype(np.int64), col("count").astype(np.int64), hashes))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        windows = 0
        for batch in batches:
            known = batch.filter(pc.is_null(batch.column("hashes")))
            if known.num_rows:
                yield out(*(known.column(c).to_numpy() for c in ("doc", "key", "place", "count")))
            batch = batch.filter(pc.is_valid(batch.column("hashes")))
            if not batch.num_rows:
                continue
            held.append(batch)
            windows += pc.sum(batch.column("count")).as_py()
            if windows >= WINDOWS_AT_ONCE:
                # whole blocks only: the last one may go on in the next batch
                table = pa.Table.from_batches(held)
                block = table.column("block").to_numpy()
                done = int(np.searchsorted(block, block[-1]))
                yield from parsed(table.slice(0, done))
                held = table.slice(done).to_batches()
                windows = sum(pc.sum(b.column("count")).as_py() for b in held)
        if held:
            yield from parsed(pa.Table.from_batches(held))

    dealt = pieces.repartition("block").sortWithinPartitions("block", "doc", "place")
    return dealt.mapInArrow(stage, "doc long, key long, place int, count int")


def _covered(factors: DataFrame, window: int) -> DataFrame:
    """(doc, key, spans): the words that a document's factors cover, as ascending begin, end, begin, end …"""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for factors in batch.column("factors").to_pylist():
                spans: list[int] = []
                for f in sorted((x["place"], x["count"]) for x in factors):
                    begin, end = f[0], f[0] + f[1] + window - 1
                    if spans and begin <= spans[-1]:
                        spans[-1] = max(spans[-1], end)
                    else:
                        spans += [begin, end]
                out.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("key"), pa.array(out, pa.list_(pa.int32()))], ["doc", "key", "spans"])

    listed = factors.groupBy("doc", "key").agg(F.collect_set(F.struct("place", "count")).alias("factors"))
    return listed.mapInArrow(stage, "doc long, key long, spans array<int>")


def _kept(words: list[bytes], spans: list[int] | None) -> list[bytes]:
    if spans is None:
        return words
    kept: list[bytes] = []
    at = 0
    for begin, end in zip(spans[::2], spans[1::2], strict=True):
        kept += words[at:begin]
        at = end
    return kept + words[at:]


def _with_spans(docs: DataFrame, id_col: str, text_col: str, window: int, anchor: int) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("key", F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.lit(0)))
    levels = _frequencies(texts, anchor, window)
    factors = _factors(_piece_rows(texts, levels, anchor, window))
    spans = cut(_covered(factors, window))
    rows, numbers = spans.agg(F.count("*"), F.sum(F.size("spans"))).first()
    found = F.broadcast(spans) if rows + (numbers or 0) <= BROADCAST_NUMBERS else spans
    found = found.withColumnRenamed("key", "doc_key")
    return texts.join(found, (F.coalesce("id", F.lit(_LAST)) == F.col("doc")) & (F.col("key") == F.col("doc_key")), "left").select("id", "text", "spans")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(id, text): what is left of each text, its words joined by one space."""

    @F.pandas_udf("string")
    def rest(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([b" ".join(_kept((t or "").encode().split(), None if s is None else list(s))).decode() for t, s in zip(text, spans, strict=True)])

    found = _with_spans(docs, id_col, text_col, window, anchor)
    return found.select(F.col("id").alias(id_col), rest("text", "spans").alias(text_col))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) for every row."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, sha = [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                # bytes.split() cuts at ASCII white space only
                words = (text.as_py() or "").encode().split()
                kept = _kept(words, spans.as_py())
                n.append(len(words))
                gone.append(len(words) - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["id", "n_words", "n_removed", "kept_sha256"])

    found = _with_spans(docs, id_col, text_col, window, anchor)
    return found.mapInArrow(stage, "id long, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("id", id_col)
