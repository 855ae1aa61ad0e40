"""Token ids of whole texts in files: canonical Huffman codes of limited length, blocks that are decoded by table.

`write` encodes every text, appends an end id, and writes two Parquet tables into a folder:

* `codes` (id, bits): the length of each used id's code. Lengths come from the counts of ids over all texts, by the
  package-merge method, so that no code has more than `limit` bits; codes are canonical, so lengths are all there is.
* `blocks` (shard, before, doc_ids, counts, starts, marks, payload): runs of whole documents in ascending id order. A
  document's bits start at the byte `starts` of the payload; `marks` has the bit offset of every `STEP`-th id, so that
  a block is decoded from all marks at once, and a document from any of them.

`read` gives every document back, with the number of ids before it. Blocks need nothing but the codes to be decoded.

Documents are dealt to shards by quantiles of their ids; equal ids (and null ones, which come first) are spread over all
shards that hold the id, by a hash of the text, so a hot id is no hot shard. Texts are encoded once, into a table beside
the files (`ids`, in two bytes an id where that is enough); counting and coding read it, and only coded bits are shuffled.

Cases: a null text counts as empty and has the end id alone; equal ids are ordered by a hash of their text, repeated rows
each have their place; an empty table writes and reads an empty one; a folder that exists raises an error; other columns
of the input are ignored.
"""
from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specmap.llm.tokens import byte_runs
from specmap.session import ensure_checkpoint_dir

#: Most bits of a code (more where the number of ids needs it).
LIMIT = 16
#: Ids between two marks.
STEP = 1024
#: Ids in a block at least, unless a shard ends.
BLOCK_IDS = 1 << 16
#: Bytes of text, and of payload, that are worked on at once.
RUN = 1 << 22
#: Bytes of ids that are counted or coded at once.
CODED = 1 << 20
#: Most shards; the quantiles of the ids are one list of so many numbers.
SHARDS = 10_000

#: How byte-level vocabularies cut texts (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts that a worker encodes twice to compare both libraries.
COMPARED = 20
#: Characters of a unit from which the library encodes it.
LONG = 400
#: Units remembered in a Python worker.
REMEMBERED = 500_000
#: ASCII white space, and the controls that only some take for it.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True


class Encoder:
    """Ids of texts as the tokenizers library gives them for one of its files.

    A byte-level vocabulary with the usual pattern starts a token at every single space between visible characters.
    Texts are cut there into units, which are numbered by Arrow, and a unit that a worker has seen is not encoded again.
    New units go to tiktoken, with ranks made from the same file, for the library spends most of its time on what only
    offsets need; units with a long run, and files of any other kind, are encoded by the library itself. Each worker
    compares both on its first texts, and stays with the library if they ever differ.
    """

    _of: dict[str, "Encoder"] = {}

    @classmethod
    def of(cls, path: str) -> "Encoder":
        """The worker's encoder of this file."""
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._model = Tokenizer.from_file(path)
        self._model.no_truncation()
        self._model.no_padding()
        self._fast = self._ranked(path)
        self._compare = 0 if self._fast is None else COMPARED
        self._forget()

    def _ranked(self, path: str):
        """The same vocabulary in tiktoken, if the file is plain byte-level BPE whose ids are its merge ranks."""
        import tiktoken

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        kind, split = said["model"], said.get("pre_tokenizer") or {}
        plain = kind.get("type") == "BPE" and not kind.get("dropout") and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not said.get("normalizer")
        added = said.get("added_tokens", [])
        special = {x["content"]: x["id"] for x in added}
        if not plain or any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or " " in x["content"] for x in added):
            return None
        # printable bytes stand for themselves, the others for the characters from 256 on, in order
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in kind["vocab"].items() if token not in special}
        fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        names, ordinary = list(special), fast._core_bpe.encode_ordinary

        def encode(unit: str) -> list[int]:
            if any(x in unit for x in names):
                return fast.encode(unit, allowed_special="all")
            return ordinary(unit)

        return encode

    def _forget(self) -> None:
        self._known: dict[str, int] = {}
        self._ids = np.zeros(1 << 16, np.uint32)
        self._ends = np.zeros(1 << 12, np.int64)

    def _slow(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self._model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        fast = self._fast
        for lo in range(0, len(new), 1 << 14):
            part = new[lo : lo + (1 << 14)]
            found = [None if len(x) >= LONG else fast(x) for x in part]
            slow = [i for i, x in enumerate(found) if x is None]
            for i, x in zip(slow, self._slow([part[i] for i in slow]), strict=True):
                found[i] = x
            ids = np.fromiter(chain.from_iterable(found), np.uint32)
            at = len(self._known)
            first = int(self._ends[at])
            while len(self._ids) < first + len(ids):
                self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
            while len(self._ends) < at + len(part) + 1:
                self._ends = np.concatenate([self._ends, np.zeros_like(self._ends)])
            self._ids[first : first + len(ids)] = ids
            self._ends[at + 1 : at + len(part) + 1] = first + np.cumsum([len(x) for x in found])
            self._known.update(zip(part, range(at, at + len(part)), strict=True))

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, and how many each text has."""
        if self._compare > 0 and self._fast is not None and len(texts):
            first = texts.slice(0, self._compare)
            self._compare -= len(first)
            ids, counts = self._by_units(first, end_id)
            if ids.tolist() != [i for x in self._slow(first.to_pylist()) for i in (*x, end_id)]:
                self._fast = None
        if self._fast is not None:
            return self._by_units(texts, end_id)
        found = self._slow(texts.to_pylist())
        return np.array([i for x in found for i in (*x, end_id)], np.uint32), np.array([len(x) + 1 for x in found], np.int64)

    def _by_units(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._known) > REMEMBERED:
            self._forget()
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        starts = np.zeros(len(data) + 1, bool)
        starts[unit_starts(data)] = True
        starts[offsets[:-1]] = True
        begin = np.flatnonzero(starts[:-1])
        units = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(np.append(begin, len(data))), pa.py_buffer(data)]).dictionary_encode()
        distinct = units.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn([x for x in distinct if x not in self._known])
        at = np.fromiter(map(self._known.__getitem__, distinct), np.int64, len(distinct))[units.indices.to_numpy()]
        first, length = self._ends[at], self._ends[at + 1] - self._ends[at]
        ends = np.cumsum(length)
        flat = np.repeat(first - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
        last = np.concatenate([[0], ends])[np.searchsorted(begin, offsets[1:])]
        return np.insert(self._ids[flat], last, end_id), np.diff(last, prepend=0) + 1


def unit_starts(data: np.ndarray) -> np.ndarray:
    """The single spaces between characters that are no white space under any reading; a longer character with a byte of
    some white space in it counts as white space, which only makes a unit longer."""
    space = np.flatnonzero(data == 0x20)
    space = space[(space > 0) & (space < len(data) - 1)]
    padded = np.concatenate([np.zeros(3, np.uint8), data, np.zeros(2, np.uint8)])
    back = [padded[space + 3 - i] for i in range(4)]
    ahead = [padded[space + 3 + i] for i in range(3)]
    wide = lambda lead, second: np.isin(lead, (0xE1, 0xE2, 0xE3)) & np.isin(second, (0x80, 0x81, 0x9A))
    before = _BLANK[back[1]] | (back[2] == 0xC2) | wide(back[3], back[2])
    after = _BLANK[ahead[1]] | (ahead[1] == 0xC2) | wide(ahead[1], ahead[2])
    return space[~(before | after)]


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits per id, 0 for unused ones: the best code of at most `limit` bits, by package-merge."""
    used = np.flatnonzero(counts)
    n = len(used)
    bits = np.zeros(len(counts), np.uint8)
    if n < 2:
        bits[used] = 1
        return bits
    limit = max(limit, (n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    own, packages = [], np.zeros(0)
    for _ in range(limit):
        is_own, merged = _merged(weight, packages)
        own.append(is_own)
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * n - 2
    for is_own in reversed(own):
        mine = int(is_own[:take].sum())
        bits[order[:mine]] += 1
        take = 2 * (take - mine)
    return bits


def _merged(weight: np.ndarray, packages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.concatenate([weight, packages])
    order = np.argsort(both, kind="stable")
    return order < len(weight), both[order]


def canonical(bits: np.ndarray) -> tuple[np.ndarray, int]:
    """The code of each id, by length and then id, and the longest length."""
    order = np.lexsort((np.arange(len(bits)), bits))
    order = order[bits[order] > 0]
    longest = int(bits.max()) if len(order) else 0
    span = np.uint64(1) << (longest - bits[order].astype(np.int64)).astype(np.uint64)
    codes = np.zeros(len(bits), np.uint64)
    codes[order] = (np.cumsum(span) - span) >> (longest - bits[order].astype(np.int64)).astype(np.uint64)
    return codes, longest


def pack(ids: np.ndarray, counts: np.ndarray, bits: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(payload, first byte of each document, marks of all documents, marks per document)."""
    length = bits[ids].astype(np.int64)
    ends = np.cumsum(length)
    doc_ends = np.cumsum(counts)
    at_end = ends[doc_ends - 1]
    size = -(-np.diff(at_end, prepend=0) // 8)
    first = np.cumsum(size) - size
    shift = 8 * first - (at_end - np.diff(at_end, prepend=0))
    at = ends - length + np.repeat(shift, counts)
    words = np.zeros(int(size.sum()) // 8 + 2, np.uint64)
    place = at >> 6
    room = 64 - (at & 63) - length                                            # below zero: the rest goes to the next word
    code = codes[ids]
    over = np.flatnonzero(room < 0)
    part = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
    starts = np.flatnonzero(np.diff(place, prepend=-1))
    words[place[starts]] = np.bitwise_or.reduceat(part, starts)
    words[place[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    payload = words.byteswap().view(np.uint8)[: int(size.sum())]
    within = np.arange(len(ids)) - np.repeat(doc_ends - counts, counts)
    marked = np.flatnonzero(within % STEP == 0)
    marks = at[marked] - 8 * np.repeat(first, counts)[marked]
    return payload, first, marks, -(-counts // STEP)


class Decoder:
    """Ids from packed documents, one table look-up per id, all marks of many documents side by side."""

    def __init__(self, bits: np.ndarray):
        codes, self.longest = canonical(bits)
        used = np.flatnonzero(bits)
        used = used[np.lexsort((used, bits[used]))]
        times = 1 << (self.longest - bits[used].astype(np.int64))
        self.symbol = np.repeat(used.astype(np.uint32), times)
        self.length = np.repeat(bits[used].astype(np.int64), times)
        missing = (1 << self.longest) - len(self.symbol)
        if missing > 0:                                                       # one id alone: half of the table
            self.symbol = np.append(self.symbol, np.zeros(missing, np.uint32))
            self.length = np.append(self.length, np.ones(missing, np.int64))

    def __call__(self, payload: np.ndarray, first: np.ndarray, counts: np.ndarray, marks: np.ndarray) -> np.ndarray:
        b = np.zeros(len(payload) + 4, np.uint32)
        b[: len(payload)] = payload
        window = (b[:-3] << np.uint32(24)) | (b[1:-2] << np.uint32(16)) | (b[2:-1] << np.uint32(8)) | b[3:]
        lanes = -(-counts // STEP)
        number = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        left = np.minimum(STEP, np.repeat(counts, lanes) - STEP * number)
        position = 8 * np.repeat(first, lanes) + marks
        target = np.repeat(np.cumsum(counts) - counts, lanes) + STEP * number
        order = np.argsort(-left, kind="stable")
        position, target, left = position[order], target[order], left[order]
        out = np.zeros(int(counts.sum()), np.uint32)
        alive = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")
        top = 32 - self.longest
        for step, n in enumerate(alive.tolist()):
            at = position[:n]
            peek = (window[at >> 3] << (at & 7).astype(np.uint32)) >> np.uint32(top)
            out[target[:n] + step] = self.symbol[peek]
            position[:n] = at + self.length[peek]
        return out


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tie, n, width, ids): the ids of every text, in `width` little-endian bytes each; `tie` is a hash of the text."""
    names = ["id", "tie", "n", "width", "ids"]

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            for rows, texts in byte_runs(batch, pc.fill_null(batch.column("text"), ""), RUN):
                ids, counts = encoder(texts, end_id)
                width = 2 if ids.max(initial=0) < 1 << 16 else 4
                data = ids.astype(f"<u{width}")
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("tie"), pa.array(counts), pa.array(np.full(len(counts), width, np.int32)), _cells(data, np.cumsum(counts) * width)], names)

    return _plain(docs, id_col, text_col).withColumn("tie", F.xxhash64("text")).mapInArrow(stage, "id long, tie long, n long, width int, ids binary")


def _cells(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Consecutive runs of bytes as binary values."""
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int64)).buffers()[1]
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, offsets, pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _ids_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of rows of `encode` and their ids."""
    for rows, cells in byte_runs(batch, batch.column("ids"), CODED):
        width = rows.column("width").to_numpy()
        parts = cells.to_pylist()
        if (width == width[0]).all():
            yield rows, np.frombuffer(b"".join(parts), f"<u{width[0]}").astype(np.uint32)
        else:
            yield rows, np.concatenate([np.frombuffer(x, f"<u{w}").astype(np.uint32) for x, w in zip(parts, width.tolist(), strict=True)])


def id_counts(encoded: DataFrame) -> np.ndarray:
    """How often each id occurs in the rows of `encode`; as long as the vocabulary."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for _, ids in _ids_of(batch):
                n = np.bincount(ids, minlength=len(total))
                n[: len(total)] += total
                total = n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["token", "n"])

    found = encoded.select("width", "ids").mapInArrow(stage, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    token, n = found.column("token").to_numpy(), found.column("n").to_numpy()
    counts = np.zeros(int(token.max()) + 1 if len(token) else 1, np.int64)
    counts[token] = n
    return counts


def write(docs: DataFrame, path: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> None:
    """Write the ids of all texts, encoded with the tokenizer file `path`, into the tables of `folder`."""
    spark = docs.sparkSession
    encode(docs, path, end_id, id_col, text_col).write.option("compression", "zstd").parquet(f"{folder}/ids")
    encoded = spark.read.parquet(f"{folder}/ids")
    bits = code_lengths(id_counts(encoded), limit)
    codes, longest = canonical(bits)
    if longest > 24:
        raise ValueError("codes of more than 24 bits")
    used = np.flatnonzero(bits)
    spark.createDataFrame(pa.table({"id": used, "bits": bits[used].astype(np.int32)})).coalesce(1).write.parquet(f"{folder}/codes")
    shards = min(SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    key = F.coalesce("id", F.lit(-(2**63)))
    steps = [i / shards for i in range(1, shards)]
    edges = encoded.agg(F.percentile_approx(key, steps, 10 * SHARDS)).first()[0] if steps else []
    edges = np.array(edges or [], np.int64)
    names = ["id", "tie", "shard", "n", "marks", "payload"]

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, ids in _ids_of(batch):
                counts = rows.column("n").to_numpy()
                payload, first, marks, lanes = pack(ids, counts, bits, codes)
                own, tie = pc.fill_null(rows.column("id"), -(2**63)).to_numpy(), rows.column("tie").to_numpy()
                low, high = np.searchsorted(edges, own, "left"), np.searchsorted(edges, own, "right")
                shard = low + (tie.view(np.uint64) % (high - low + 1).astype(np.uint64)).astype(np.int64)
                ends = pa.array(np.concatenate([[0], np.cumsum(lanes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("tie"), pa.array(shard.astype(np.int32)), pa.array(counts), pa.ListArray.from_arrays(ends, pa.array(marks)), _cells(payload, np.append(first[1:], len(payload)))], names)

    coded = encoded.mapInArrow(stage, "id long, tie long, shard int, n long, marks array<long>, payload binary")
    dealt = coded.repartitionById(shards, "shard").sortWithinPartitions(F.col("id").asc_nulls_first(), "tie")
    dealt.mapInArrow(_blocks, BLOCK_SCHEMA).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


_LIST = pa.list_(pa.int64())
_BLOCK = {"shard": pa.int32(), "before": pa.int64(), "doc_ids": _LIST, "counts": _LIST, "starts": _LIST, "marks": _LIST, "payload": pa.binary()}
BLOCK_SCHEMA = "shard int, before long, doc_ids array<long>, counts array<long>, starts array<long>, marks array<long>, payload binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of whole documents with BLOCK_IDS ids or more, from the documents of one shard in order; `before` counts the
    ids of the shard before the block."""
    held: list[pa.RecordBatch] = []
    before = 0

    def flush() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        size = pc.binary_length(rows["payload"]).cast(pa.int64()).to_numpy()
        block = {"shard": rows["shard"][0].as_py(), "before": before, "doc_ids": rows["id"].to_pylist(), "counts": rows["n"].to_numpy(), "starts": np.cumsum(size) - size,
                 "marks": pc.list_flatten(rows["marks"]).to_numpy(), "payload": b"".join(rows["payload"].to_pylist())}
        return pa.RecordBatch.from_arrays([pa.array([block[k]], kind) for k, kind in _BLOCK.items()], list(_BLOCK))

    have = 0
    for batch in batches:
        lo = 0
        for i, n in enumerate(batch.column("n").to_pylist()):
            have += n
            if have >= BLOCK_IDS:
                held.append(batch.slice(lo, i + 1 - lo))
                yield flush()
                before, have, lo = before + have, 0, i + 1
        if lo < batch.num_rows:
            held.append(batch.slice(lo))
    if held:
        yield flush()


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; ids are little-endian unsigned 32-bit integers, start counts the
    ids of all documents before it."""
    stored = spark.read.parquet(f"{folder}/codes").toArrow()                  # a row for each id of the vocabulary
    used = stored.column("id").to_numpy()
    bits = np.zeros(int(used.max()) + 1 if len(used) else 1, np.uint8)
    bits[used] = stored.column("bits").to_numpy()
    blocks = spark.read.parquet(f"{folder}/blocks")
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)
    sizes = blocks.groupBy("shard").agg(F.sum(total).alias("n")).toArrow()    # a row for each shard, at most SHARDS
    per_shard = np.zeros(SHARDS + 1, np.int64)
    per_shard[sizes.column("shard").to_numpy() + 1] = sizes.column("n").to_numpy()
    begin = np.cumsum(per_shard)
    names = ["doc_id", "start", "n_tokens", "ids"]

    def flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
        return pc.list_flatten(batch.column(name)).to_numpy(zero_copy_only=False)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(bits)
        for batch in batches:
            for rows, _ in byte_runs(batch, batch.column("payload"), RUN):
                sizes, docs = pc.binary_length(rows.column("payload")).to_numpy().astype(np.int64), pc.list_value_length(rows.column("counts")).to_numpy()
                payload = np.frombuffer(b"".join(rows.column("payload").to_pylist()), np.uint8)
                counts = flat(rows, "counts")
                first = flat(rows, "starts") + np.repeat(np.cumsum(sizes) - sizes, docs)
                ids = decode(payload, first, counts, flat(rows, "marks"))
                ends = np.cumsum(counts)
                block_first = np.concatenate([[0], ends])[np.cumsum(docs) - docs]
                own = begin[rows.column("shard").to_numpy()] + rows.column("before").to_numpy() - block_first
                start = ends - counts + np.repeat(own, docs)
                yield pa.RecordBatch.from_arrays([pc.list_flatten(rows.column("doc_ids")), pa.array(start), pa.array(counts), _cells(ids.astype("<u4", copy=False), 4 * ends)], names)

    return blocks.mapInArrow(stage, "doc_id long, start long, n_tokens long, ids binary")


def digests(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every text, as read back from files in the session's shared folder."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/token-files-{uuid.uuid4().hex}"
    write(docs, path, folder, end_id)
    return read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
