import zlib
from collections import Counter
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from specmap.llm import token_files as tf

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def expected(rows):
    """(doc_id, start, n_tokens, crc) by the library, ids ascending; rows: (doc_id, text), ids distinct."""
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def huffman_cost(counts):
    heap = [c for c in counts if c]
    heapify(heap)
    total = 0
    while len(heap) > 1:
        both = heappop(heap) + heappop(heap)
        total += both
        heappush(heap, both)
    return total


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=2, max_size=60).filter(lambda x: sum(map(bool, x)) > 1))
def test_lengths_are_optimal_and_decodable(counts):
    counts = np.array(counts)
    bits = tf.code_lengths(counts, 24)
    assert sum(2.0 ** -int(b) for b in bits if b) == 1 and ((bits > 0) == (counts > 0)).all()
    assert int((bits * counts).sum()) == huffman_cost(counts.tolist())


def limited_cost(counts, limit):
    """The least cost of any code of at most `limit` bits, by search over how many codes each length has."""
    w = sorted((c for c in counts if c), reverse=True)
    best = {(0, 1): 0}
    for depth in range(1, limit + 1):
        after = {}
        for (done, free), cost in best.items():
            free = min(2 * free, 2 * len(w))
            for take in range(min(free, len(w) - done) + 1):
                key = (done + take, free - take)
                spent = cost + depth * sum(w[done : done + take])
                if spent < after.get(key, spent + 1):
                    after[key] = spent
        best = after
    return min(cost for (done, _), cost in best.items() if done == len(w))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 10**5), min_size=2, max_size=9), st.integers(0, 2))
def test_limited_lengths_cost_least(counts, more):
    limit = (len(counts) - 1).bit_length() + more
    bits = tf.code_lengths(np.array(counts), limit)
    assert bits.max() <= limit and sum(2.0 ** -int(b) for b in bits) <= 1
    assert int((bits * np.array(counts)).sum()) == limited_cost(counts, limit)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), min_size=1, max_size=70), min_size=1, max_size=12), st.integers(1, 9))
def test_packed_documents_come_back(docs, step):
    tf.STEP, kept = step, tf.STEP
    try:
        ids, counts = np.concatenate(docs).astype(np.uint32), np.array([len(d) for d in docs])
        bits = tf.code_lengths(np.bincount(ids), 7)
        payload, first, marks, lanes = tf.pack(ids, counts, bits, tf.canonical(bits)[0])
        assert len(marks) == lanes.sum()
        assert (tf.Decoder(bits)(payload, first, counts, marks) == ids).all()
    finally:
        tf.STEP = kept


def test_hard_texts(texts, monkeypatch):
    hard = ["", " ", "a  b", "it's a dog's  life", "x<|endoftext|> y <|endoftext|>z", "a  b  c", "1 a 2 b", "\x1c a\x1d b", "é ß 中文 字 🙂 a", "end. Next, (one) two\n three\t four", "a\n b", "w " * 3000, "tab\t a", " lead", "trail ", "a\u3000 b", "\nline x", "a \u0085b"]
    hard += ["x" * 5000, " " * 3000 + "a", "é" * 900 + "<|endoftext|>", "<|endoftext", "I'LL i'll 'S's", "a\u2009 b \u2028c é è € 中 x\u00a0 y", *list(texts.values())[:50]]
    monkeypatch.setattr(tf, "COMPARED", 0)
    encode = tf.Encoder(PATH)
    ids, counts = encode(pa.array(hard), 2)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    assert encode._fast is not None
    assert [p.tolist() for p in parts] == [[*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2] for t in hard]


def test_forgetting_changes_nothing(texts, monkeypatch):
    monkeypatch.setattr(tf, "REMEMBERED", 5)
    encode = tf.Encoder(PATH)
    for text in list(texts.values())[:40]:
        assert encode(pa.array([text or ""]), 2)[0].tolist() == [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


def test_other_files_use_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    encode, library = tf.Encoder(path), Tokenizer.from_file(path)
    library.no_truncation()
    assert encode._fast is None
    assert encode(pa.array(["Some text, twice.", ""]), 7)[0].tolist() == [*library.encode("Some text, twice.", add_special_tokens=False).ids, 7, 7]


def test_a_difference_brings_the_library_back():
    encode = tf.Encoder(PATH)
    encode._fast = lambda unit: [0]
    assert encode(pa.array(["one two"]), 2)[0].tolist() == [*LIBRARY.encode("one two", add_special_tokens=False).ids, 2] and encode._fast is None


def test_whole_table(spark, docs, texts):
    found = [tuple(r) for r in tf.digests(docs, PATH).collect()]
    assert sorted(found) == expected(texts.items())


def test_files(spark, docs, texts, tmp_path):
    tf.write(docs, PATH, f"{tmp_path}/out", 2)
    blocks = spark.read.parquet(f"{tmp_path}/out/blocks")
    stored = blocks.agg(F.sum(F.octet_length("payload"))).first()[0]
    ids = Counter(i for t in texts.values() for i in [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2])
    assert stored < 1.02 * huffman_cost(ids.values()) / 8 + len(texts)
    order = [i for r in blocks.orderBy("shard", "before").collect() for i in r.doc_ids]
    assert order == sorted(order)
    back = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in tf.read(spark, f"{tmp_path}/out").collect()}
    assert back == {i: [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts.items()}
    with pytest.raises(Exception, match="(?i)exist"):
        tf.write(docs, PATH, f"{tmp_path}/out", 2)


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = expected(list(dict.fromkeys(rows)))
    found = tf.digests(odd, PATH).collect()
    assert len(found) == len(rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == Counter((i, n, c) for i, t in rows for j, _, n, c in want if i == j)
    starts = sorted((r.start, r.n_tokens) for r in found)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
    assert [r.doc_id for r in sorted(found, key=lambda r: r.start)][0] is None
    assert tf.digests(none, PATH).collect() == []


def test_hot_ids_are_spread(spark, tmp_path):
    docs = spark.range(900).select(F.when(F.col("id") % 3 > 0, F.lit(5)).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    tf.write(docs, PATH, f"{tmp_path}/hot", 2)
    sizes = spark.read.parquet(f"{tmp_path}/hot/blocks").groupBy("shard").agg(F.sum(F.size("doc_ids")).alias("n")).toPandas()
    assert sizes.n.max() < 300 and sizes.n.sum() == 900
    found = sorted(tf.read(spark, f"{tmp_path}/hot").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted(r.doc_id for r in found)
