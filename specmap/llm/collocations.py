"""Phrases of two to five words that are said together, per language: exact counts by direct-address tiles.

1. Texts become slices: the words of one language in a bounded run of text, as numbers into the slice's own vocabulary,
   with a mark wherever no phrase can go on. Slices are written once and everything after reads them.
2. Words that occur often enough are ranked by language and frequency; a word's rank is its id.
3. A phrase of m words is a pair: the id of its first m-1 words and the id of its last word. The plane of these pairs is
   cut into tiles of `TILE` x `TILE` ids. Frequent ids are neighbours, so frequent tiles are few: a task counts a tile
   with many occurrences by `bincount` into a dense array, all others as sorted coordinates (equal ones run-length
   counted), and Spark adds what tasks counted.
4. Pairs that occur often enough are ranked in the same way, and their ranks are the ids that the next length pairs
   with words. A phrase is counted only where its first and its last m-1 words are frequent themselves, which loses
   none, for a part is at least as frequent as the whole.
5. Each phrase is cut at every place; the place of the lowest score counts. Phrases inside a longer phrase that is about
   as frequent are dropped. The best of a language are chosen in two steps, so that no language is gathered.

Tables of ids are broadcast up to `BROADCAST` entries. Beyond, every slice asks for the distinct ones it needs by a join.

Cases: a null or empty text has no words; a null language counts as `und`; repeated rows count each; a phrase that occurs
twice in overlapping places counts twice; an empty table gives an empty one; other columns of the input are ignored.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specmap.functions.ranks import with_rank
from specmap.llm.words import LOWER
from specmap.session import cut, ensure_checkpoint_dir

#: Ids along each side of a tile.
TILE_BITS = 10
#: Occurrences in a batch from which a tile is counted densely.
DENSE = 1 << 17
#: Tiles whose sizes are counted directly.
GRID = 1 << 20
#: Pairs that a task counts at once.
PAIRS = 1 << 22
#: Pairs whose places are worked out at once.
PIECE = 1 << 18
#: Bytes of text in a slice.
SLICE = 1 << 21
#: Bytes of text that a task keeps for slices of several languages.
HELD = 1 << 24
#: Entries of an id table up to which it is broadcast.
BROADCAST = 1_000_000
#: Ids of words stay below 2**WORD_BITS, ids of phrases below 2**(62 - WORD_BITS).
WORD_BITS = 29
#: Parts in which the best phrases of a language are chosen first.
SALTS = 64

#: floor(1000 a n / (l r)) in 38 digits, for counts below 10**16.
SCORE = (
    "cast(cast(1000 as decimal(4,0)) * (cast(a as decimal(16,0)) * cast(n as decimal(16,0))) as decimal(38,0))"
    " div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))"
)

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = True
_SPACE = _BREAK.copy()
_SPACE[[0x20, 0x09]] = True


def _stored(df: DataFrame) -> DataFrame:
    """`df` as a compressed table in the session's shared folder."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/slices-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def slices_of(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(slice, lang, words, times, seq): the vocabulary of each slice, how often each word occurs, and the words of its
    texts in order as int32 numbers into the vocabulary, -1 between pieces."""
    plain = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text")).filter("text <> ''")
    names = ["slice", "lang", "words", "times", "seq"]
    kinds = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        held: dict[str, list] = {}
        size: dict[str, int] = {}

        def emit(lang: str) -> pa.RecordBatch:
            nonlocal made
            words, times, seq = _numbered(pa.concat_arrays(held.pop(lang)))
            size.pop(lang)
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((made, lang, words.to_pylist(), times, seq.tobytes()), kinds, strict=True)], names)

        for batch in batches:
            coded = batch.column("lang").dictionary_encode()
            which = coded.indices.to_numpy()
            for number, lang in enumerate(coded.dictionary.to_pylist()):
                mine = batch.column("text").filter(pa.array(which == number)).cast(pa.large_string())
                ends = np.cumsum(pc.binary_length(mine).to_numpy())
                lo, have = 0, size.get(lang, 0)
                while lo < len(mine):
                    base = ends[lo - 1] if lo else 0
                    hi = max(lo + 1, int(np.searchsorted(ends, base + SLICE - have, "right")))
                    held.setdefault(lang, []).append(mine.slice(lo, hi - lo))
                    size[lang] = have = have + int(ends[hi - 1] - base)
                    if have >= SLICE or hi < len(mine):
                        yield emit(lang)
                        have = 0
                    lo = hi
            while sum(size.values()) > HELD:
                yield emit(max(size, key=size.get))
        for lang in list(held):
            yield emit(lang)

    return plain.mapInArrow(stage, "slice long, lang string, words array<string>, times array<long>, seq binary")


def _numbered(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts, how often each occurs, and their sequence with -1 between pieces."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    inside = ~_SPACE[data]
    new_text = np.zeros(len(data) + 1, bool)
    new_text[offsets - offsets[0]] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | new_text[1:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int32)
    letters = data[inside]
    at = np.append((np.cumsum(inside) - 1)[starts], len(letters))
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(letters)])
    coded = words.dictionary_encode()
    number = coded.indices.to_numpy()
    ended = np.cumsum(_BREAK[data] | new_text[:-1])                            # a text's first byte opens a new piece too
    gaps = np.flatnonzero(np.diff(ended[starts]) > 0)
    seq = np.insert(number.astype(np.int32), gaps + 1, -1)
    return coded.dictionary.cast(pa.string()), np.bincount(number, minlength=len(coded.dictionary)), seq


def ranked(counts: DataFrame, order: list[str]) -> DataFrame:
    """`counts` with `id`: ranks by language, then frequency."""
    return with_rank(counts.withColumn("_less", -F.col("f")), ["lang", "_less", *order], "id").drop("_less")


def _code(p: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (p << np.int64(WORD_BITS)) | w


def _pairs(p: np.ndarray, w: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a phrase of `length` words can begin, and its code: p has the ids of the phrases of length - 1 that begin at
    each place, w those of words, -1 where there is none."""
    n = len(w) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero((p[:n] >= 0) & (p[1 : n + 1] >= 0) & (w[length - 1 :] >= 0))
    return at, _code(p[at], w[at + length - 1])


def _looked_up(codes: np.ndarray, known: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The ids of codes, -1 for unknown ones."""
    if not len(known):
        return np.full(len(codes), -1, np.int64)
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return np.where(known[at] == codes, ids[at], -1)


def _next(p: np.ndarray, w: np.ndarray, length: int, known: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The ids of the phrases of `length` words that begin at each place."""
    at, codes = _pairs(p, w, length)
    out = np.full(len(w), -1, np.int64)
    out[at] = _looked_up(codes, known, ids)
    return out


def _tile(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the tile of each code."""
    return codes >> np.int64(WORD_BITS + TILE_BITS), (codes & np.int64((1 << WORD_BITS) - 1)) >> np.int64(TILE_BITS)


def _dense_tiles(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the tiles that hold `DENSE` codes or more, in ascending order."""
    tops = [[int(x.max(initial=0)) + 1 for x in _tile(part)] for part in parts]
    top_p, top_w = (max(x, default=1) for x in zip(*tops, strict=True))
    if top_p * top_w <= GRID:
        size = np.zeros(top_p * top_w, np.int64)
        for part in parts:
            p, w = _tile(part)
            p *= top_w
            p += w
            size += np.bincount(p, minlength=len(size))
        dense = np.flatnonzero(size >= DENSE)
        return dense // top_w, dense % top_w
    found = [np.unique(_code(*_tile(part)), return_counts=True) for part in parts]
    tiles, place = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
    size = np.bincount(place, np.concatenate([n for _, n in found]), len(tiles))
    dense = tiles[size >= DENSE]
    return dense >> np.int64(WORD_BITS), dense & np.int64((1 << WORD_BITS) - 1)


def tile_counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and how often each occurs. Tiles with many codes are counted by direct address.

    Working copies are `PIECE` codes long, so that a task needs little more than its codes and their counts.
    """
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mask = np.int64((1 << TILE_BITS) - 1)
    parts = [codes[lo : lo + PIECE] for lo in range(0, len(codes), PIECE)]
    dense_p, dense_w = _dense_tiles(parts)
    sparse = np.ones(len(codes), bool)
    out, times = [], []
    for at_p, at_w in zip(dense_p, dense_w, strict=True):
        counted = np.zeros(1 << (2 * TILE_BITS), np.int64)
        for number, part in enumerate(parts):
            p, w = _tile(part)
            mine = (p == at_p) & (w == at_w)
            sparse[number * PIECE : number * PIECE + len(part)] &= ~mine
            part = part[mine]
            counted += np.bincount((((part >> np.int64(WORD_BITS)) & mask) << np.int64(TILE_BITS)) | (part & mask), minlength=len(counted))
        cell = np.flatnonzero(counted)
        out.append(_code((at_p << np.int64(TILE_BITS)) + (cell >> TILE_BITS), (at_w << np.int64(TILE_BITS)) + (cell & mask)))
        times.append(counted[cell])
    rest = codes[sparse]
    rest.sort()
    if len(rest):
        first = np.flatnonzero(np.append(True, rest[1:] != rest[:-1]))
        out.append(rest[first])
        times.append(np.diff(first, append=len(rest)))
    return np.concatenate(out), np.concatenate(times)


class Corpus:
    """Slices as sequences of word ids w and phrase ids p, with the id tables that are still to be applied to p."""

    def __init__(self, base: DataFrame):
        self.base = base                                                        # (slice, w binary int64, p binary int64)
        self.chain: list[tuple[int, np.ndarray, np.ndarray]] = []

    def sequences(self) -> tuple[DataFrame, object]:
        chain = self.chain

        def rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            for i in range(batch.num_rows):
                w = np.frombuffer(batch.column("w")[i].as_py(), np.int32).astype(np.int64)
                p = batch.column("p")[i].as_py()
                p = w if p is None else np.frombuffer(p, np.int64)
                for length, known, ids in chain:
                    p = _next(p, w, length, known, ids)
                yield batch.column("slice")[i].as_py(), w, p

        return self.base, rows

    def counts(self, length: int) -> DataFrame:
        """(code, f) of the phrases of `length` words that occur, once per batch of a task."""
        base, rows = self.sequences()

        def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0

            def emit() -> pa.RecordBatch:
                codes = np.concatenate(held)
                held.clear()
                codes, times = tile_counts(codes)
                return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(times.astype(np.int64))], ["code", "f"])

            for batch in batches:
                for _, w, p in rows(batch):
                    codes = _pairs(p, w, length)[1]
                    held.append(codes)
                    size += len(codes)
                    if size >= PAIRS:
                        yield emit()
                        held, size = [], 0
            if size:
                yield emit()

        return base.mapInArrow(stage, "code long, f long")

    def extend(self, length: int, level: DataFrame, small: bool) -> None:
        """From now on p has the ids of `level`, the frequent phrases of `length` words."""
        if small:
            held = level.select("code", "id").toArrow()                         # at most BROADCAST rows
            codes, ids = held.column("code").to_numpy(), held.column("id").to_numpy()
            order = np.argsort(codes)
            self.chain = [*self.chain, (length, codes[order], ids[order])]
            return
        base, rows = self.sequences()

        def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for slice_, w, p in rows(batch):
                    codes = np.unique(_pairs(p, w, length)[1])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), slice_)), pa.array(codes)], ["slice", "code"])

        asked = base.mapInArrow(wanted, "slice long, code long").join(level.select("code", "id"), "code")
        given = asked.groupBy("slice").agg(F.array_sort(F.collect_list(F.struct("code", "id"))).alias("x"))    # a slice's own phrases
        given = given.select("slice", F.col("x.code").alias("codes"), F.col("x.id").alias("ids"))

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, (slice_, w, p) in enumerate(rows(batch)):
                    codes, ids = (np.array(batch.column(c)[i].as_py() or [], np.int64) for c in ("codes", "ids"))
                    p = _next(p, w, length, codes, ids)
                    yield pa.RecordBatch.from_arrays([pa.array([slice_]), pa.array([w.astype(np.int32).tobytes()]), pa.array([p.tobytes()])], ["slice", "w", "p"])

        self.base = _stored(base.join(given, "slice", "left").mapInArrow(apply, "slice long, w binary, p binary"))
        self.chain = []


def _with_ids(slices: DataFrame, words: DataFrame, small: bool) -> DataFrame:
    """(slice, w, p): the slices as sequences of word ids, -1 for words that are not in `words` and between pieces."""
    kind = "slice long, w binary, p binary"

    def row(slice_: int, seq: bytes, ids: np.ndarray) -> pa.RecordBatch:
        w = np.append(ids, -1).astype(np.int32)[np.frombuffer(seq, np.int32)]
        return pa.RecordBatch.from_arrays([pa.array([slice_]), pa.array([w.tobytes()]), pa.nulls(1, pa.binary())], ["slice", "w", "p"])

    if small:
        held = words.select("lang", "w", "id").toArrow()                        # at most BROADCAST rows
        by_lang: dict[str, dict[str, int]] = {}
        for lang, word, i in zip(*(held.column(c).to_pylist() for c in ("lang", "w", "id")), strict=True):
            by_lang.setdefault(lang, {})[word] = i

        def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, (slice_, lang, seq) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("slice", "lang", "seq")), strict=True)):
                    ids = by_lang.get(lang, {}).get
                    vocabulary = batch.column("words")[i].values.to_numpy(zero_copy_only=False).tolist()
                    yield row(slice_, seq, np.fromiter((ids(x, -1) for x in vocabulary), np.int64, len(vocabulary)))

        return slices.select("slice", "lang", "words", "seq").mapInArrow(known, kind)
    asked = slices.select("slice", "lang", F.posexplode("words").alias("at", "w")).join(words.select("lang", "w", "id"), ["lang", "w"])
    given = asked.groupBy("slice").agg(F.collect_list(F.struct("at", "id")).alias("x"))                # a slice's own vocabulary

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.full(batch.column("n")[i].as_py(), -1, np.int64)
                at, got = (np.array(batch.column(c)[i].as_py() or [], np.int64) for c in ("at", "ids"))
                ids[at] = got
                yield row(batch.column("slice")[i].as_py(), batch.column("seq")[i].as_py(), ids)

    met = slices.select("slice", F.size("words").alias("n"), "seq").join(given, "slice", "left")
    return met.select("slice", "n", "seq", F.col("x.at").alias("at"), F.col("x.id").alias("ids")).mapInArrow(joined, kind)


def phrase_counts(docs: DataFrame, least: int = 100, longest: int = 5, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """((lang, n): words per language; (lang, phrase, length, f): phrases of 1 to `longest` words that occur `least` times)."""
    slices = _stored(slices_of(docs, text_col, lang_col))
    counted = slices.select("lang", F.explode(F.arrays_zip("words", "times")).alias("x")).groupBy("lang", F.col("x.words").alias("w")).agg(F.sum("x.times").alias("f"))
    totals = cut(slices.groupBy("lang").agg(F.sum(F.aggregate("times", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n")))
    words = ranked(cut(counted.filter(F.col("f") >= least)), ["w"])
    words = cut(words.select("lang", "w", "f", "id"))
    size = words.count()
    if size >= 1 << WORD_BITS:
        raise ValueError("more frequent words than ids")
    corpus = Corpus(_stored(_with_ids(slices, words, size <= BROADCAST)))
    level = words.select("lang", F.col("w").alias("phrase"), F.lit(1).alias("length"), "f", "id")
    last = words.select(F.col("id").alias("w"), F.col("w").alias("word"))
    levels = [level]
    for length in range(2, longest + 1):
        sums = corpus.counts(length).groupBy("code").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
        first = level.select(F.col("id").alias("p"), "lang", "phrase")
        named = sums.withColumn("p", F.shiftright("code", WORD_BITS)).withColumn("w", F.col("code").bitwiseAND(F.lit((1 << WORD_BITS) - 1))).join(first, "p").join(last, "w")
        found = named.select("lang", F.concat_ws(" ", "phrase", "word").alias("phrase"), F.lit(length).alias("length"), "f", "code")
        level = cut(ranked(cut(found), ["code"]))
        levels.append(level)
        size = level.count()
        if not size or length == longest:
            break
        corpus.extend(length, level, size <= BROADCAST)
    every = levels[0].select("lang", "phrase", "length", "f")
    for level in levels[1:]:
        every = every.unionByName(level.select("lang", "phrase", "length", "f"))
    return totals, every


def _part(phrase: str, first: Column, count: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, count), " ")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, share: int = 100, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language.

    a is how often the phrase occurs, l and r how often the two parts of its lowest-scoring cut do, n the words of the
    language, score floor(1000 a n / (l r)). A phrase inside a longer one with 100 f(longer) >= share a is dropped.
    """
    totals, every = phrase_counts(docs, least, longest, text_col, lang_col)
    every = cut(every)
    known = every.select("lang", "phrase", "f")
    several = every.filter("length > 1")
    # sub-phrases of two words or more, and the most frequent phrase around each
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("length") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("length") - n + 1), lambda i: _part("phrase", i, n))))
    around = several.filter("length > 2").select("lang", F.explode(spans).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = several.join(around, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (100 * F.col("most") < share * F.col("f")))
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "length", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    parts = cuts.withColumn("left", _part("phrase", F.lit(1), F.col("k"))).withColumn("right", _part("phrase", F.col("k") + 1, F.col("length") - F.col("k")))
    side = lambda name, f: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    met = parts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
    scored = met.withColumn("score", F.expr(SCORE))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    near = Window.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(SALTS))).orderBy(*order)
    first = lowest.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= top)                 # SALTS * top rows of a language
    out = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same phrases in DuckDB.
ORACLE_SQL = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM texts
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang
), phrases AS (
  SELECT lang, m AS length, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM pieces, range(1, 6) AS lengths(m) WHERE len(w) >= m
), counts AS (
  SELECT lang, length, phrase, count(*) AS f FROM phrases GROUP BY lang, length, phrase HAVING count(*) >= 100
), spans AS (
  SELECT lang, f, array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' ') AS phrase
  FROM counts, range(2, 5) AS lengths(m), range(1, 5) AS places(i) WHERE m < length AND i + m - 1 <= length
), kept AS (
  SELECT * FROM counts c WHERE length > 1 AND NOT EXISTS (SELECT 1 FROM spans s WHERE s.lang = c.lang AND s.phrase = c.phrase AND 100 * s.f >= 100 * c.f)
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, k, x.f AS l, y.f AS r, n, (1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f) AS score
  FROM kept c JOIN totals USING (lang), range(1, 5) AS places(k), counts x, counts y
  WHERE k < c.length AND x.lang = c.lang AND y.lang = c.lang AND x.phrase = array_to_string(string_split(c.phrase, ' ')[:k], ' ')
    AND y.phrase = array_to_string(string_split(c.phrase, ' ')[k + 1:], ' ')
), lowest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cuts
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest WHERE place = 1
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ordered WHERE rank <= 2000
"""
