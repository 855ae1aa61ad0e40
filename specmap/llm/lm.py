"""Scores of texts under prediction by partial matching over bytes, beside a unigram base.

The pretrained model is a trie of byte contexts up to `ORDER`, counted over all training texts, with every n-gram and
context whole. A byte is coded in its longest known context; what that context does not know escapes to the next shorter
one, with the weight of its distinct followers (method C), and symbols of longer contexts are excluded from the shorter.
Because the model stands still while texts are scored, what exclusion takes away is one number per context, and the
probability of a symbol is a function of its (context, symbol) code: all codes that occur are priced once, by joins of the
count tables. `adaptive_scores` instead learns each text from its own beginning.

What every task has is chosen by size, what is counted is not: codes and words of at least `SHARE` of the data (so at most
1 / SHARE) are looked up in the tasks. The others are joined by code, summed per text before; by the choice no frequent one
is a join key. A `share` above zero leaves rarer n-grams out of the model on purpose, as weight of their context's escape.

Cases: a null or empty text has one token, its end; a null id counts as the empty text when the fold is chosen; an empty
training set gives N = 0, V = 0 and a uniform byte model; repeated rows each give a row and each count in training; an
empty table gives an empty one; other columns are ignored.
"""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specmap.llm.words import Words, slices
from specmap.session import cut

#: Bytes of context.
ORDER = 4
#: A code or word of at least this share of the data is in the tables that every task has; the others are joined.
SHARE = 2e-7
#: Symbols: 0 before a text, 1 to 256 its bytes, 257 its end.
_BITS, _END, _SYMBOLS = 9, 257, 257
_END_WORD = 0x5BD1E9955BD1E995
#: n-grams and words of training texts, n-grams of held-out texts
_GRAM, _WORD, _HELD = 0, 1, 2
_MERGE = 1 << 22


def _symbols(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of (context, symbol) at each byte and end, and where the codes of each text begin and end."""
    sizes = np.diff(offsets)
    begins = offsets[:-1] + (order + 1) * np.arange(len(sizes))
    s = np.zeros(int(len(data) + (order + 1) * len(sizes)), np.int64)
    at = np.arange(len(data)) + np.repeat((order + 1) * np.arange(len(sizes)) + order, sizes)
    s[at] = data.astype(np.int64) + 1
    ends = begins + order + sizes
    s[ends] = _END
    code = s.copy()
    for j in range(1, order + 1):
        code[j:] |= s[:-j] << (_BITS * j)
    real = np.ones(len(s), bool)
    for j in range(order):
        real[begins + j] = False
    sums = np.concatenate([[0], np.cumsum(sizes + 1)])
    return code[real], sums[:-1], sums[1:]


class _Tally:
    """Sums of counts by code, merged whenever many have come together."""

    def __init__(self) -> None:
        self.codes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = self.floor = 0

    def add(self, codes: np.ndarray) -> None:
        u, n = np.unique(codes, return_counts=True)
        self.codes.append(u)
        self.counts.append(n)
        self.size += len(u)
        if self.size > self.floor + _MERGE:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.codes:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        u, back = np.unique(np.concatenate(self.codes), return_inverse=True)
        n = np.bincount(back, weights=np.concatenate(self.counts)).astype(np.int64)
        self.codes, self.counts, self.size, self.floor = [u], [n], len(u), len(u)
        return u, n


def _counts(texts: DataFrame, order: int) -> DataFrame:
    """(kind, code, n): n-grams of the longest order of all texts, and words with the end of the training texts."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = {_GRAM: _Tally(), _WORD: _Tally(), _HELD: _Tally()}
        for batch in batches:
            held = batch.column("held_out")
            for part, kind in ((batch.filter(pc.invert(held)), _GRAM), (batch.filter(held), _HELD)):
                for rows, data, offsets in slices(part, "text"):
                    tallies[kind].add(_symbols(data, offsets, order)[0])
                    if kind == _GRAM:
                        w = Words(data, offsets, lower=True)
                        tallies[_WORD].add(np.concatenate([w.hashes.view(np.int64), np.full(rows.num_rows, _END_WORD, np.int64)]))
        for kind, tally in tallies.items():
            codes, n = tally.merge()
            for lo in range(0, len(codes), 100_000):
                part = codes[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part), pa.array(n[lo : lo + 100_000])], ["kind", "code", "n"])

    counted = texts.select("text", "held_out").mapInArrow(stage, "kind int, code long, n long")
    return cut(counted.groupBy("kind", "code").agg(F.sum("n").alias("n")))


def _find(sorted_codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of `wanted`, or -1."""
    if not len(sorted_codes):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(sorted_codes, wanted), len(sorted_codes) - 1)
    return np.where(sorted_codes[at] == wanted, at, -1)


def _suffix(code: str, symbols: int) -> Column:
    return F.col(code).bitwiseAND(F.lit((1 << (_BITS * symbols)) - 1))


def _contexts(grams: list[DataFrame], least: float) -> list[DataFrame]:
    """Per order k, (context, total, kept, distinct, first, base) of its contexts. `first` is the log10 weight of the escape
    of a text that enters the trie there; base[j + 1] is what coding a symbol found at order j costs besides log10 of its
    count there, and base[0] all that a symbol costs which no order knows. No key of a join has more than 258 rows."""
    out: list[DataFrame] = []
    for k, mine in enumerate(grams):
        known = F.col("n") >= least
        mine = mine.withColumn("context", F.shiftright("code", _BITS)).withColumn("lower", F.lit(0).cast("long"))
        if k:
            mine = mine.drop("lower").join(grams[k - 1].select(F.col("code").alias("short"), F.col("n").alias("lower")), _suffix("code", k) == F.col("short"))
        # `excluded`: counts, one order lower, of the symbols that a context knows
        sums = {"total": F.sum("n"), "kept": F.sum(F.when(known, F.col("n"))), "distinct": F.count(F.when(known, 1)), "excluded": F.sum(F.when(known, F.col("lower")))}
        rows = mine.groupBy("context").agg(*(x.alias(c) for c, x in sums.items())).filter("distinct > 0")
        rows = rows.withColumn("first", F.log10((F.col("total") - F.col("kept") + F.col("distinct")) / (F.col("total") + F.col("distinct"))))
        own = -F.log10(F.col("total") + F.col("distinct"))
        if k:
            rows = rows.join(out[-1].select(F.col("context").alias("short"), *(F.col(c).alias(f"_{c}") for c in ("total", "kept", "distinct", "first", "base"))), _suffix("context", k - 1) == F.col("short"))
            escape = F.col("_total") - F.col("_kept") + F.col("_distinct") - F.col("distinct")
            weight = F.col("_kept") - F.col("excluded") + escape
            # a context all of whose symbols are excluded, and that lost none, is passed at no cost
            passed = F.col("first") + F.when(weight > 0, F.log10(escape / weight)).otherwise(0.0) - F.col("_first")
            base = F.concat(F.transform(F.slice("_base", 1, k), lambda x: x + passed), F.array(F.col("first") - F.when(weight > 0, F.log10(weight)).otherwise(0.0), own))
        else:
            base = F.array(F.col("first") - F.log10(F.greatest(F.lit(_SYMBOLS) - F.col("distinct"), F.lit(1))), own)
        out.append(cut(rows.select("context", "total", "kept", "distinct", "first", base.alias("base"))))
    return out


def _priced(counts: DataFrame, order: int, share: float) -> DataFrame:
    """(code, n, log10): every code of any text, how often it occurs in all texts, and its log10 probability."""
    codes = counts.filter(F.col("kind") != _WORD).groupBy("code").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("kind") == _GRAM, F.col("n"))).alias("seen"))
    codes = cut(codes)
    grams = [codes.filter("seen > 0").select("code", F.col("seen").alias("n"))]
    for k in range(order, 0, -1):
        grams.insert(0, cut(grams[0].groupBy(_suffix("code", k).alias("code")).agg(F.sum("n").alias("n"))))
    least = max(1.0, share * (grams[0].agg(F.sum("n")).first()[0] or 0))
    contexts = _contexts(grams, least)
    here = lambda k: F.shiftright(_suffix("code", k + 1), _BITS)
    # there are at most 258 contexts and 66,564 n-grams of order 1
    sized = lambda df, k: F.broadcast(df) if k < 2 else df
    long = codes.filter(F.col("seen") >= least).join(contexts[order].select("context", "base"), here(order) == F.col("context"))
    long = long.select("code", "n", (F.log10("seen") + F.get("base", F.lit(order + 1))).alias("log10"))
    rest = codes.filter(F.coalesce("seen", F.lit(0)) < least).select("code", "n", F.lit(None).cast("array<double>").alias("base"), F.lit(None).cast("double").alias("log10"))
    for k in range(order, -1, -1):
        rest = rest.join(sized(contexts[k].select("context", F.col("base").alias("mine")), k), here(k) == F.col("context"), "left")
        rest = rest.select("code", "n", F.coalesce("base", "mine").alias("base"), "log10")
    for k in range(order - 1, -1, -1):
        mine = grams[k].filter(F.col("n") >= least).select(F.col("code").alias("short"), F.col("n").alias("found"))
        rest = rest.join(sized(mine, k), _suffix("code", k + 1) == F.col("short"), "left")
        rest = rest.select("code", "n", "base", F.coalesce("log10", F.log10("found") + F.get("base", F.lit(k + 1))).alias("log10"))
    rest = rest.select("code", "n", F.coalesce("log10", F.get("base", F.lit(0)), F.lit(-float(np.log10(_SYMBOLS)))).alias("log10"))
    return cut(long.unionByName(rest))


def held_out(id_col: str, folds: int, fold: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(folds)) == fold


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2, order: int = ORDER, share: float = 0.0, spread: float = SHARE) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score); rows of fold `fold` are held out of training."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), held_out(id_col, folds, fold).alias("held_out"))
    counts = _counts(texts, order)
    priced = _priced(counts, order, share)
    words = counts.filter(F.col("kind") == _WORD).select("code", "n")
    n_all, n_distinct = words.agg(F.sum("n"), F.count("*")).first()
    n_all = n_all or 0
    floor = max(1.0, spread * n_all)
    table = words.filter(F.col("n") >= floor).orderBy("code").toArrow()
    often, often_n = table.column("code").to_numpy(), table.column("n").to_numpy()
    gram_floor = max(1.0, spread * (priced.agg(F.sum("n")).first()[0] or 0))
    table = priced.filter(F.col("n") >= gram_floor).select("code", "log10").orderBy("code").toArrow()
    grams, gram_log10 = table.column("code").to_numpy(), table.column("log10").to_numpy()
    below = float(n_all + n_distinct + 1)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((grams, gram_log10, often, often_n))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, gram_log10, often, often_n = shared.value
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                codes, begin, end = _symbols(data, offsets, order)
                unique, back = np.unique(codes, return_inverse=True)
                at = _find(grams, unique)
                run = np.concatenate([[0.0], np.cumsum((np.where(at >= 0, gram_log10[np.maximum(at, 0)], 0.0) if len(grams) else np.zeros(len(unique)))[back])])
                # distinct rare codes of each text
                rare = np.flatnonzero(at[back] < 0)
                pair, times = np.unique(np.stack([np.searchsorted(end, rare, "right"), codes[rare]]), axis=1, return_counts=True)
                gram_cuts = pa.array(np.searchsorted(pair[0], np.arange(rows.num_rows + 1)).astype(np.int32))
                w = Words(data, offsets, lower=True)
                # words of a text, then its end
                h = np.insert(w.hashes.view(np.int64), w.first[1:], _END_WORD)
                first = w.first + np.arange(len(w.first))
                at = _find(often, h)
                base = np.where(at >= 0, np.log10((often_n[np.maximum(at, 0)] + 1) / below) if len(often) else 0.0, 0.0)
                sums = np.concatenate([[0.0], np.cumsum(base)])
                known = np.concatenate([[0], np.cumsum(at >= 0)])
                rare = np.flatnonzero(at < 0)
                cuts = np.searchsorted(rare, first).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id"), rows.column("held_out"), pa.array(np.diff(first)), pa.array(known[first[1:]] - known[first[:-1]]), pa.array(sums[first[1:]] - sums[first[:-1]]), pa.array(run[end] - run[begin]),
                     pa.ListArray.from_arrays(pa.array(cuts), pa.array(h[rare])), pa.ListArray.from_arrays(gram_cuts, pa.array(pair[1])), pa.ListArray.from_arrays(gram_cuts, pa.array(times))],
                    ["id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "grams", "times"],
                )

    id_type = texts.schema["id"].dataType.simpleString()
    scored = texts.mapInArrow(stage, f"id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<long>, grams array<long>, times array<long>")
    scored = cut(scored.withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode("rare").alias("code"))
    seldom = words.filter(F.col("n") < floor)
    terms = rare.join(seldom, "code", "left").select("row", F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(below)).alias("rest"), F.when(F.col("n").isNotNull(), 1).alias("more"), F.lit(0.0).alias("grams_rest"))
    gone = scored.select("row", F.explode(F.arrays_zip("grams", "times")).alias("g")).select("row", F.col("g.grams").alias("code"), F.col("g.times").alias("times"))
    gram_terms = gone.join(priced.filter(F.col("n") < gram_floor).select("code", "log10"), "code").select("row", F.lit(0.0).alias("rest"), F.lit(None).cast("int").alias("more"), (F.col("times") * F.col("log10")).alias("grams_rest"))
    terms = terms.unionByName(gram_terms).groupBy("row").agg(F.sum("rest").alias("rest"), F.count("more").alias("more"), F.sum("grams_rest").alias("grams_rest"))
    out = scored.drop("rare", "grams", "times").join(terms, "row", "left")
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("grams_rest", F.lit(0.0))).alias("score"),
    )


def adaptive_log10(text: bytes, order: int = ORDER) -> float:
    """log10 probability of one text and its end under a trie that starts empty and learns it byte by byte."""
    trie: dict[bytes, dict[int, int]] = defaultdict(dict)
    total = 0.0
    for i, symbol in enumerate([*(b + 1 for b in text), _END]):
        excluded: set[int] = set()
        for k in range(min(i, order), -1, -1):
            seen = trie.get(text[i - k : i], {})
            mine = {s: n for s, n in seen.items() if s not in excluded}
            if not mine:
                continue
            weight = sum(mine.values()) + len(mine)
            if symbol in mine:
                total += np.log10(mine[symbol] / weight)
                break
            total += np.log10(len(mine) / weight)
            excluded |= mine.keys()
        else:
            total -= np.log10(_SYMBOLS - len(excluded))
        for k in range(min(i, order) + 1):
            seen = trie[text[i - k : i]]
            seen[symbol] = seen.get(symbol, 0) + 1
    return float(total)


def adaptive_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(id, score): each whole text under its own adaptive model."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: adaptive_log10((t or "").encode(), order)).astype(float)

    return docs.select(id_col, scores(F.col(text_col).cast("string")).alias("score"))
