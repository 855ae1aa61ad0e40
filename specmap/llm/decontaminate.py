"""Benchmark decontamination by spaced-seed hashing.

Words are runs of letters and digits, lower-cased. Two fixed masks each name six of eight consecutive words; the hash of
the named words ignores the others. Hashes of test items are joined with those of all texts. Each hit fixes an alignment,
around which the words are compared: an overlap is a window of thirteen aligned words of which at most two differ. The two
masks together hit every such window, whichever two words were replaced. Items of eight to twelve words are compared whole,
again with at most two differing words: they are cut into four parts, and each of six masks names the words of two parts,
so that any two replaced words leave one mask untouched. Items of fewer than eight words overlap where all their words
stand in a text: the hash of the whole item is its seed. Everything is DataFrame functions.

Cases: items without a word overlap nothing; null texts have no words; rows with a null id are not reported;
repeated rows report a pair once; empty tables report nothing; other columns of either input are ignored.
"""
from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specmap.llm.words import unused
from specmap.session import cut

#: Word positions that count, of eight. Any 13 words with two replaced still hold one of these untouched.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
SPAN = 8
WINDOW = 13
DIFFERENT = 2
#: Masks of a whole item of so many words: each pair of its four parts.
SHORT = {n: tuple(tuple(k for k in range(n) if k * 4 // n in pair) for pair in combinations(range(4), 2)) for n in range(SPAN, WINDOW)}
SHORT |= {n: (tuple(range(n)),) for n in range(1, SPAN)}
#: A side of a join is broadcast up to so many rows; beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Hashes of the words of a text, in order."""
    found = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda w: F.xxhash64(w))


def _seeds(mask: int) -> Column:
    """Seed hashes of the column `w` at each place, under one mask."""
    at = lambda i: F.xxhash64(F.lit(mask), *(F.get("w", i + k) for k in MASKS[mask]))
    places = F.sequence(F.lit(0), F.size("w") - SPAN)
    return F.when(F.size("w") >= SPAN, F.transform(places, at)).otherwise(F.array().cast("array<bigint>"))


def _short_seeds(n: int, outside: int) -> Column:
    """(place, seed) of the column `w` under the masks of items of n words, with up to `outside` words beyond an end."""
    at = lambda i: F.array(*(F.struct(i.alias("place"), F.xxhash64(F.lit(n), F.lit(m), *(F.when(i + k >= 0, F.get("w", i + k)) for k in mask)).alias("seed")) for m, mask in enumerate(SHORT[n])))
    places = F.sequence(F.lit(-outside), F.size("w") - n + outside)
    return F.when(F.size("w") >= n - outside, F.flatten(F.transform(places, at)))


def _exploded(rows: DataFrame, key: str) -> DataFrame:
    parts = [rows.select(key, F.posexplode(_seeds(m)).alias("place", "seed")) for m in range(len(MASKS))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, n_match, n_window, coverage): pairs that overlap, the most equal words in a window, its length, and the
    share of the item's words that are equal under that alignment."""
    tests = cut(items.select(F.col(item_col).alias("_item"), words(F.col(item_text_col)).alias("w")).filter(F.col("_item").isNotNull() & (F.size("w") > 0)).distinct())
    short = [r["n"] for r in tests.select(F.size("w").alias("n")).filter(F.col("n") < WINDOW).distinct().collect()]
    seeds = _exploded(tests.filter(F.size("w") >= WINDOW), "_item")
    for n in short:
        seeds = seeds.unionByName(tests.filter(F.size("w") == n).select("_item", F.inline(_short_seeds(n, 0))))
    seeds = cut(seeds.withColumnRenamed("place", "item_place").distinct())
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_t")).filter("_doc IS NOT NULL AND _t IS NOT NULL")
    each = texts.select("_doc", words(F.col("_t")).alias("w"))
    # both masks of a text side by side, so that it is split into words once
    both = each.select("_doc", F.posexplode(F.arrays_zip(*(_seeds(m).alias(f"s{m}") for m in range(len(MASKS))))).alias("place", "s"))
    flat = both.select("_doc", "place", F.explode(F.array(*(F.col(f"s.s{m}") for m in range(len(MASKS))))).alias("seed"))
    for n in short:
        flat = flat.unionByName(each.select("_doc", F.inline(_short_seeds(n, DIFFERENT if n >= SPAN else 0))))
    hits = flat.join(_small(seeds), "seed")
    lined = cut(hits.select("_doc", "_item", (F.col("place") - F.col("item_place")).alias("shift")).distinct())
    hit_docs = lined.select("_doc").distinct()
    found = texts.join(_small(hit_docs), "_doc", "left_semi").select("_doc", words(F.col("_t")).alias("a"))
    wide = found.join(_small(lined), "_doc").join(_small(tests.withColumnRenamed("w", "b")), "_item")
    same = F.transform(F.sequence(F.lit(0), F.size("b") - 1), lambda k: F.when((k + F.col("shift") >= 0) & (F.get("a", k + F.col("shift")) == F.get("b", k)), 1).otherwise(0))
    wide = wide.withColumn("same", same).withColumn("n_window", F.least(F.lit(WINDOW), F.size("b")))
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, y: s + y)
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("b") - F.col("n_window") + 1), lambda i: total(F.slice("same", i, F.col("n_window")))))
    scored = wide.select("_doc", "_item", F.struct(best.alias("n_match"), (total(F.col("same")) / F.size("b")).alias("coverage"), F.col("n_window").alias("n_window")).alias("o"))
    allowed = F.when(F.col("o.n_window") < SPAN, 0).otherwise(DIFFERENT)
    out = scored.filter(F.col("o.n_match") >= F.col("o.n_window") - allowed).groupBy("_doc", "_item").agg(F.max("o").alias("o"))
    return out.select(F.col("_doc").alias(id_col), F.col("_item").alias(item_col), "o.n_match", "o.n_window", "o.coverage")


def remove(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of `docs` whose id overlaps no item; rows with a null id stay."""
    gone = unused(docs.columns, "_bad")[0]
    bad = cut(overlaps(docs, items, id_col, text_col, item_col, item_text_col).select(F.col(id_col).alias(gone)).distinct())
    return docs.join(_small(bad), F.col(id_col) == F.col(gone), "left_anti")
