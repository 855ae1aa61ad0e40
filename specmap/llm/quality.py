"""Quality rules: a decision list learned by sequential covering, applied as one ordered Spark conditional.

Statistics of each text come from one Arrow pass. From labelled rows, rules for the low grade are grown one threshold at
a time by FOIL gain, pruned on rows held out of the growing, and kept while they stay precise; each kept rule removes
what it covers before the next is grown. The list becomes CASE WHEN … THEN false … ELSE true.

Cases: a null or empty text has no words, and fails the base rule; ratios over zero words are 0; a null id stays null and
takes no label; repeated rows each give a row; an empty table gives an empty one; without labels of both grades the list
is empty and only the base rule decides. Other columns of the input are ignored by `statistics`, kept by `filter_quality`.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specmap.llm.words import Words, mix, slices, whole_windows, window_hash
from specmap.session import cut

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_exclaim", "n_bars",
)
#: What thresholds are set on: ratios of the counts.
FEATURES = {
    "words": ("n_words", None), "word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "upper": ("n_upper", "word_chars"),
    "digits": ("n_digits", "word_chars"), "exclaims": ("n_exclaim", "n_words"), "bars": ("n_bars", "n_words"),
    "line_words": ("n_words", "n_lines"),
}
#: About so many labelled rows (those whose hash falls below a share) teach the list.
FIT_ROWS = 20_000


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOL, _DIGIT, _EXCLAIM, _BAR = (_table(x) for x in ("#*$%&|<>", "0123456789", "!", "|"))
_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def count_texts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of `COUNTS` for each text."""
    w = Words(data, offsets)
    out = {"n_words": w.counts}
    within = lambda table: w.per_text(np.flatnonzero(table[data]))
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    chars = np.zeros(len(w.starts) + 1, np.int64)
    np.cumsum(lead[w.ends] - lead[w.starts], out=chars[1:])
    out["word_chars"] = chars[w.first[1:]] - chars[w.first[:-1]]
    out |= {"n_symbols": within(_SYMBOL), "n_upper": within(_UPPER), "n_digits": within(_DIGIT), "n_exclaim": within(_EXCLAIM), "n_bars": within(_BAR)}
    # lines with a word, and those equal to an earlier one of their text
    begin = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    begin = begin[begin < len(data)]
    end = np.append(begin[1:], len(data))
    end = end - ((end > begin) & (data[end - 1] == 10)) if len(begin) else end
    full = np.searchsorted(w.starts, end) > np.searchsorted(w.starts, begin)
    begin, end = begin[full], end[full]
    text = np.searchsorted(offsets, begin, "right") - 1
    out["n_lines"] = np.bincount(text, minlength=len(w.counts))
    out["n_dup_lines"] = np.bincount(text[_later(_keyed(w.span_hash(begin, end), text))], minlength=len(w.counts))
    # words in windows of three found more than once in their text
    n = len(w.starts) - 2
    covered = np.zeros(len(w.starts), bool)
    if n > 0:
        at = np.flatnonzero(whole_windows(w.first, w.counts, 3, n))
        key = _keyed(window_hash(w.hashes, 3)[at], w.text[at])
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        for j in range(3):
            covered[at[again] + j] = True
    out["n_repeat_words"] = w.per_text(w.starts[covered])
    return out


def _keyed(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    return mix(h + text.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def _later(key: np.ndarray) -> np.ndarray:
    """Positions whose key stands earlier too."""
    order = np.argsort(key, kind="stable")
    return order[1:][key[order][1:] == key[order][:-1]]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts): one row per row of `docs`."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                counts = count_texts(data, offsets)
                yield pa.RecordBatch.from_arrays([rows.column("id"), *(pa.array(counts[c].astype(np.int64)) for c in COUNTS)], ["id", *COUNTS])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(stage, "id long, " + ", ".join(f"{c} long" for c in COUNTS)).withColumnRenamed("id", id_col)


def base_failed(prefix: str = "") -> Column:
    words = F.col(f"{prefix}n_words")
    return (words < 50) | (100 * F.col(f"{prefix}n_repeat_words") > 50 * words)


def _feature(name: str, prefix: str = "") -> Column:
    over, under = FEATURES[name]
    if under is None:
        return F.col(prefix + over).cast("double")
    return F.when(F.col(prefix + under) == 0, F.lit(0.0)).otherwise(F.col(prefix + over).cast("double") / F.col(prefix + under))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, prefix: str = "") -> Column:
        value = _feature(self.feature, prefix)
        return value > self.threshold if self.above else value <= self.threshold

    def rows(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold


Rule = tuple[Condition, ...]


def rejects(rules: list[Rule], prefix: str = "") -> Column:
    """The ordered conditional: true where a rule fires."""
    out = F.lit(False)
    for rule in reversed(rules):
        fires = rule[0].column(prefix)
        for c in rule[1:]:
            fires = fires & c.column(prefix)
        out = F.when(fires, F.lit(True)).otherwise(out)
    return out


def _covers(rule: Rule | list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.rows(x)
    return out


def _grow(x: dict[str, np.ndarray], low: np.ndarray, longest: int) -> list[Condition]:
    rule: list[Condition] = []
    live = np.ones(len(low), bool)
    while len(rule) < longest and (low & live).any() and (~low & live).any():
        p0, n0 = (low & live).sum(), (~low & live).sum()
        best, found = 1e-9, None
        for name, v in x.items():
            values, pick = np.unique(v[live]), None
            if len(values) < 2:
                continue
            pick = np.unique(np.linspace(0, len(values) - 2, 64).astype(int))
            at = np.sort(v[live & low]), np.sort(v[live & ~low])
            for t in (values[pick] + values[pick + 1]) / 2:
                below = np.searchsorted(at[0], t, "right"), np.searchsorted(at[1], t, "right")
                for above, p, n in ((False, *below), (True, p0 - below[0], n0 - below[1])):
                    gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))) if p else 0
                    if gain > best:
                        best, found = gain, Condition(name, above, float(t))
        if found is None:
            break
        rule.append(found)
        live &= found.rows(x)
    return rule


def learn(x: dict[str, np.ndarray], low: np.ndarray, held: np.ndarray, precision: float = 0.95, least: int = 5, longest: int = 4, most: int = 16) -> list[Rule]:
    """A decision list for the rows in `low`; `held` rows prune, the others grow. A rule stays if, over all rows left, at
    least `precision` of what it covers is low, on the held rows too, and it covers `least` low rows."""
    rules: list[Rule] = []
    left = np.ones(len(low), bool)
    while len(rules) < most:
        grown = left & ~held
        rule = _grow({k: v[grown] for k, v in x.items()}, low[grown], longest)
        if not rule:
            break
        proof = left & held

        def worth(r: list[Condition], rows: np.ndarray) -> tuple[float, int]:
            c = _covers(r, x, len(low)) & rows
            p, n = (c & low).sum(), (c & ~low).sum()
            return (p - n) / max(1, p + n), p

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: worth(r, proof)[0])
        c = _covers(rule, x, len(low)) & left
        share = lambda rows: (c & low & rows).sum() / max(1, (c & rows).sum())  # noqa: B023, E731
        if (c & low).sum() < least or share(left) < precision or (c & proof).any() and share(proof) < precision:
            break
        rules.append(tuple(rule))
        left &= ~c
    return rules


def learn_from(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", grade: str = "quality", fit_rows: int = FIT_ROWS) -> list[Rule]:
    """The list learned from about `fit_rows` labelled rows that pass the base rule."""
    known = labels.select(F.col(id_col).alias("_label_id"), F.col(grade).alias("_grade")).filter("_grade IS NOT NULL AND _label_id IS NOT NULL")
    order = F.pmod(F.xxhash64("_label_id", F.lit(7)), F.lit(1 << 30))
    drawn = known.filter(order < int(min(1.0, fit_rows / max(1, known.count())) * (1 << 30)))
    joined = stats.filter(~base_failed()).join(drawn, F.col(id_col) == F.col("_label_id"))
    rows = joined.select(order.alias("_order"), "_grade", *(_feature(k).alias(k) for k in FEATURES)).orderBy("_order", *FEATURES).collect()
    low = np.array([r["_grade"] == 0 for r in rows], bool)
    held = np.array([r["_order"] % 3 == 0 for r in rows], bool)
    return learn({k: np.array([r[k] for r in rows], float) for k in FEATURES}, low, held) if len(rows) else []


def verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(id, counts, base_failed, kept) for every row; the statistics are written once, as learning and deciding both read them."""
    stats = cut(statistics(docs, id_col, text_col))
    rules = learn_from(stats, labels, id_col, fit_rows=fit_rows)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejects(rules))


def filter_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of `docs` that the list keeps, with their columns. Labelled texts teach the list, then one pass over all
    texts decides row by row, so ids need not be unique."""
    known = labels.select(F.col(id_col).alias("_label_id")).distinct()
    taught = docs.select(id_col, text_col).join(known, F.col(id_col) == F.col("_label_id"), "left_semi")
    rules = learn_from(statistics(taught, id_col, text_col), labels, id_col, fit_rows=fit_rows)
    columns = docs.columns
    mark = "_q_"
    while any(c.lower().startswith(mark) for c in columns):
        mark = f"_{mark}"
    fields = T.StructType([*docs.schema.fields, *(T.StructField(f"{mark}{c}", T.LongType()) for c in COUNTS)])

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, text_col):
                counts = count_texts(data, offsets)
                yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(counts[c].astype(np.int64)) for c in COUNTS)], [*columns, *(f"{mark}{c}" for c in COUNTS)])

    named = docs.mapInArrow(stage, fields)
    out = named.filter(~(base_failed(mark) | rejects(rules, mark)))
    return out.select(*columns)
