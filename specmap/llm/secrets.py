"""Secrets in whole texts: fixed patterns, and runs that look drawn at random under character Markov models.

Two first-order Markov models over ASCII characters are counted from labelled samples: random strings are the values that
the fixed patterns find, ordinary identifiers are the long runs of texts in which those find nothing. A run of sixteen or
more letters, digits and `+/_=-`, or what fixed spans leave of it where that is so long, is reported when the sum of its
log-likelihood ratios passes a threshold. Everything is DataFrame functions; positions are code points, ends are
exclusive.

Cases: a null text counts as empty; texts without secrets have counts 0 and empty lists; spans of one start are ordered by
kind (assign, access, hex, markov); a null id stays null; repeated rows each give a row; an empty table gives an empty
one, and models without samples flag nothing beyond the patterns; other columns are kept by `redact`, ignored by `scan`.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS = r"(AKIA[A-Z0-9]{16,})"
_HEX = r"([0-9a-f]{24,})"
_RUN = r"[A-Za-z0-9+/_=-]"
_LONG = rf"({_RUN}{{16,}})"
KINDS = ("assign", "access", "hex", "markov")
_FIXED = {"assign": (_ASSIGN, 6), "access": (_ACCESS, 20), "hex": (_HEX, 24)}
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_NONE = "array<struct<start:int,finish:int,rank:int,value:string>>"
#: About so many texts (those whose hash falls below a share) are searched for random strings, and for ordinary ones.
RANDOM_TEXTS, ORDINARY_TEXTS = 200_000, 4_000
#: Bounds of what one step adds to the log-likelihood ratio.
STEP = (-3.0, 1.5)
#: Characters of a run that is scored.
LEAST = 16
#: Characters that the models tell apart.
_SIZE = 128


@dataclass(frozen=True)
class Models:
    """Log-likelihood ratios, random against ordinary, of each character after each other, at 128 * first + second."""

    ratios: tuple[float, ...]

    def score(self, run: Column) -> Column:
        codes = F.transform(F.split(run, ""), lambda c: F.ascii(c))
        n = F.length(run)
        table = F.split(F.lit(",".join(f"{x:.6g}" for x in self.ratios)), ",").cast("array<double>")
        steps = F.zip_with(F.slice(codes, 1, n - 1), F.slice(codes, 2, n - 1), lambda a, b: F.get(table, a * _SIZE + b))
        return F.aggregate(steps, F.lit(0.0), lambda total, x: total + x)


def _found(text: Column, pattern: str, kind: str, least: int) -> Column:
    """Leftmost, non-overlapping matches of `pattern` (one group, the value) of `least` characters of value."""
    split = rf"\G((?s:.*?))({pattern})"
    parts = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(split), i).alias(a) for i, a in ((1, "gap"), (2, "hit"), (3, "value"))))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        finish = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), finish.alias("finish"), F.lit(KINDS.index(kind)).alias("rank"), x["value"].alias("value"))
        return F.struct(finish.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast(_NONE).alias("spans"))
    return F.filter(F.aggregate(parts, none, step)["spans"], lambda s: F.length(s["value"]) >= least)


def may_have(text: Column) -> Column:
    """True for every text in which a fixed pattern can match: plain searches, far cheaper than the patterns."""
    low = F.lower(text)
    out = text.contains("AKIA") | text.rlike("[0-9a-f]{24}")
    for name in _NAMES:
        out = out | low.contains(name)
    return out


def fixed_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start and kind."""
    found = F.concat(*(_found(text, p, kind, least) for kind, (p, least) in _FIXED.items()))
    return F.when(may_have(text), F.array_sort(found)).otherwise(F.array().cast(_NONE))


def _steps(runs: DataFrame) -> DataFrame:
    """(a, b, n): how often b follows a in the column `run`."""
    codes = runs.select(F.transform(F.split("run", ""), lambda c: F.ascii(c)).alias("codes"))
    pairs = F.arrays_zip(F.expr("slice(codes, 1, size(codes) - 1)").alias("a"), F.expr("slice(codes, 2, size(codes) - 1)").alias("b"))
    return codes.select(F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", random_texts: int = RANDOM_TEXTS, ordinary_texts: int = ORDINARY_TEXTS) -> Models:
    """Both models, from about `random_texts` texts for random strings and `ordinary_texts` for ordinary ones.

    Random strings lean on a uniform distribution and ordinary ones on their single-character frequencies where a
    context was seen rarely, so characters that a sample lacks still tell the two apart. The tables that reach the driver
    have at most 128 * 128 rows."""
    texts = docs.select(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(3)), F.lit(1 << 30)).alias("h"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = max(1, docs.count())
    drawn = lambda n: texts.filter(F.col("h") < int(min(1.0, n / total) * (1 << 30))).select("text")
    hits = drawn(random_texts).filter(may_have(F.col("text"))).select(F.explode(fixed_spans(F.col("text"))).alias("s")).select(F.col("s.value").alias("run"))
    plain = drawn(ordinary_texts).filter(~may_have(F.col("text"))).select(F.explode(F.regexp_extract_all("text", F.lit(rf"({_RUN}{{8,}})"), 1)).alias("run"))
    table = lambda runs: {(r["a"], r["b"]): r["n"] for r in _steps(runs).collect() if r["a"] < _SIZE and r["b"] < _SIZE}
    random, ordinary = table(hits), table(plain)
    if not random or not ordinary:
        return Models((0.0,) * _SIZE**2)
    alphabet = [ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."]

    def chances(counts: dict[tuple[int, int], int], prior: dict[int, float], weight: float) -> dict[tuple[int, int], float]:
        seen: dict[int, int] = {}
        for (a, _), n in counts.items():
            seen[a] = seen.get(a, 0) + n
        return {(a, b): math.log((counts.get((a, b), 0) + weight * prior[b]) / (seen.get(a, 0) + weight)) for a in alphabet for b in alphabet}

    total = sum(ordinary.values())
    single = {b: (sum(n for (_, y), n in ordinary.items() if y == b) + 1) / (total + len(alphabet)) for b in alphabet}
    log_random = chances(random, {b: 1 / len(alphabet) for b in alphabet}, float(len(alphabet)))
    log_ordinary = chances(ordinary, single, float(len(alphabet)))
    ratios = [0.0] * _SIZE**2
    for a in alphabet:
        for b in alphabet:
            # separators say nothing, and no single step decides
            if chr(a).isalnum() and chr(b).isalnum():
                ratios[a * _SIZE + b] = min(STEP[1], max(STEP[0], log_random[a, b] - log_ordinary[a, b]))
    return Models(tuple(ratios))


def with_spans(docs: DataFrame, models: Models, text_col: str = "text", least_ratio: float = 12.0) -> DataFrame:
    """`docs` with `_text` (null as empty), `_fixed` and `_spans`, all spans by start and kind."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.withColumn("_text", text).withColumn("_fixed", fixed_spans(F.col("_text")))
    parts = F.filter(F.flatten(F.transform(_found(F.col("_text"), _LONG, "markov", LEAST), _remainders)), lambda s: models.score(s["value"]) >= least_ratio)
    return out.withColumn("_spans", F.when(F.col("_text").rlike(_LONG), F.array_sort(F.concat("_fixed", parts))).otherwise(F.col("_fixed")))


def _remainders(run: Column) -> Column:
    """What the fixed spans leave of a run, where it is long enough."""

    def piece(start: Column, finish: Column) -> Column:
        value = F.substring(run["value"], start - run["start"] + 1, finish - start)
        return F.struct(start.alias("start"), finish.alias("finish"), run["rank"].alias("rank"), value.alias("value"))

    def step(state: Column, s: Column) -> Column:
        apart = (s["finish"] <= state["at"]) | (s["start"] >= run["finish"])
        before = F.when(apart | (s["start"] <= state["at"]), F.array().cast(_NONE)).otherwise(F.array(piece(state["at"], s["start"])))
        return F.struct(F.when(apart, state["at"]).otherwise(F.least(s["finish"], run["finish"])).alias("at"), F.concat(state["out"], before).alias("out"))

    begin = F.struct(run["start"].alias("at"), F.array().cast(_NONE).alias("out"))
    end = F.aggregate("_fixed", begin, step)
    whole = F.concat(end["out"], F.array(piece(end["at"], run["finish"])))
    return F.filter(whole, lambda s: s["finish"] - s["start"] >= LEAST)


def _written(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["finish"])), ",")


def scan(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_markov) for every row."""
    found = with_spans(docs.select(F.col(id_col), F.col(text_col)), models, text_col)
    n = lambda k: F.size(F.filter("_spans", lambda s: s["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select(id_col, n("assign"), n("access"), n("hex"), F.sha2(_written(F.col("_fixed")), 256).alias("base_sha256"), _written(F.col("_spans")).alias("spans"), n("markov"))


def redact(docs: DataFrame, models: Models, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every span in `text_col` replaced by `mark` (touching spans by one); other texts stay as they are."""

    def step(state: Column, s: Column) -> Column:
        text = F.col("_text")
        fresh = s["start"] >= state["at"]
        kept = F.concat(state["out"], text.substr(state["at"] + 1, s["start"] - state["at"]), F.lit(mark))
        return F.struct(F.greatest(state["at"], s["finish"]).alias("at"), F.when(fresh, kept).otherwise(state["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    end = F.aggregate("_spans", begin, step)
    rest = lambda e: F.concat(e["out"], F.col("_text").substr(e["at"] + 1, F.length("_text")))
    # the row travels as one column, so no name of its own can clash
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(text_col).alias("_own"))
    found = with_spans(packed, models, "_own").withColumn("_end", end)
    text = F.when(F.size("_spans") > 0, rest(F.col("_end"))).otherwise(F.col("_own"))
    return found.select(*((text if c == text_col else F.col("_row").getField(c)).alias(c) for c in docs.columns))
