import math
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import LOWER, words

from specmap.llm import lm


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


class Brute:
    """The frozen model by dictionaries and sets of excluded symbols."""

    def __init__(self, texts, order, share):
        grams = [Counter() for _ in range(order + 1)]
        self.order = order
        for t in texts:
            s = self.symbols(t)
            for p in range(order, len(s)):
                for k in range(order + 1):
                    grams[k][tuple(s[p - k : p + 1])] += 1
        least = max(1.0, share * sum(grams[0].values()))
        self.seen, self.all = [{} for _ in grams], [Counter() for _ in grams]
        for k, g in enumerate(grams):
            for x, n in g.items():
                self.all[k][x[:-1]] += n
                if n >= least:
                    self.seen[k].setdefault(x[:-1], {})[x[-1]] = n

    def symbols(self, text):
        return [0] * self.order + [b + 1 for b in (text or "").encode()] + [257]

    def chance(self, context, symbol):
        out, excluded = 0.0, set()
        for k in range(self.order, -1, -1):
            c = tuple(context[len(context) - k :])
            seen = self.seen[k].get(c)
            if seen is None:
                continue
            mine = {s: n for s, n in seen.items() if s not in excluded}
            escape = self.all[k][c] - sum(seen.values()) + len(mine)
            weight = sum(mine.values()) + escape
            if symbol in mine:
                return out + math.log10(mine[symbol] / weight)
            if weight:
                out += math.log10(escape / weight) if escape else -math.inf
            excluded |= set(seen)
        return out - math.log10(max(1, 257 - len(excluded)))

    def score(self, text):
        s = self.symbols(text)
        return sum(self.chance(s[p - self.order : p], s[p]) for p in range(self.order, len(s)))


def check(table, share, order=4):
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    tokens = lambda t: [*words((t or "").translate(LOWER)), None]
    c = Counter(x for i, t in rows if not held(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    model = Brute([t for i, t in rows if not held(i)], order, share)
    expected = sorted((i or -1, held(i), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t)), model.score(t)) for i, t in rows)
    got = sorted((r[0] or -1, *r[1:]) for r in lm.score(table, share=share, order=order).collect())
    assert [x[:5] for x in got] == [x[:5] for x in expected]
    for a, b in zip(got, expected, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-6)


def test_equals_brute_force(docs):
    check(docs.limit(40), 1e-6)


def test_rare_words_are_joined_and_rare_contexts_are_lost(docs):
    check(docs.limit(30), 1e-3)


def test_rare_ngrams_keep_their_counts(spark, docs):
    """A larger corpus whose bulk shares no n-gram with a text leaves its counts whole; what is broadcast changes nothing."""
    rows = [(r["doc_id"], r["text"]) for r in docs.limit(25).collect()]
    table = spark.createDataFrame([*rows, *((10_000 + i, "~" * 40_000) for i in range(40))], "doc_id long, text string")
    model = Brute([t for i, t in rows if not held(i)] + ["~" * 40_000] * sum(not held(10_000 + i) for i in range(40)), 4, 0)
    for more in ({}, {"spread": 1e-3}, {"spread": 2.0}):
        got = {r["doc_id"]: r["score"] for r in lm.score(table, **more).collect()}
        for i, t in rows:
            assert got[i] == pytest.approx(model.score(t), rel=1e-9)


def test_probabilities_sum_to_one(texts):
    rows = list(texts.values())[:10]
    model = Brute(rows, 3, 1e-3)
    for context in ([0, 0, 0], [1 + ord(c) for c in "the"], [1 + ord(c) for c in "zzz"], [1 + ord(c) for c in "xan"]):
        assert sum(10 ** model.chance(context, s) for s in range(1, 258)) == pytest.approx(1, abs=0.02)


def test_odd_rows(odd, none):
    check(odd.filter("length(text) < 1000 OR text IS NULL"), 1e-6)
    assert lm.score(odd).count() == odd.count()
    assert lm.score(none).count() == 0


def test_adaptive_coder_learns(spark, texts):
    text = next(t for t in texts.values() if len(t) > 3000)[:3000].encode()
    bits = -lm.adaptive_log10(text) * math.log2(10) / len(text)
    assert bits < 5 and -lm.adaptive_log10(b"ab" * 500) * math.log2(10) / 1000 < 0.3
    frame = spark.createDataFrame([(1, None), (2, "abab")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.adaptive_scores(frame).collect()}
    assert got[1] == pytest.approx(-math.log10(257)) and np.isfinite(got[2])
