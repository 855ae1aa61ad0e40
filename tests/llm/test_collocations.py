import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import LOWER

from specmap.llm import collocations as co

RANDOM = np.random.default_rng(11)


def brute(rows, least, top, share=100):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + m])] += 1
    out = []
    for lang, found in counts.items():
        candidates = {p: f for p, f in found.items() if len(p) > 1 and f >= least}
        best = []
        for p, a in candidates.items():
            inside = (f for q, f in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
            if any(100 * f >= share * a for f in inside):
                continue
            score, k = min((1000 * a * totals[lang] // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def rows_of(n, vocabulary=7):
    marks = [" ", "  ", "\t", ", ", ". ", "\n", " ! ", "\x0b"]
    out = []
    for i in range(n):
        words = ["Abé"[: 1 + w % 3] + "x" * (w // 3) for w in np.minimum(RANDOM.geometric(0.3, 120), vocabulary)]
        ends = RANDOM.choice(len(marks), len(words), p=[0.8, *[0.2 / 7] * 7])
        out.append((["aa", "bb", None][i % 3], "".join(w + marks[e] for w, e in zip(words, ends, strict=True))))
    return out


def found(spark, rows, **how):
    docs = spark.createDataFrame(rows, "lang string, text string")
    return sorted(map(tuple, co.collocations(docs, **how).collect()))


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_equals_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(co, "BROADCAST", broadcast)
    monkeypatch.setattr(co, "SLICE", 3000)
    rows = rows_of(60)
    assert found(spark, rows, least=12, top=40) == brute(rows, 12, 40)
    assert found(spark, rows, least=3, top=10_000, share=60) == brute(rows, 3, 10_000, 60)


def test_tiles_count_every_code(monkeypatch):
    monkeypatch.setattr(co, "DENSE", 50)
    p, w = RANDOM.zipf(1.3, 4000) % 5000, RANDOM.zipf(1.2, 4000) % 3_000_000
    codes = co._code(p.astype(np.int64), w.astype(np.int64))
    for grid in (1 << 22, 1):
        monkeypatch.setattr(co, "GRID", grid)
        got, times = co.tile_counts(codes)
        assert dict(zip(got.tolist(), times.tolist(), strict=True)) == Counter(codes.tolist())


def test_odd_rows(spark, odd, none):
    docs = odd.selectExpr("*", "id AS lang", "n AS w", "n AS p", "key AS phrase", "n AS f")
    rows = [("z", r.text) for r in odd.collect()]
    assert sorted(map(tuple, co.collocations(docs, least=1, top=50).collect())) == brute(rows, 1, 50)
    assert co.collocations(none).collect() == []
    assert found(spark, [("l", "a a a a"), (None, "a, a\na"), ("l", "a a a a")], least=2) == brute([("l", "a a a a"), (None, "a, a\na"), ("l", "a a a a")], 2, 2000)


def test_scores_beyond_64_bits(spark):
    big = 4 * 10**15
    df = spark.createDataFrame([(big, big, big, big)], "a long, n long, l long, r long")
    text = co.SCORE
    assert df.selectExpr(f"{text} AS s").first().s == 1000 * big * big // (big * big)


def test_counting_needs_little_more_than_codes_and_counts():
    import tracemalloc

    spread = np.random.default_rng(3)
    codes = co._code((30000 ** spread.random(1 << 21)).astype(np.int64), (30000 ** spread.random(1 << 21)).astype(np.int64))
    tracemalloc.start()
    got, times = co.tile_counts(codes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert times.sum() == len(codes) and len(np.unique(got)) == len(got)
    assert peak < 4.5 * codes.nbytes                                            # six times the codes and more before
