import re
from collections import Counter

import numpy as np
from conftest_llm import SF, words

from specmap.llm import quality


def brute(text):
    w = words(text)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_brute_force(docs, odd):
    for table in (docs, odd):
        expected = sorted((r["doc_id"] or -1, *brute(r["text"])) for r in table.collect())
        got = quality.statistics(table).select("doc_id", *quality.COUNTS[:5]).collect()
        assert sorted((r["doc_id"] or -1, *r[1:]) for r in got) == expected


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_lines_that_defeat_polynomials(spark):
    """A Thue-Morse string and its mirror image have equal polynomial hashes modulo 2**64, whatever the base."""
    a = thue_morse(2048)
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{a}\n{b}\n{a[:1024]}\n{b[:1024]}"), (2, f"{a}\n{b}\n{a}"), (3, f"{a[:200]} {b[:200]} {a[:200]} {b[:200]} x")]
    found = quality.statistics(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", *quality.COUNTS[:5]).collect()
    assert sorted(tuple(r) for r in found) == [(i, *brute(t)) for i, t in rows]


def test_list_is_precise_on_unseen_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    seen, unseen = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    got = quality.verdicts(docs, seen).join(unseen, "doc_id").filter("NOT base_failed").collect()
    low = np.array([r["quality"] == 0 for r in got])
    gone = np.array([not r["kept"] for r in got])
    assert (low & gone).sum() >= 0.7 * low.sum()
    assert (~low & gone).sum() <= 0.02 * (~low).sum()


def test_covering_finds_planted_rules():
    draw = np.random.default_rng(3)
    x = {"a": draw.random(4000), "b": draw.random(4000), "c": draw.random(4000)}
    low = (x["a"] > 0.8) & (x["b"] <= 0.5) | (x["c"] > 0.95)
    rules = quality.learn(x, low, draw.random(4000) < 0.33)
    fired = np.zeros(4000, bool)
    for r in rules:
        fired |= quality._covers(r, x, 4000)
    assert (fired == low).mean() > 0.985
    assert quality.learn(x, np.zeros(4000, bool), draw.random(4000) < 0.33) == []


def test_conditional_says_what_the_rules_say(spark, docs, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = quality.verdicts(odd, labels)
    assert out.filter("kept = base_failed").count() == 0
    assert out.count() == odd.count()
    assert quality.verdicts(none, labels).count() == quality.filter_quality(none, labels).count() == 0
    named = odd.selectExpr("*", "n AS _q_n_words", "n AS __q_n_words", "n AS _label_id")
    kept = quality.filter_quality(named, labels)
    assert kept.columns == named.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in out.filter("kept").collect())
    rule = (quality.Condition("words", True, 100.0), quality.Condition("symbols", False, 0.5))
    stats = quality.statistics(docs).withColumn("hit", quality.rejects([rule])).collect()
    assert all(r["hit"] == (r["n_words"] > 100 and r["n_symbols"] <= 0.5 * r["n_words"]) for r in stats)
