import random
from collections import defaultdict

import numpy as np
from conftest_llm import LOWER, words

from specmap.llm import jaccard


def brute(rows, k=4, share=85):
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    at = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            at[x].append(i)
    both = defaultdict(int)
    for ids in at.values():
        for a in range(len(ids)):
            for b in range(a):
                both[ids[b], ids[a]] += 1
    for (a, b), n in both.items():
        if 100 * n >= share * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


def got(table):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components_of(table).collect()}


def test_equals_brute_force(docs, texts):
    assert got(docs) == brute(texts.items())


def drifting(n=150, seed=2):
    """Chains of near copies whose ends are far apart, groups of equal texts, and pairs close to the limit."""
    draw = random.Random(seed)
    rows, i = [], 0
    for _ in range(10):
        text = [f"{draw.randint(0, 60)}" for _ in range(draw.randint(4, 90))]
        for _ in range(n // 10):
            if draw.random() < 0.8:
                for _ in range(draw.randint(0, 2)):
                    text[draw.randrange(len(text))] = f"{draw.randint(0, 60)}"
            rows.append((1000 - i if i % 2 else i, " ".join(text)))
            i += 1
    return rows


def test_chains_copies_and_limits(spark):
    for seed in (2, 3):
        rows = drifting(seed=seed)
        assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_large_group_of_near_copies(spark):
    draw = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        text = list(base)
        for _ in range(draw.randint(0, 4)):
            text[draw.randrange(120)] = f"x{draw.randint(0, 10**6)}"
        rows.append((i, " ".join(text)))
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_odd_rows(odd, none):
    rows = jaccard.components_of(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_shingles"] == 0 and by[1]["component_id"] == 1 and by[2]["component_id"] == 2
    assert by[4]["n_shingles"] == by[7]["n_shingles"] == by[8]["n_shingles"] == 1
    assert by[5]["component_id"] == 5 and by[None]["component_id"] is None
    assert jaccard.components_of(none).count() == jaccard.keep_one(none).count() == 0
    named = odd.selectExpr("*", "n AS _gone", "n AS label", "n AS digest")
    assert jaccard.keep_one(named).count() == odd.count() and jaccard.keep_one(named).columns == named.columns


def test_one_of_each_group_stays(spark):
    rows = drifting()
    table = spark.createDataFrame(rows, "doc_id long, text string")
    expected = sorted({c if n else i for i, (n, c) in brute(rows).items()})
    assert sorted(r["doc_id"] for r in jaccard.keep_one(table).collect()) == expected


def jobs(spark, run):
    """Jobs that `run` starts, by the tracker of a group of its own."""
    spark.sparkContext.setJobGroup("counted", "")
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def met(spark, groups, size):
    """Rows that the join across components makes, for groups of texts that share a frequent shingle and little else."""
    draw = random.Random(groups)
    rows = []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(80)]
        for i in range(size):
            text = list(base)
            for _ in range(3):
                text[draw.randrange(80)] = f"x{draw.randint(0, 10**9)}"
            rows.append((len(rows), " ".join(["the same four words", *text])))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    counted = []
    across = jaccard._across
    jaccard._across = lambda nodes, share: counted.append(across(nodes, share)) or counted[-1]
    try:
        assert got(table) == brute(rows)
    finally:
        jaccard._across = across
    return counted[0].count()


def test_hot_shingles_and_groups_make_few_candidates(spark):
    """Five times the texts, in larger groups under one shingle that all texts share: candidates grow in proportion."""
    few, many = met(spark, 5, 12), met(spark, 10, 30)
    assert many <= 5 * max(few, 60)


def test_near_copies_meet_the_text_they_come_from(spark):
    """Members differ from their source in one or two words, from each other often too much: they need not meet."""
    draw = random.Random(7)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 300):
        text = list(base)
        for at in draw.sample(range(150), 1 + i % 2):
            text[at] = f"x{i}y{at}"
        rows.append((i, " ".join(text)))
    counted = []
    across = jaccard._across
    jaccard._across = lambda nodes, share: counted.append(across(nodes, share)) or counted[-1]
    try:
        assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)
    finally:
        jaccard._across = across
    assert counted[0].count() <= len(rows)


def test_long_texts_that_share_half_are_not_compared_whole(spark):
    """A few parities say nothing of texts of thousands of words; only the pair that links goes on to its sets."""
    draw = random.Random(8)
    shared = [f"s{i}" for i in range(2000)]
    texts = [" ".join(shared + [f"t{j}x{draw.randint(0, 10**9)}" for _ in range(2000)]) for j in range(6)]
    texts.append(texts[0] + " and one end")
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = []
    verified = jaccard._verified
    jaccard._verified = lambda pairs, *rest: seen.append({(r["a"], r["b"]) for r in pairs.collect()}) or verified(pairs, *rest)
    try:
        assert got(table) == brute(enumerate(texts))
    finally:
        jaccard._verified = verified
    assert seen[-1] <= {(0, 6)}


def test_map_of_open_shingles_is_used_evenly():
    """Prefixes hold shingles of few counters, the leading bits of their hashes; their places in the map are spread."""
    draw = np.random.default_rng(9)
    keys = draw.integers(0, 1 << 60, 100_000, np.uint64).view(np.int64)            # one counter in 16
    assert len(np.unique(jaccard._place(keys))) > 95_000


def test_few_jobs(spark, docs):
    assert jobs(spark, lambda: jaccard.components_of(docs).collect()) <= 70
