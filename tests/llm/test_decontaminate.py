import itertools
import random
import re

from conftest_llm import SF

from specmap.llm import decontaminate


def split(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def brute(rows, items):
    out = set()
    at = {}
    for item, text in items:
        w = split(text)
        for k in range(len(w)):
            at.setdefault(w[k], []).append((item, k))
    whole = {i: split(t) for i, t in items}
    for doc, text in rows:
        a = split(text)
        shifts = {(item, p - k) for p, w in enumerate(a) for item, k in at.get(w, ())}
        for item, shift in shifts:
            b = whole[item]
            same = [0 <= k + shift < len(a) and a[k + shift] == b[k] for k in range(len(b))]
            n = min(13, len(b))
            if max(sum(same[k : k + n]) for k in range(len(b) - n + 1)) >= n - (2 if n >= 8 else 0):
                out.add((doc, item))
    return out


def got(docs, items):
    return {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(docs, items).collect()}


def test_masks_hit_every_window_with_two_replaced():
    for lost in itertools.combinations(range(13), 2):
        assert any(all(at + k not in lost for k in m) for m in decontaminate.MASKS for at in range(13 - decontaminate.SPAN + 1))


def test_equals_brute_force(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got(docs, items) == brute(rows, [(r["item_id"], r["text"]) for r in items.collect()])


def test_replaced_words_and_cut_passages(spark):
    draw = random.Random(9)
    items = [(i, " ".join(f"{draw.choice('bcdfg')}{draw.randint(0, 30)}" for _ in range(draw.randint(13, 40)))) for i in range(12)]
    rows = []
    for i in range(300):
        w = draw.choice(items)[1].split()
        begin = draw.randint(0, max(0, len(w) - 13))
        part = w[begin : begin + draw.randint(10, 30)]
        for _ in range(draw.randint(0, 5)):
            part[draw.randrange(len(part))] = "other"
        rows.append((i, "Before, " + " ".join(part).upper() + "; after."))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    expected = brute(rows, items)
    assert got(docs, tests) == expected and 30 < len({d for d, _ in expected}) < 290
    assert {r["doc_id"] for r in decontaminate.remove(docs, tests).collect()} == {i for i, _ in rows} - {d for d, _ in expected}


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, None, 2), (2, "", 3), (3, "a b c", 4), (None, "w " * 30, 1), (5, "word " * 20, 1), (5, "word " * 20, 1)], "item_id long, text string, doc_id int")
    assert got(odd, items) == {(8, 5), (5, 3)}
    assert decontaminate.overlaps(odd, items).count() == 2
    named = odd.selectExpr("*", "n AS _bad", "n AS _BAD_")
    left = decontaminate.remove(named, items)
    assert left.columns == named.columns and left.count() == odd.count() - 3
    assert got(none, items) == set() and got(odd, items.limit(0)) == set()
    plan = decontaminate.overlaps(odd, items)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)


def test_short_items_with_every_pair_of_words_replaced(spark):
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in range(8, 14)]
    rows, expected = [], set()
    for n, text in items:
        for lost in {(i, j) for i in range(n) for j in range(i, n)} | {()}:
            w = [f"other{k}" if k in lost else x for k, x in enumerate(text.split())]
            expected.add((len(rows), n))
            rows.append((len(rows), " ".join(["before", *w, "after"])))
        for part in (text.split()[2:], text.split()[:-2], text.split()[1:-1]):
            expected.add((len(rows), n))
            rows.append((len(rows), " ".join(part)))
        rows.append((len(rows), " ".join(["x", "x", "x", *text.split()[3:]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    assert got(docs, tests) == expected == brute(rows, items)


def test_items_of_few_words_stand_whole(spark):
    items = [(n, " ".join(f"s{n}w{k}" for k in range(n))) for n in range(1, 8)]
    rows, expected = [], set()
    for n, text in items:
        w = text.split()
        expected |= {(len(rows), n), (len(rows) + 1, n)}
        rows += [(len(rows), text.upper()), (len(rows) + 1, f"before {text}, after")]
        for k in range(n):
            rows.append((len(rows), " ".join(["x", *w[:k], "other", *w[k + 1 :], "y"])))
        rows.append((len(rows), " ".join(w[1:])))
    docs, tests = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(docs, tests) == expected == brute(rows, items)
