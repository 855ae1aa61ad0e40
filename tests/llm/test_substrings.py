import hashlib
import random

from conftest_llm import words

from specmap.llm import substrings


def brute(rows, window=20):
    seen, out = {}, {}
    order = sorted(rows, key=lambda r: r[0])
    for i, text in order:
        w = words(text)
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            if seen.setdefault(key, (i, j)) != (i, j):
                gone[j : j + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def got(table, **more):
    return {r["doc_id"]: tuple(r)[1:] for r in substrings.digests(table, **more).collect()}


def test_equals_brute_force(docs, texts):
    assert got(docs) == brute(texts.items())


def planted(n=400, seed=5):
    """Few words, so that windows overlap in many ways: shared passages, repeats inside a text, shifted factors."""
    draw = random.Random(seed)
    passages = [[draw.choice("abcdefgh") for _ in range(draw.randint(12, 60))] for _ in range(12)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(draw.randint(0, 6)):
            p = draw.choice(passages)
            a = draw.randint(0, len(p) - 1)
            parts += p[a : a + draw.randint(5, 60)] if draw.random() < 0.7 else [draw.choice("abcdefghijklmnop") for _ in range(draw.randint(1, 25))]
        rows.append((i * 7 % n, " ".join(parts)))
    return rows


def test_planted_overlaps_in_small_slices(spark, monkeypatch):
    rows = planted()
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    expected = brute(rows)
    assert got(table) == expected
    monkeypatch.setattr(substrings, "SLICE", 700)
    monkeypatch.setattr(substrings, "WINDOWS_AT_ONCE", 50)
    monkeypatch.setattr(substrings, "BROADCAST_NUMBERS", 0)
    assert got(table) == expected


def test_hot_passage(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"start{i} {passage} end{i}") for i in range(600)]
    out = got(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert out[0][1] == 0 and all(out[i][1] == 60 for i in range(1, 600))


def test_odd_rows(odd, none):
    rows = substrings.digests(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[8]["n_words"] == 30_000 and by[8]["n_removed"] == 29_999
    assert all(by[i]["n_removed"] == 0 for i in (1, 2, 3, 4, 5, 7, 9, None))
    assert substrings.digests(none).count() == 0
    left = {r["doc_id"]: r["text"] for r in substrings.deduplicated(odd).collect()}
    assert left[8] == "word" and left[1] == ""


def test_repeated_rows_are_not_earlier_than_each_other(spark):
    text = " ".join(f"w{i}" for i in range(40))
    table = spark.createDataFrame([(3, text), (3, text), (4, text), (None, text)], "doc_id long, text string").repartition(4)
    removed = sorted(((r["doc_id"] or 99), r["n_removed"]) for r in substrings.digests(table).collect())
    assert removed == [(3, 0), (3, 0), (4, 40), (99, 40)]


def test_rows_without_an_id_are_documents_of_their_own(spark, monkeypatch):
    known, clean, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    copy = " ".join(known.split()[:40])
    rows = [(1, known), (None, copy + " tail"), (None, clean), (None, other + " " + copy), (None, copy + " tail"), (None, None)]
    expected = sorted([("", 0), (known, 0), (copy + " tail", 40), (clean, 0), (other + " " + copy, 40), (copy + " tail", 40)])
    left = {"": "", known: known, copy + " tail": "tail", clean: clean, other + " " + copy: other}
    for parts in (1, 5):
        table = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert sorted(r["text"] for r in substrings.deduplicated(table).collect()) == sorted(left[x] for x, _ in expected)
        assert sorted(r["n_removed"] for r in substrings.digests(table).collect()) == sorted(n for _, n in expected)
        monkeypatch.setattr(substrings, "SLICE", 300)
        monkeypatch.setattr(substrings, "BROADCAST_NUMBERS", 0)
