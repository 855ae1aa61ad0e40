import numpy as np
from conftest_llm import SF

from specmap.llm import toxicity


def test_unseen_texts(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.filter("doc_id % 3 > 0"))
    scored = toxicity.score(docs, model).withColumnRenamed("toxic", "said").join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    y, said = np.array([r["toxic"] == 1 for r in scored]), np.array([r["said"] for r in scored])
    assert (y & said).sum() >= 0.6 * y.sum()
    assert (~y & said).sum() <= 0.03 * (~y).sum()
    assert all(0 <= r["severity"] <= 3 and 0 <= r["grade"] <= 3 for r in scored)


def test_shared_weights_and_ordered_thresholds():
    draw = np.random.default_rng(0)
    n, true = 6000, np.array([1.5, -1.0, 0.0, 2.0])
    x = (draw.random((n, 4)) < 0.5).astype(float)
    z = x @ true + draw.logistic(size=n)
    grade = (z[:, None] > np.array([0.0, 1.0, 3.0])).sum(axis=1)
    row, column = np.nonzero(x)
    w, theta = toxicity.fit(row, column, x[row, column], grade, 4, ridge=0, rounds=800)
    assert np.allclose(w, true, atol=0.2) and np.allclose(theta, [0, 1, 3], atol=0.2) and (np.diff(theta) > 0).all()
    model = toxicity.Ordinal(np.arange(4, dtype=np.uint64), w, theta)
    p = model.exceeds(np.array([-50.0, 0.0, 50.0]))
    assert (np.diff(p, axis=1) <= 0).all() and p[0].sum() < 1e-6 and p[2].sum() > 3 - 1e-6


def test_features_equal_brute_force(texts):
    import pyarrow as pa

    from specmap.llm.words import slices

    rows = [*list(texts.values())[:30], None, "", "!!! (a) b-c, d."]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(rows)})
    for part, data, offsets in slices(batch, "text"):
        text, _ = toxicity.features(data, offsets)
        for i, t in enumerate(part.column("text").to_pylist()):
            outer = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
            expected = sum(bool(w.decode().strip(outer)) for w in (t or "").encode().split())
            assert (text == i).sum() == 2 * expected


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, None), (4, 1), (5, 0), (None, 1), (99, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    assert toxicity.score(odd, model).count() == odd.count()
    one = toxicity.train(odd, labels.filter("toxic = 1"))
    assert {r["toxic"] for r in toxicity.score(odd, one).collect()} == {True}
    empty = toxicity.train(none, labels)
    assert {r["toxic"] for r in toxicity.score(odd, empty).collect()} == {False}
    assert toxicity.score(none, model).count() == 0


def test_given_grades(spark):
    rows = [(i, " ".join(["calm"] * 5 + ["grim"] * (5 * (i % 3)) + ["day"] * 3)) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for shift in (0, 1, 4):
        labels = spark.createDataFrame([(i, i % 3 + shift) for i in range(90)], "doc_id long, toxic int")
        scored = toxicity.score(docs, toxicity.train(docs, labels, binary=False)).collect()
        assert all(r["grade"] == r["doc_id"] % 3 + shift for r in scored)
        assert all(abs(r["severity"] - r["grade"]) < 0.5 for r in scored)
    same = toxicity.score(docs, toxicity.train(docs, docs.selectExpr("doc_id", "3 AS toxic"), binary=False)).collect()
    assert {(r["severity"], r["grade"], r["toxic"]) for r in same} == {(3.0, 3, True)}
