import hashlib
import random
import re

from conftest_llm import SF

from specmap.llm import secrets

ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    spans = []
    for kind, pattern, group, least in ((0, ASSIGN, 1, 6), (1, re.compile("AKIA[A-Z0-9]+"), 0, 20), (2, re.compile("[0-9a-f]+"), 0, 24)):
        spans += [(m.start(), kind, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    names = ("assign", "access", "hex")
    line = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(spans))
    return (*(sum(k == j for _, k, _ in spans) for j in range(3)), hashlib.sha256(line.encode()).hexdigest())


def hostile(n=300):
    draw = random.Random(6)
    parts = ["token", "API_KEY", "apikey", "Secret", "passwd", "=", ":", " ", "  ", '"', "'", "AKIA", "ABCDEFGHIJKLMNOP12", "deadbeef", "0123456789abcdef", "zz", "é🙂", ".", "\n", "a.b/c", "x"]
    return [(i, "".join(draw.choice(parts) for _ in range(draw.randint(0, 40)))) for i in range(n)]


NONE = secrets.Models((0.0,) * 128**2)


def test_base_equals_brute_force(spark, odd):
    table = spark.createDataFrame(hostile(), "doc_id long, text string")
    for t in (table, odd, spark.read.parquet(f"{SF}/documents.parquet")):
        expected = sorted((r["doc_id"] or -1, *brute(r["text"])) for r in t.collect())
        assert sorted((r[0] or -1, *r[1:5]) for r in secrets.scan(t, NONE).collect()) == expected


def test_random_strings_are_found_and_words_are_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    models, draw = secrets.train(docs), random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(draw.choice(letters) for _ in range(32)) for _ in range(40)]
    keys = [k for k in keys if re.search("[0-9]", k)]
    plain = ["the-reading-of-chapter-12", "there2heringation2andering", "2024-01-17_meeting_notes_of_the_house", "path/to/the/house/number/9/again"]
    table = spark.createDataFrame([(i, f"see {k} there") for i, k in enumerate(keys + plain)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(table, models).collect()}
    found = [got[i] == f"markov:4:{4 + len(k)}" for i, k in enumerate(keys)]
    assert sum(found) >= 0.95 * len(keys)
    assert [got[len(keys) + i] for i in range(len(plain))] == [""] * len(plain)
    assert secrets.scan(docs, models).agg({"n_markov": "sum"}).first()[0] <= 3


def test_runs_without_a_digit_and_what_fixed_spans_leave(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    models, draw = secrets.train(docs), random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    keys = ["".join(draw.choice(letters) for _ in range(32)) for _ in range(40)]
    base = "0123456789abcdef0123456789abcdef"
    rows = [(i, k) for i, k in enumerate(keys)] + [(100 + i, f"{base}-{k}+") for i, k in enumerate(keys)]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), models).collect()}
    assert sum(got[i] == "markov:0:32" for i in range(40)) >= 36
    assert sum(got[100 + i] == "hex:0:32,markov:32:66" for i in range(40)) >= 36


def test_redaction(spark, odd, none):
    key = "0123456789abcdef01234567"
    rows = [(1, f"é token={key} b"), (2, f"{key}"), (3, "plain é"), (4, None), (5, f"a {key} b {key}")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in secrets.redact(table, NONE).collect()}
    assert got == {1: "é [SECRET] b", 2: "[SECRET]", 3: "plain é", 4: None, 5: "a [SECRET] b [SECRET]"}
    named = table.selectExpr("*", "text AS _text", "doc_id AS _spans", "1 AS _row", "2 AS _end", "3 AS _own")
    assert secrets.redact(named, NONE).drop("_text").join(secrets.redact(table, NONE), ["doc_id", "text"]).count() == 4
    assert {r["_text"] for r in secrets.redact(named, NONE).collect()} == {t for _, t in rows}
    assert secrets.redact(odd, NONE).columns == odd.columns
    assert secrets.redact(odd, NONE).exceptAll(odd).count() == 0
    assert secrets.scan(none, secrets.train(none)).count() == 0


def test_plan_has_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = secrets.scan(docs, NONE)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
