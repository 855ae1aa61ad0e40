import hashlib
import zlib

import pytest

from specmap.llm import merkle
from specmap.llm.queries import op11_merkle_manifest

KIND = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    out = ""
    for name in ("doc_id", "source", "lang", "n_chars", "text"):
        value = row[name]
        if name == "n_chars" and value is not None:
            value += more
        out += "-" if value is None else f"{len(str(value).encode())}:{value}"
    return h(out)


def tree(digests):
    """The root, and per leaf the (side, sibling) steps."""
    paths, where, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, at in enumerate(where):
            other = at ^ 1
            paths[i].append((None, "") if other >= len(level) else (other < at, level[other]))
        level = [h("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
        where = [at // 2 for at in where]
    return level[0], paths


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(row)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    subroots, within = {}, {}
    for name in names:
        ordered = sorted(groups[name], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        subroots[name], paths = tree([leaf(r) for r in ordered])
        within[name] = list(zip(ordered, paths, strict=True))
    if not names:
        return []
    root, tops = tree([subroots[n] for n in names])
    out = []
    for name, top in zip(names, tops, strict=True):
        for row, path in within[name]:
            digest = leaf(row, row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0)
            for left, other in path + top:
                digest = h(other + digest if left else digest + other)
            proof = h("".join(other for _, other in path + top))
            out.append((row["doc_id"], leaf(row), subroots[name], root, proof, digest, digest == root))
    return out


def same(df, rows):
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, df.collect()), key=key) == sorted(brute(rows), key=key)


def query(spark, rows, tmp_path, kind=KIND):
    spark.createDataFrame(rows, kind).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return op11_merkle_manifest(spark, str(tmp_path))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5])
def test_small_trees(spark, tmp_path, n):
    rows = [dict(zip(("doc_id", "source", "lang", "n_chars", "text"), (i, "s", "l", 3, f"t{i}"), strict=True)) for i in range(n)]
    same(query(spark, [tuple(r.values()) for r in rows], tmp_path), rows)


def test_bands_groups_and_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "BAND", 2)
    monkeypatch.setattr(merkle, "_levels", lambda n: min(2, (n - 1).bit_length()))
    langs = ["de"] * 41 + ["en"] * 17 + [None] * 6 + ["é", "z"] + [""] * 3
    rows = [{"doc_id": 7 * i % 50, "source": None if i % 5 == 0 else "src", "lang": x, "n_chars": None if i % 6 == 0 else i, "text": None if i == 3 else "ß" * i} for i, x in enumerate(langs)]
    rows += [dict(rows[0])] * 3 + [{**rows[1], "doc_id": None}] * 2
    same(query(spark, [tuple(r.values()) for r in rows], tmp_path), rows)


def test_extra_columns_and_own_digests(spark):
    rows = [(i, "s", "l", 1, "t", "x", "y", 5) for i in range(9)]
    docs = spark.createDataFrame(rows, KIND + ", tree string, digest string, _at int")
    found = merkle.manifest(docs).collect()
    assert all(r.verified for r in found) and {len(r.proof) for r in found} == {4, 1}
    seen = merkle.manifest(docs, shown=merkle.row_digest([docs["text"]])).collect()
    assert not any(r.verified for r in seen)


def test_whole_table(spark, docs):
    from conftest_llm import SMALL

    same(op11_merkle_manifest(spark, SMALL), [r.asDict() for r in docs.collect()])
