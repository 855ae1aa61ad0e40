import hashlib
import re

import public_tokenizers
from conftest_llm import SMALL
from test_decontaminate import brute as brute_overlaps
from test_jaccard import brute as brute_components
from tokenizers import Tokenizer

import corpus_pipeline
from specmap.llm import quality

SECRET = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}|AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}""")


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            seen.append({r["doc_id"]: r for r in docs.collect()})
    first = {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    kept, alone, clean, safe = seen
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    expected = quality.verdicts(table, spark.read.parquet(f"{SMALL}/labels.parquet")).filter("kept").collect()
    assert set(kept) == {r["doc_id"] for r in expected} and all(kept[i] == first[i] for i in kept)
    groups = brute_components([(i, r["text"]) for i, r in kept.items()])
    assert set(alone) == {top for _, top in groups.values()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    leaks = {d for d, _ in brute_overlaps([(i, r["text"]) for i, r in alone.items()], items)}
    assert set(clean) == set(alone) - leaks
    assert set(safe) == set(clean)
    for i, r in safe.items():
        assert r["text"] == SECRET.sub("[SECRET]", clean[i]["text"]) and r["n_chars"] == len(r["text"])
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    last = {r["doc_id"]: r for r in docs.collect()}
    assert set(last) == set(safe)
    for i, r in safe.items():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        assert last[i]["n_tokens"] == len(ids)
        assert last[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    whole = {tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert whole == {tuple(r) for r in last.values()}
