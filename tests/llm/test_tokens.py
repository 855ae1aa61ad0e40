import hashlib
import random

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from specmap.llm import bpe, tokens

PATH = P.path("word_bpe_49k.json")
POOL = "aeiosthnrdlZÉéßΣσİıǅ'’`´0123٣½²🙂👍🏽 ́  \x1c\x85\t\n!?#%$.,-_ſ中文日한ไทยสวัสดี‍ﬁÅÅẛ̣"


def hostile(n=2000):
    draw = random.Random(4)
    out = ["".join(draw.choice(POOL) for _ in range(draw.randint(0, 30))) for _ in range(n)]
    parts = ["the", "ing", "er", "<|endoftext|>", "'re", "ation", "th", "un", "believ", "<|ENDOFTEXT|>", " "]
    return out + ["".join(draw.choice(parts) for _ in range(9)) for _ in range(300)]


def test_encoding_and_decoding_equal_the_library(texts):
    library, own = Tokenizer.from_file(PATH), bpe.Vocabulary(PATH)
    for text in [*texts.values(), *hostile()]:
        ids = library.encode(text, add_special_tokens=False).ids
        line, decoded = own.lines(text)
        assert line == " ".join(map(str, ids))
        assert decoded == own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_backtracking_equals_merging():
    own, draw = bpe.Vocabulary(PATH), random.Random(8)
    for _ in range(1500):
        word = "".join(draw.choice("aeinorst") for _ in range(draw.randint(1, 24)))
        raw = word[:-1] + chr(ord(word[-1]) + 256)
        assert own.encode_word(word) == own.merged(raw)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(name, texts):
    path, rows = P.path(name), [*list(texts.values())[:80], *hostile(600)]
    if name.endswith(".model"):
        expected = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(rows)]
    else:
        expected = [len(x.ids) for x in Tokenizer.from_file(path).encode_batch(rows, add_special_tokens=False)]
    assert tokens.Counter(path)(rows) == expected


def test_memory_limits_change_nothing(monkeypatch, texts):
    rows = list(texts.values())[:40]
    full = [bpe.Vocabulary(PATH).lines(t) for t in rows], tokens.Counter(PATH)(rows)
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    monkeypatch.setattr(bpe, "PAIRS", 50)
    monkeypatch.setattr(tokens, "REMEMBERED", 20)
    own, count = bpe.Vocabulary(PATH), tokens.Counter(PATH)
    assert ([own.lines(t) for t in rows], [count([t])[0] for t in rows]) == full


def test_odd_rows(odd, none):
    library = Tokenizer.from_file(PATH)
    expected = sorted((r["doc_id"] or -1, len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd.collect())
    counted = tokens.count_tokens(odd, PATH).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in counted) == expected
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in counted)
    digests = bpe.digests(odd, PATH).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in digests) == expected
    empty = hashlib.sha256(b"").hexdigest()
    assert {r["ids_sha256"] for r in digests if r["doc_id"] in (1, 2, 3)} == {empty}
    assert tokens.count_tokens(none, PATH).count() == bpe.digests(none, PATH).count() == 0


def test_ids_as_a_column_decode_again(docs, odd):
    few = docs.limit(20)
    both = bpe.decode(bpe.encode(few, PATH), PATH).select("text", "ids", "decoded").collect()
    library = Tokenizer.from_file(PATH)
    assert all(list(r["ids"]) == library.encode(r["text"], add_special_tokens=False).ids for r in both)
    assert all(r["decoded"] == library.decode(list(r["ids"]), skip_special_tokens=False) for r in both)
    assert set(odd.columns) < set(bpe.encode(odd, PATH).columns)
