"""Exact byte-pair encoding in linear time, and decoding through an offset table.

A vocabulary with word ends is read from its JSON file. Each pre-token is written over an alphabet of bytes and final
bytes (a byte with the end-of-word mark), so a merge of the file is a concatenation. An Aho-Corasick automaton over all
tokens gives the longest token that starts at each place. Encoding takes the longest token, accepts it if it may stand
next to the token before it, otherwise tries the next shorter one, and steps back if none is left; a place once found
impossible is not entered again. Two tokens may stand side by side if merging their joint text gives just these two:
this table of pairs is filled as pairs come up. A sequence whose neighbours are all compatible is the one that the merges
give, in whatever order they are applied.

Cases: a null text counts as empty: no ids, an empty decoded text; special strings in a text become their ids; a null id
stays null; repeated rows each give a row; an empty table gives an empty one; other columns are ignored by `digests`,
kept by `encode` and `decode`.
"""
from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specmap.llm.tokens import byte_runs

#: Distinct units and words remembered in a task, and pairs in the table; what is beyond is worked out again.
REMEMBERED = 200_000
PAIRS = 1_000_000
_FINAL = 256
#: Unicode's White_Space
_SPACE = r"\t-\r \x85\xa0  -     　"


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and pre-tokenisation of a vocabulary file with word ends."""

    def __init__(self, path: str):
        import ahocorasick
        import unicodedata

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, mark = spec["model"], spec["model"]["end_of_word_suffix"]
        byte = {c: b for b, c in enumerate(_byte_letters())}

        def symbols(token: str) -> str:
            body = token.removesuffix(mark) if token.endswith(mark) and token != mark else token
            chars = [chr(byte[c]) for c in body]
            if body != token:
                chars[-1] = chr(ord(chars[-1]) + _FINAL)
            return "".join(chars)

        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        #: token i is names[offsets[i]:offsets[i + 1]]
        self.offsets, self.names, parts = [0], "", []
        for i in range(max(names) + 1):
            parts.append(names.get(i, ""))
            self.offsets.append(self.offsets[-1] + len(parts[-1]))
        self.names = "".join(parts)
        self.text = {i: symbols(t) for t, i in model["vocab"].items()}
        self.id = {t: i for i, t in self.text.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for n, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right = self.id[symbols(a)], self.id[symbols(b)]
            self.rank.setdefault((left, right), (n, self.id[symbols(a) + symbols(b)]))
        self._longest = ahocorasick.Automaton()
        for t, i in self.id.items():
            self._longest.add_word(t[::-1], (len(t), i))
        self._longest.make_automaton()
        self._size = {i: len(t) for i, t in self.text.items()}
        #: the merge that makes a token, and whether every token has one that comes after those of its parts
        self._made: dict[int, tuple[int, int, int]] = {}
        self._ordered = True
        for (left, right), (n, new) in self.rank.items():
            below = max(self._made.get(left, (0, 0, -1))[2], self._made.get(right, (0, 0, -1))[2])
            self._ordered &= new not in self._made and below < n
            self._made.setdefault(new, (left, right, n))
        self._pairs: dict[tuple[int, int], bool] = {}
        self._alone: dict[int, bool] = {}
        self._edges: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self._shorter: dict[int, int | None] = {}
        self._nfc = unicodedata
        self._words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+").findall
        self._specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else lambda t: [t]
        self._word_ids: dict[str, list[int]] = {}
        self._unit_ids: dict[str, str] = {}
        self._unit_names: dict[str, str] = {}
        self._dropped = 0

    def merged(self, text: str) -> list[int]:
        """What the merges make of `text`, by applying the first of them again and again."""
        ids = [self.id[c] for c in text]
        while len(ids) > 1:
            best = min(((self.rank[p], i) for i in range(len(ids) - 1) if (p := (ids[i], ids[i + 1])) in self.rank), default=None)
            if best is None:
                break
            (_, new), i = best
            ids[i : i + 2] = [new]
        return ids

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens at the right (side 1) or left (side 0) edge of `token` while it is merged, each with the rank at which
        it is merged further."""
        if (known := self._edges.get((token, side))) is None:
            known, part, until = [], token, float("inf")
            while True:
                known.append((part, until))
                if part not in self._made:
                    break
                until, part = self._made[part][2], self._made[part][side]
            self._edges[token, side] = known
        return known

    def _crossed(self, left: int, right: int) -> bool:
        """Would some merge join parts of both tokens before each is whole? On equal rank the left place goes first."""
        rank = self.rank
        for x, x_until in self._edge(left, 1):
            for y, y_until in self._edge(right, 0):
                m = rank.get((x, y))
                if m is not None and m[0] < x_until and m[0] <= y_until:
                    return True
        return False

    def _fits(self, left: int | None, right: int) -> bool:
        if left is None:
            if (known := self._alone.get(right)) is None:
                known = self._alone[right] = self.merged(self.text[right]) == [right]
            return known
        if (known := self._pairs.get((left, right))) is None:
            known = self._fits(None, right)
            if known and self._ordered:
                known = not self._crossed(left, right)
            elif known:
                known = self.merged(self.text[left] + self.text[right]) == [left, right]
            if len(self._pairs) > PAIRS:
                self._pairs.clear()
            self._pairs[left, right] = known
        return known

    def _next_shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of `token`."""
        if token not in self._shorter:
            t = self.text[token]
            self._shorter[token] = next((self.id[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.id), None)
        return self._shorter[token]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        raw = word.encode("utf-8", "replace").decode("latin-1")
        text = raw[:-1] + chr(ord(raw[-1]) + _FINAL)
        n = len(text)
        longest = [-1] * n
        # matches of the reversed text end where tokens of the text begin, the longest first
        place = n
        for end, (_, token) in self._longest.iter(text[::-1]):
            if n - 1 - end != place:
                place = n - 1 - end
                longest[place] = token
        pairs, size, shorter = self._pairs, self._size, self._shorter
        ids: list[int] = []
        closed: set[int] = set()
        at, last, token = 0, None, longest[0]
        while at < n:
            while token is not None:
                end = at + size[token]
                if end not in closed:
                    fits = pairs.get((last, token))
                    if self._fits(last, token) if fits is None else fits:
                        break
                token = shorter[token] if token in shorter else self._next_shorter(token)
            if token is None:
                closed.add(at)
                token = ids.pop()
                at -= size[token]
                last = ids[-1] if ids else None
                token = self._next_shorter(token)
            else:
                ids.append(token)
                at, last = end, token
                token = longest[at] if at < n else None
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; its special strings become their ids."""
        ids: list[int] = []
        known = self._word_ids
        for piece in self._specials(text) if "<|" in text else (text,):
            if piece in self.special:
                ids.append(self.special[piece])
            elif piece:
                # letter by letter, so that a final sigma is lowered like any other
                for word in self._words(self._nfc.normalize("NFC", piece).replace("Σ", "σ").lower()):
                    if (got := known.get(word)) is None:
                        got = self.encode_word(word)
                        if len(word) <= 64:
                            known[word] = got
                    ids += got
        if len(known) > REMEMBERED:
            for word in list(known)[REMEMBERED // 2 :]:
                del known[word]
        return ids

    def decode(self, ids: list[int]) -> str:
        at, names = self.offsets, self.names
        return " ".join([names[at[i] : at[i + 1]] for i in ids])

    def lines(self, text: str) -> tuple[str, str]:
        """The decimal ids of a whole text, joined by one space, and the text they decode to. The text is taken in the
        units between white space: no token crosses it, and none is made of it."""
        control = _CONTROL(text) is not None
        parts = [p for p in _ASCII_SPACE.split(text) if p] if control else text.split()
        ids, names = self._unit_ids, self._unit_names
        new = set(parts).difference(ids)
        for p in new:
            got = self.encode(p)
            ids[p], names[p] = " ".join(map(str, got)), self.decode(got)
        if control:
            parts = [p for p in parts if ids[p]]
        out = " ".join(map(ids.__getitem__, parts)), " ".join(map(names.__getitem__, parts))
        if len(ids) > REMEMBERED:
            for p in new:
                del ids[p], names[p]
            self._dropped += len(new)
            if self._dropped > 20 * REMEMBERED:  # the texts may be of another kind by now
                ids.clear(), names.clear()
                self._dropped = 0
        return out


_ASCII_SPACE = regex.compile(r"[\x20\x09-\x0D]+")
#: str.split() also splits at these, which are no white space to the tokenizer
_CONTROL = regex.compile(r"[\x1c-\x1f]").search


_held: dict[str, Vocabulary] = {}


def of_worker(path: str) -> Vocabulary:
    """The vocabulary of a file, made once in each Python worker: its tables and what it remembers serve all tasks."""
    if path not in _held:
        _held.clear()
        _held[path] = Vocabulary(path)
    return _held[path]


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of the whole text of every row."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = of_worker(path)
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for batch in batches:
            for rows, part in byte_runs(batch, pc.fill_null(batch.column("text"), "")):
                n, ids, back = [], [], []
                for text in part.to_pylist():
                    line, decoded = vocabulary.lines(text)
                    n.append(line.count(" ") + 1 if line else 0)
                    ids.append(sha(line))
                    back.append(sha(decoded))
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(stage, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """`docs` with the ids of each whole text in `ids_col` (which replaces a column of that name)."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = Vocabulary(path)
        for texts in batches:
            yield texts.map(lambda t: list(map(int, vocabulary.lines(t or "")[0].split())))

    return docs.withColumn(ids_col, ids(F.col(text_col).cast("string")))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """`docs` with the decoded text of `ids_col` in `text_col`; null ids decode to the empty text."""

    @F.pandas_udf(T.StringType())
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = Vocabulary(path)
        for ids in batches:
            yield ids.map(lambda x: "" if x is None else vocabulary.decode(list(x)))

    return docs.withColumn(text_col, text(F.col(ids_col)))
