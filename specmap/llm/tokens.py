"""Token counts and byte-pair coding of whole texts with the files of public tokenizers.

`count_tokens` asks the tokenizer's own library, in batches balanced by bytes, and keeps lengths only. Texts are split
where no token and no normalisation can cross, so a long text costs no more memory than a short one:

* vocabularies that drop white space: at ASCII white space;
* byte-level vocabularies with the usual word pattern: before a single space between two letters;
* sentencepiece models: not split.

Units that were counted before in the same task are not encoded again.

Cases: a null text counts as empty (0 tokens); a null id stays null; repeated rows each give a row; an empty table gives
an empty one; other columns of the input are ignored.
"""
from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes in one call of the library.
BATCH_BYTES = 1 << 18
#: Units remembered in a task; what is beyond is encoded again.
REMEMBERED = 300_000


class Counter:
    """Lengths of encoded texts under one tokenizer file."""

    def __init__(self, path: str):
        import regex

        self._split, self._encode = None, None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self._encode = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
            if not model.encode(" \n\t ", add_special_tokens=False).ids:
                ascii_space = regex.compile(r"[\x20\x09-\x0D]+").split
                # str.split() also splits at four controls that are no white space to the tokenizer
                control = regex.compile(r"[\x1c-\x1f]").search
                self._split = lambda text: ascii_space(text) if control(text) else text.split()
            elif model.encode(" a", add_special_tokens=False).offsets[0][0] == 0:
                self._split = regex.compile(r"(?<=\p{L})(?= \p{L})").split
        self._known: dict[str, int] = {}
        self._dropped = 0

    def __call__(self, texts: list[str]) -> list[int]:
        known = self._known
        units = [[text] if self._split is None else self._split(text) for text in texts]
        new = set().union(*units).difference(known) if units else set()
        batch: list[str] = []
        size = 0
        for unit in new:
            batch.append(unit)
            size += len(unit)
            if size >= BATCH_BYTES:
                known.update(zip(batch, self._encode(batch), strict=True))
                batch, size = [], 0
        if batch:
            known.update(zip(batch, self._encode(batch), strict=True))
        out = [sum(map(known.__getitem__, u)) for u in units]
        if len(known) > REMEMBERED:
            for unit in new:
                del known[unit]
            self._dropped += len(new)
            if self._dropped > 20 * REMEMBERED:  # the texts may be of another kind by now
                known.clear()
                self._dropped = 0
        return out


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row; `path` is a tokenizer file that every executor has."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(path)
        for batch in batches:
            text = pc.fill_null(batch.column("text"), "")
            for rows, part in byte_runs(batch, text):
                n = pa.array(count(part.to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column("id"), pc.binary_length(part).cast(pa.int64()), n, pc.greater(n, limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(stage, "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def byte_runs(batch: pa.RecordBatch, text: pa.Array, limit: int = 1 << 22) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Runs of rows of about `limit` bytes of text."""
    lo = size = 0
    for i, n in enumerate(pc.binary_length(text).to_pylist()):
        size += n
        if size >= limit:
            yield batch.slice(lo, i + 1 - lo), text.slice(lo, i + 1 - lo)
            lo, size = i + 1, 0
    if lo < len(text):
        yield batch.slice(lo), text.slice(lo)
