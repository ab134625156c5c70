"""Token counts: the tokenizers library encodes byte-balanced batches in Arrow
functions and only lengths come back.

Defined results: a null text counts as an empty one (0 bytes, 0 tokens); null or
repeated ids pass through, one output row per input row; an empty table gives an
empty result; other columns of the input are ignored. A text is cut only before a
space between two word characters, where the byte-level pre-tokenizer always starts
a new piece, so the counts add up to the count of the whole text; a text without
such a place stays whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, by_weight

#: Inside a run of word characters, single spaces are where pieces start.
SAFE = re.compile(r"(?<=\w) (?=\w)")


def encoded_length(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def pieces(text: str, limit: int) -> list[str]:
    """The text in parts of about `limit` UTF-8 bytes, by its mean bytes a character, cut at
    safe places."""
    step = max(1, limit * len(text) // max(1, encoded_length(text)))
    out, start = [], 0
    while len(text) - start > step:
        m = SAFE.search(text, start + step)
        if not m:
            break
        out.append(text[start : m.start()])
        start = m.start()
    out.append(text[start:])
    return out


@lru_cache(maxsize=2)
def _tokenizer(path: str | None):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    made = tokenizers.Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def count_batch(texts: list[str], path: str | None, cut: int, batch_bytes: int) -> list[int]:
    tok = _tokenizer(path)
    counts = [0] * len(texts)
    parts, owner = [], []
    for i, t in enumerate(texts):
        for p in pieces(t, cut):
            parts.append(p)
            owner.append(i)
    for s in by_weight(list(map(encoded_length, parts)), batch_bytes):
        for i, e in zip(owner[s], tok.encode_batch_fast(parts[s], add_special_tokens=False), strict=True):
            counts[i] += len(e)
    return counts


def token_counts(docs: DataFrame, tokenizer_path: str | None = None, limit: int = 512, cut: int = 16_384, batch_bytes: int = 262_144) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = count_batch(texts, tokenizer_path, cut, batch_bytes)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    src = docs.select(F.col("doc_id").cast("long"), F.col("text"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return arrow_map(src, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
