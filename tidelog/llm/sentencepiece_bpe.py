"""SentencePiece encoding and decoding for merge-type vocabularies.

The text is normalised as the model asks (a leading space; spaces and U+2581 are one
symbol, here the space) and cut before each run of spaces that follows another character.
No piece of the vocabulary spans such a place (checked when the model is loaded; otherwise the text stays
whole), so each unit is merged on its own: an agenda holds the adjacent symbol pairs
whose concatenation is a piece, the highest score comes first, then the leftmost.
What is left and no piece falls back to its bytes. Each unit that a worker sees for
the first time is checked against the sentencepiece library in the Arrow batch, as is
one whole text of every batch, and a difference is an error; decoding is the library's.

Defined results: null and empty texts have no ids (n_tokens 0, hashes of the empty
string); null or repeated doc_ids pass through, one row out per row in; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, held_by

SPACE = "▁"
NONE = 1 << 60
UNIT = re.compile(" +[^ ]*")


class MergeVocabulary:
    """The pieces of a loaded model, with the agenda that merges them."""

    def __init__(self, processor, short: int = 40, cached: int = 200_000, check: bool = True):
        self.sp = processor
        self.short, self.cached, self.check = short, cached, check
        n = processor.get_piece_size()
        normal = [i for i in range(n) if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i) or processor.is_unused(i))]
        self.ids = {processor.id_to_piece(i).replace(SPACE, " "): i for i in normal}
        level = {s: k for k, s in enumerate(sorted({processor.get_score(i) for i in normal}, reverse=True))}
        self.rank = {p: level[processor.get_score(i)] for p, i in self.ids.items()}
        self.bytes = {}
        for i in range(n):
            if processor.is_byte(i):
                self.bytes[int(processor.id_to_piece(i)[3:-1], 16)] = i
        self.unknown = processor.unk_id()
        self.cuts = not any(a != " " and b == " " for p in self.ids for a, b in zip(p, p[1:]))
        self.text_of = [str(i) for i in range(n)]
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merge_few(self, symbols: list[str]) -> list[str]:
        """The agenda as a list in text order: for short units."""
        rank = self.rank.get
        agenda = [rank(a + b, NONE) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := min(agenda)) != NONE:
            i = agenda.index(best)
            symbols[i] = both = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + both, NONE)
            if i < len(agenda):
                agenda[i] = rank(both + symbols[i + 1], NONE)
        return symbols

    def merge_many(self, symbols: list[str]) -> list[str]:
        """The agenda as a heap over linked symbols: n log n for units of any length."""
        n = len(symbols)
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            r = self.rank.get(both := symbols[i] + symbols[j])
            if r is not None:
                heapq.heappush(heap, (r, i, j, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if not symbols[i] or after[i] != j or not symbols[j] or symbols[i] + symbols[j] != both:
                continue
            symbols[i], symbols[j] = both, ""
            after[i] = after[j]
            if after[i] < n:
                ahead[after[i]] = i
                offer(i, after[i])
            if ahead[i] >= 0:
                offer(ahead[i], i)
        return [s for s in symbols if s]

    def merge(self, unit: str) -> tuple[int, ...]:
        out: list[int] = []
        for s in self.merge_few(list(unit)) if len(unit) <= self.short else self.merge_many(list(unit)):
            i = self.ids.get(s)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in s.encode()]
            else:
                out.append(self.unknown)
        return tuple(out)

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        plain = " " + text.replace(SPACE, " ")
        return UNIT.findall(plain) if self.cuts else [plain]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text. Units are kept in two generations of at most `cached` and a
        batch; what is met again moves to the newer one, the older one is then dropped."""
        out, fresh = [], []
        known, older = self.known, self.older
        for t in texts:
            ids: list[int] = []
            for u in self.units(t):
                got = known.get(u)
                if got is None:
                    got = older.get(u)
                    if got is None:
                        got = self.merge(u)
                        fresh.append((u, got))
                    if len(u) <= self.short:
                        known[u] = got
                ids += got
            out.append(ids)
            if len(known) > self.cached:
                self.older = older = known
                self.known = known = {}
        if self.check and fresh:
            # the library puts one space before a text: give it the unit without its first
            for (u, mine), ids in zip(fresh, self.sp.encode([u[1:] for u, _ in fresh], num_threads=1), strict=True):
                if len(u) > 1 and mine != tuple(ids):
                    raise ValueError(f"the merged ids of {u[:80]!r} differ from the library's")
        return out


    def check_whole(self, texts: list[str], ids: list[list[int]], most: int = 4000) -> None:
        """One text of the batch as a whole, the longest up to `most` characters: that the
        cuts are right, too."""
        fits = [i for i, t in enumerate(texts) if len(t) <= most]
        if self.check and fits:
            i = max(fits, key=lambda i: len(texts[i]))
            if ids[i] != self.sp.encode(texts[i]):
                raise ValueError(f"the ids of {texts[i][:80]!r} differ from the library's")


#: Names the vocabularies among what a worker holds.
OWNER = "sentencepiece"


@lru_cache(maxsize=2)
def vocabulary(path: str | None = None) -> MergeVocabulary:
    """Held, with the units it has seen, until another operator runs in the worker."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    held_by(OWNER, vocabulary.cache_clear)
    return MergeVocabulary(sentencepiece.SentencePieceProcessor(model_file=path))


def digest(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def _encoded(docs: DataFrame, model_path: str | None, chunk: int, columns: Callable, schema: str) -> DataFrame:
    """doc_id and what `columns` makes of the ids and decoded texts of `chunk` documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path)
        for b in batches:
            for at in range(0, b.num_rows, chunk):
                part = b.slice(at, chunk)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = v.encode_batch(texts)
                v.check_whole(texts, ids)
                yield pa.RecordBatch.from_arrays([part.column(0), *columns(v, ids, v.sp.decode(ids, num_threads=1))], [x.split()[0] for x in schema.split(", ")])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, schema, owner=OWNER)


def sentencepiece_encode(docs: DataFrame, model_path: str | None = None, chunk: int = 128) -> DataFrame:
    """One row per document: doc_id, ids and the text decoded from them."""
    columns = lambda v, ids, texts: [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
    return _encoded(docs, model_path, chunk, columns, "doc_id long, ids array<int>, decoded string")


def sentencepiece_round_trip(docs: DataFrame, model_path: str | None = None, chunk: int = 128) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256. Digests are made
    in the batch, so ids and texts don't leave the worker."""

    def columns(v: MergeVocabulary, ids: list[list[int]], texts: list[str]) -> list[pa.Array]:
        return [pa.array(map(len, ids), pa.int64()), pa.array([digest(",".join([v.text_of[i] for i in x])) for x in ids], pa.string()), pa.array(map(digest, texts), pa.string())]

    return _encoded(docs, model_path, chunk, columns, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
