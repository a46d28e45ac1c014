"""BPE encoding and decoding with a public vocabulary of word ends.

A text is cut at special tokens, brought to NFC and lower case, and split into pieces by the vocabulary's pattern. The
bytes of a piece are its first symbols, the last one marked as a word end. A priority queue holds the merges that are
possible over a doubly linked list of symbols, least rank first and leftmost among equals; an entry whose symbols have
changed since is stale and skipped. Decoding joins the vocabulary strings of the ids.

Pieces never reach over white space, so a text is looked up word by word; words are worked out once and kept, in two
generations of bounded size.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import normalizers

from thetaloom.llm.names import free_name
from thetaloom.llm.workers import release

KEPT_WORDS, KEPT_PIECES = 60_000, 150_000
"""Words and pieces in one of the two generations that a Python worker keeps."""
ROWS_OUT = 512
"""Rows of an output batch at most."""
BYTES_OUT = 16_000_000
"""Bytes of ids of an output batch, about."""

NFC = normalizers.NFC()
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Python counts these as white space and Unicode doesn't.
SEPARATORS = re.compile("[\x1c-\x1f]")


def category(first: str) -> str:
    """The characters of a general category, such as L, as ranges of a pattern's character class."""
    member = np.fromiter((unicodedata.category(chr(x))[0] == first for x in range(0x110000)), bool, 0x110000)
    edges = np.flatnonzero(np.diff(np.r_[False, member, False].astype(np.int8))).reshape(-1, 2).tolist()
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges)


@lru_cache(maxsize=1)
def pieces_pattern() -> re.Pattern:
    letter, number = category("L"), category("N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{SPACES}{letter}{number}]+")


def byte_symbols() -> list[str]:
    """A printable character for each byte: itself where it is printable, else one from U+0100 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Generations(dict):
    """A dict that works out missing values, and forgets those not asked for since the last generation."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        special = {x["content"]: x["id"] for x in content["added_tokens"]}
        self.strings = [""] * (max([*vocab.values(), *special.values()]) + 1)
        for string, at in [*vocab.items(), *special.items()]:
            self.strings[at] = string
        self.special = {string: np.uint32(at).tobytes() for string, at in special.items()}
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.first = [vocab[symbol] for symbol in byte_symbols()]
        self.last = [vocab[symbol + end] for symbol in byte_symbols()]
        #: (left id, right id) as one integer, to the rank; and by rank the id of both together.
        self.ranks = {vocab[a] << 32 | vocab[b]: rank for rank, (a, b) in enumerate(model["merges"])}
        self.both = [vocab[a + b] for a, b in model["merges"]]
        self.pattern = pieces_pattern()
        self.pieces = Generations(lambda piece: np.array(self.merged(piece.encode()), "<u4").tobytes(), KEPT_PIECES)
        self.words = Generations(self._word, KEPT_WORDS)

    def merged(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        first, rank_of, both = self.first, self.ranks.get, self.both
        ids = [first[b] for b in piece]
        ids[-1] = self.last[piece[-1]]
        count = len(ids)
        after, before = [*range(1, count), -1], [*range(-1, count - 1)]
        # An entry is the rank and, below it, the place of the left symbol.
        queue = [rank << 40 | at for at, rank in enumerate(map(rank_of, (a << 32 | b for a, b in zip(ids, ids[1:], strict=False)))) if rank is not None]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            rank, at = entry >> 40, entry & 0xFFFFFFFFFF
            right = after[at]
            if right < 0 or ids[at] < 0 or rank_of(ids[at] << 32 | ids[right]) != rank:
                continue
            ids[at], ids[right] = new, _ = both[rank], -1
            after[at] = following = after[right]
            if following >= 0:
                before[following] = at
                if (found := rank_of(new << 32 | ids[following])) is not None:
                    heappush(queue, found << 40 | at)
            left = before[at]
            if left >= 0 and (found := rank_of(ids[left] << 32 | new)) is not None:
                heappush(queue, found << 40 | left)
        return [x for x in ids if x >= 0]

    def _word(self, word: str) -> bytes:
        # A capital sigma is lowered by itself, wherever in a word it stands.
        # The library's own NFC is taken, since it knows fewer combining marks than Python's.
        plain = word.lower() if word.isascii() else NFC.normalize_str(word).replace("Σ", "σ").lower()
        return self.pieces[plain] if plain.isalpha() else b"".join(map(self.pieces.__getitem__, self.pattern.findall(plain)))

    def forget(self) -> None:
        """Drop the kept words and pieces: a worker that goes on to other work doesn't hold them."""
        for kept in (self.words, self.pieces):
            kept.clear()
            kept.old = {}

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.cut is not None and "<|" in text:
            return b"".join(self.special[part] if part in self.special else self._plain(part) for part in self.cut.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if SEPARATORS.search(text):
            return self._word(text)
        return b"".join(map(self.words.__getitem__, text.split()))

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encoded(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with ``ids`` (binary: little-endian unsigned 32-bit integers) and ``decoded``, the text back from the
    ids. A null text counts as empty: no ids, an empty string. Where ``docs`` has columns of these names, the new ones
    get underscores before theirs. ``path`` is the vocabulary file, the same on every executor."""
    ids, decoded = free_name(docs, ids), free_name(docs, decoded)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())])
    column = docs.columns.index(text)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)

        def batch_of(batch, start, codes):
            part = batch.slice(start, len(codes))
            added = [pa.array(codes, pa.binary()), pa.array(map(known.decode, codes), pa.string())]
            return pa.RecordBatch.from_arrays([*part.columns, *added], names=[*batch.schema.names, ids, decoded])

        for batch in batches:
            start, size, codes = 0, 0, []
            for value in batch.column(column):
                codes.append(known.encode(value.as_py() or ""))
                size += len(codes[-1])
                if len(codes) == ROWS_OUT or size > BYTES_OUT:
                    yield batch_of(batch, start, codes)
                    start, size, codes = start + len(codes), 0, []
            if codes:
                yield batch_of(batch, start, codes)
        known.forget()
        release()

    return docs.mapInArrow(encode, schema)
