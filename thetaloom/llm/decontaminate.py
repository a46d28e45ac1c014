"""Benchmark decontamination by a generalised suffix automaton over the words of test items.

Words are ``[0-9a-z and every byte from 0x80]+`` of the text with A-Z lower-cased. A window is ``size`` consecutive words
of an item, or the whole of a shorter one. A text's words stream through the automaton, which knows the length of the
longest item passage that ends at each word; where that reaches a window, the window's words are hit. Only stretches in
which every pair of neighbours also stands in an item can reach a window, so whole-array steps find these stretches
first and nothing else is streamed.

The automaton is sent to the tasks. Its size is bounded: a benchmark with more than ``SHARD_BYTES`` of text is cut into
shards by item, and each is a further step over the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thetaloom.llm.names import free_name
from thetaloom.llm.ragged import LOWER, U64, flat, joined_runs, mixed, slices, span_hashes, spans
from thetaloom.llm.workers import each

WINDOW = 10
SHARD_BYTES = 2_000_000
"""Text of test items in one automaton, in characters."""

WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True

_BITS = 1 << 20

HITS = "struct<n_words: bigint, hit_from: array<bigint>, hit_to: array<bigint>, cut_from: array<bigint>, cut_to: array<bigint>, items: array<string>>"


def words_of(data: np.ndarray, offsets: np.ndarray):
    """Starts, ends, first word of each row, and the hashes of all words."""
    lower = LOWER[data]
    starts, ends, firsts = spans(WORD[lower], offsets)
    return starts, ends, firsts, span_hashes(lower, starts, ends)


class Automaton:
    """All passages of all items: a state is a set of passages with the same occurrences."""

    def __init__(self, items: list[tuple[str, list[int]]], size: int):
        self.size = size
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        pairs, singles, self.shortest = set(), set(), size
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        #: By state: the items whose window is that passage. Of shorter items also their lengths.
        self.owners: dict[int, set[str]] = {}
        self.short: dict[int, dict[int, set[str]]] = {}
        for name, words in items:
            if not words:
                continue
            self.shortest = min(self.shortest, len(words))
            pairs.update(zip(words, words[1:], strict=False))
            singles.update(words)
            state = 0
            for at, word in enumerate(words):
                state = self.next[state][word]
                if at >= size - 1:
                    while self.length[self.link[state]] >= size:
                        state = self.link[state]
                    self.owners.setdefault(state, set()).add(name)
            if len(words) < size:
                self.short.setdefault(state, {}).setdefault(len(words), set()).add(name)
        #: The nearest state up the links, itself included, with a shorter item.
        self.near = [-1] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.near[state] = state if state in self.short else self.near[self.link[state]]
        keys = np.array(sorted(singles), U64) if self.shortest < 2 else self._pair_keys(pairs)
        self.keys = np.unique(keys)
        self.maybe = np.zeros(_BITS, bool)
        self.maybe[(self.keys & U64(_BITS - 1)).astype(np.int64)] = True

    @staticmethod
    def _pair_keys(pairs: set[tuple[int, int]]) -> np.ndarray:
        both = np.array(sorted(pairs), U64).reshape(-1, 2)
        return mixed(both[:, 0]) + both[:, 1]

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, known, word)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][word]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._clone(state, target, word)
        return new

    def _clone(self, state: int, target: int, word: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[target]))
        self.link.append(self.link[target])
        self.length.append(self.length[state] + 1)
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def stretches(self, hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of words in which a window may stand."""
        need, keys = self.shortest, hashes
        if not len(self.keys) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if need > 1:
            keys = mixed(hashes[:-1]) + hashes[1:]
            need -= 1
        member = self.maybe[(keys & U64(_BITS - 1)).astype(np.int64)]
        sure = np.flatnonzero(member)
        member[sure] = self.keys[np.minimum(np.searchsorted(self.keys, keys[sure]), len(self.keys) - 1)] == keys[sure]
        if self.shortest > 1:
            ends = firsts[(firsts > 0) & (firsts < len(hashes))] - 1
            member[ends] = False
            starts, stops, _ = spans(member, np.array([0, len(member)]))
        else:
            starts, stops, _ = spans(member, firsts)
        long = stops - starts >= need
        return starts[long], stops[long] + (self.shortest > 1)

    def walk(self, words: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """The hit ranges of a stretch of words, in order of their ends, and the items that hit."""
        state, length, hits, found = 0, 0, [], set()
        following, link, lengths, size = self.next, self.link, self.length, self.size
        for at, word in enumerate(words):
            while state and word not in following[state]:
                state = link[state]
                length = lengths[state]
            if word not in following[state]:
                continue
            state = following[state][word]
            length += 1
            if length >= size:
                top = state
                while lengths[link[top]] >= size:
                    top = link[top]
                hits.append((at + 1 - size, at + 1))
                found |= self.owners[top]
            mark = self.near[state]
            while mark > 0:
                for own, names in self.short[mark].items():
                    if own <= length:
                        hits.append((at + 1 - own, at + 1))
                        found |= names
                mark = self.near[link[mark]] if link[mark] > 0 else -1
        return hits, found


@lru_cache(maxsize=4)
def _automaton(items: tuple[tuple[str, str | None], ...], size: int) -> Automaton:
    if not items:
        return Automaton([], size)
    data, offsets = flat(pa.array([text for _, text in items], pa.string()))
    _, _, firsts, hashes = words_of(data, offsets)
    each = hashes.tolist()
    return Automaton([(name, each[firsts[i] : firsts[i + 1]]) for i, (name, _) in enumerate(items)], size)


def found_in(texts: pa.Array, automaton: Automaton) -> pa.StructArray:
    """Per text: its number of words, the hit ranges in words and in UTF-8 bytes, and the items with windows in it."""
    data, offsets = flat(texts)
    out: list[list] = [[], [], [], [], [], []]
    for low, high in slices(offsets):
        part, places = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        starts, ends, firsts, hashes = words_of(part, places)
        rows: dict[int, tuple[list, set]] = {}
        for a, b in zip(*automaton.stretches(hashes, firsts), strict=True):
            hits, items = automaton.walk(hashes[a:b].tolist())
            if hits:
                # The last row that starts at or before the word; empty rows before it start there too.
                mine = rows.setdefault(int(np.searchsorted(firsts, a, "right")) - 1, ([], set()))
                mine[0].extend((int(a) + x, int(a) + y) for x, y in hits)
                mine[1].update(items)
        for row in range(high - low):
            hits, items = rows.get(row, ((), ()))
            first = firsts[row]
            both = np.array(sorted(hits), np.int64).reshape(-1, 2)
            begin, stop = joined_runs(both[:, 0], both[:, 1])
            values = (int(firsts[row + 1] - first), begin - first, stop - first, starts[begin] - places[row], ends[stop - 1] - places[row], sorted(items))
            for column, value in zip(out, values, strict=True):
                column.append(value)
    ranges = pa.list_(pa.int64())
    kinds = [pa.int64(), ranges, ranges, ranges, ranges, pa.list_(pa.string())]
    return pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["n_words", "hit_from", "hit_to", "cut_from", "cut_to", "items"])


def item_shards(benchmark: DataFrame, item: str, text: str, shard_bytes: int = SHARD_BYTES) -> list[tuple]:
    """The items in shards of about ``shard_bytes``, each a tuple of (item id as text, text). Items without text or
    words have no window. The shards are read one by one, so the driver holds what the automata hold."""
    chosen = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text}`").cast("string").alias("text")).where("text is not null")
    total = chosen.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    count = int(-(-total // shard_bytes)) or 1
    number = F.pmod(F.xxhash64("item", "text"), F.lit(count))
    return [tuple(sorted((row.item, row.text) for row in chosen.where(number == shard).collect())) for shard in range(count)]


def hits(text: Column, shards: list[tuple], window: int = WINDOW) -> list[Column]:
    """One struct column for each shard: what its items hit in the text."""

    def step(items: tuple) -> Column:
        key = hashlib.sha256(repr(items).encode()).hexdigest()  # the function differs wherever the items do

        @F.arrow_udf(HITS)
        def hit(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            assert key
            yield from each(lambda batch: found_in(batch, _automaton(items, window)), texts, _automaton.cache_clear)

        return hit(text)

    return [step(items) for items in shards]


def _merged(starts: list[str], stops: list[str]) -> Column:
    """The union of sorted half-open ranges of several shards as an array of (a, b)."""
    pairs = F.array_sort(F.flatten(F.array(*[F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in zip(starts, stops, strict=True)])))
    if len(starts) == 1:
        return pairs
    kind = "array<struct<a: bigint, b: bigint>>"
    last = lambda done: F.element_at(done, -1)
    return F.aggregate(
        pairs,
        F.array().cast(kind),
        lambda done, x: F.when(
            (F.size(done) > 0) & (x.a <= F.coalesce(last(done).b, F.lit(-1))),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last(done).a.alias("a"), F.greatest(last(done).b, x.b).alias("b")))),
        ).otherwise(F.concat(done, F.array(x))),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", name: str = "contamination", window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with a struct ``name``: ``n_words``, ``hits`` (ranges of words), ``cuts`` (the same in UTF-8 bytes),
    ``n_hit`` and the sorted ``items``. A null or empty text has no words; an empty benchmark hits nothing. Repeated
    rows are judged alike."""
    shards = item_shards(benchmark, item, item_text, shard_bytes)
    steps = [free_name(docs, f"{name}_{i}") for i in range(len(shards))]
    for step, column in zip(steps, hits(F.col(f"`{text}`"), shards, window), strict=True):
        docs = docs.withColumn(step, column)
    over = lambda field: [f"{step}.{field}" for step in steps]
    ranges = free_name(docs, f"{name}_hits")
    docs = docs.withColumn(ranges, _merged(over("hit_from"), over("hit_to")))
    result = F.struct(
        F.col(f"{steps[0]}.n_words").alias("n_words"),
        F.col(ranges).alias("hits"),
        _merged(over("cut_from"), over("cut_to")).alias("cuts"),
        F.aggregate(ranges, F.lit(0).cast("bigint"), lambda n, x: n + x.b - x.a).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(x) for x in over("items")])))).alias("items"),
    )
    return docs.withColumn(name, result).drop(*steps, ranges)


def without_cuts(text: Column, cuts: Column) -> Column:
    """The text with its byte ranges ``cuts`` taken out. Ranges begin and end at words, hence at characters."""
    raw = text.cast("binary")
    ends = F.concat(F.transform(cuts, lambda x: x.a), F.array(F.octet_length(text).cast("bigint")))
    begins = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(cuts, lambda x: x.b))
    kept = F.zip_with(begins, ends, lambda a, b: raw.substr((a + 1).cast("int"), (b - a).cast("int")).cast("string"))
    return F.when(F.size(cuts) > 0, F.array_join(kept, "")).otherwise(text)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", max_coverage: float = 0.5, min_span: int = 1, **names) -> DataFrame:
    """``docs`` with hit spans of ``min_span`` words and more cut from the text. A text of which more than
    ``max_coverage`` is hit goes as a whole row; rows without hits stay as they are."""
    name = free_name(docs, "contamination")
    judged = contamination(docs, benchmark, text, name=name, **names)
    hit = F.col(name)
    spans_ = F.filter(F.arrays_zip(hit.hits.alias("words"), hit.cuts.alias("bytes")), lambda x: x.words.b - x.words.a >= min_span)
    kept = judged.where((hit.n_hit == 0) | (hit.n_hit <= max_coverage * hit.n_words))
    return kept.withColumn(text, without_cuts(F.col(f"`{text}`"), F.transform(spans_, lambda x: x.bytes))).drop(name)
