"""Near duplicates by SimHash fingerprints and an index of masked bit patterns in Gray order.

A fingerprint has a bit set if more than half of the text's shingle hashes have it, repeats included. Texts whose
fingerprints differ in at most ``DISTANCE`` bits are linked.

The index has two parts. Its upper nodes are masked patterns (mask, shared bits) that Spark deals the distinct
fingerprints to: the free bits are cut into one part more than may differ, so two near fingerprints share all bits of some
part and meet in the node of that part. A node of more than ``NODE`` members is divided again by its free bits, in the same
way, so that no node is a large task, whatever its fingerprints have in common; members are distinct, so the bits run out
at last. Inside a node the members stand in Gray order, in which neighbours differ in few bits. Runs of ``FAN`` form lower
nodes, each with the bits that all of its members share, and these again. Pairs of nodes are followed downwards from the
root, and a whole pair of groups goes as soon as the bits that each of them shares differ in more than ``DISTANCE`` places.
Pairs of groups that links have joined already go too: only as many links leave a task as join its components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from thetaloom.llm.components import components
from thetaloom.llm.ragged import U64
from thetaloom.llm.scratch import written

DISTANCE = 3
"""Bits in which linked fingerprints differ at most."""
NODE = 4096
"""Members of an upper node beyond which it is divided."""
DEPTH = 4
"""How often nodes are divided at most: about 20 bits are free then, and so many members in Gray order are neighbours."""
FAN = 8
"""Children of a lower node."""
SHARD = 100_000
"""Fingerprints of upper nodes that one group of rows takes, about."""
STEP = 500_000
"""Pairs of nodes, and shingle hashes, that one step in a task works on."""


def shingle_hashes(text: str | None, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``size`` words joined by spaces, A-Z lower-cased, repeats included; of the whole sequence where
    it is shorter, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, U64)
    runs = zip(*[words[at:] for at in range(size)], strict=False) if len(words) >= size else [words]
    return np.fromiter(map(xxh64_intdigest, map(b" ".join, runs), repeat(seed)), U64, max(len(words) - size + 1, 1))


def majorities(sets: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each list of hashes: zero where it is empty."""
    counts = np.zeros((len(sets), 64), np.int64)
    sizes = np.array([len(x) for x in sets], np.int64)
    hashes = np.concatenate([*sets, np.zeros(0, U64)])
    owner = np.repeat(np.arange(len(sets)), sizes)
    for low in range(0, len(hashes), STEP):
        bits = np.unpackbits(np.ascontiguousarray(hashes[low : low + STEP], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        mine = owner[low : low + STEP]
        first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
        counts[mine[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(U64)


def signatures(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, waiting, many = [], [], 0
        for text in batch.column("text"):
            waiting.append(shingle_hashes(text.as_py(), size))
            many += len(waiting[-1])
            if many >= STEP // 4:
                found.append(majorities(waiting))
                waiting, many = [], 0
        found.append(majorities(waiting))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate(found).view(np.int64))], names=["id", "fingerprint"])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the order in which successive codes differ in one bit."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> U64(shift)
    return rank


def divided(free: int, parts: int = DISTANCE + 1) -> list[int]:
    """The bits set in ``free`` in ``parts`` masks of about equal size, from the lowest on."""
    bits = [b for b in range(64) if free >> b & 1]
    return [sum(1 << b for b in bits[len(bits) * i // parts : len(bits) * (i + 1) // parts]) for i in range(parts)]


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Levels:
    """Lower nodes of several upper nodes at once. Level 0 is the fingerprints, sorted by (upper node, Gray rank); every
    further level has runs of ``FAN`` of the one below, which don't cross upper nodes."""

    def __init__(self, fingerprints: np.ndarray, begins: np.ndarray):
        self.pattern, self.shared = [fingerprints], [np.full(len(fingerprints), ~U64(0))]
        self.first: list[np.ndarray] = []
        """Per level above 0: where each node's children begin on the level below, and the end."""
        roots = begins
        while len(self.pattern[-1]) > len(roots):
            size = len(self.pattern[-1])
            counts = np.diff(np.r_[roots, size])
            place = np.arange(size) - np.repeat(roots, counts)
            first = np.flatnonzero(place % FAN == 0)
            every, some = np.bitwise_and.reduceat(self.pattern[-1], first), np.bitwise_or.reduceat(self.pattern[-1] | ~self.shared[-1], first)
            shared = np.bitwise_and.reduceat(self.shared[-1], first) & ~(every ^ some)
            self.pattern.append(every & shared)
            self.shared.append(shared)
            self.first.append(np.r_[first, size])
            roots = np.searchsorted(first, roots)

    def near(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        apart = (self.pattern[level][a] ^ self.pattern[level][b]) & self.shared[level][a] & self.shared[level][b]
        return np.bitwise_count(apart) <= DISTANCE

    def joined(self, label: np.ndarray) -> list[np.ndarray]:
        """Per level and node the label that all of its members have, -1 where they differ."""
        out, low, high = [label], label, label
        for first in self.first:
            low, high = np.minimum.reduceat(low, first[:-1]), np.maximum.reduceat(high, first[:-1])
            out.append(np.where(low == high, low, -1))
        return out

    def below(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of children of pairs of nodes; of a node with itself, each pair once and each child with itself."""
        first = self.first[level - 1]
        n_a, n_b = first[a + 1] - first[a], first[b + 1] - first[b]
        count = n_a * n_b
        place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        width = np.repeat(n_b, count)
        left, right = np.repeat(first[a], count) + place // width, np.repeat(first[b], count) + place % width
        once = left <= right
        return left[once], right[once]


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (the smallest member of each one's component) after the links ``a``, ``b``."""
    label = label.copy()
    while True:
        one, other = label[a], label[b]
        open_ = one != other
        if not open_.any():
            return label
        a, b = a[open_], b[open_]
        np.minimum.at(label, np.maximum(one, other)[open_], np.minimum(one, other)[open_])
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label = further


def node_links(table: pa.Table) -> pa.Table:
    """Of upper nodes (mask, fingerprint), links (a, b) that join all fingerprints that near pairs inside a node join."""
    mask, fingerprint = (table.column(x).to_numpy().view(U64) for x in ("mask", "fingerprint"))
    order = np.lexsort((gray_rank(fingerprint), fingerprint & mask, mask))
    mask, fingerprint = mask[order], fingerprint[order]
    shared = fingerprint & mask
    new = np.r_[True, (mask[1:] != mask[:-1]) | (shared[1:] != shared[:-1])]
    node = np.cumsum(new) - 1
    several = np.bincount(node)[node] > 1 if len(node) else new
    fingerprint, node = fingerprint[several], node[several]
    out = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(fingerprint):
        begins = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        label = _components(Levels(fingerprint, begins), fingerprint, node)
        other = np.flatnonzero(label != np.arange(len(label)))
        out = (fingerprint[other].view(np.int64), fingerprint[label[other]].view(np.int64))
    return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})


def _components(levels: Levels, fingerprint: np.ndarray, node: np.ndarray) -> np.ndarray:
    at = np.arange(len(fingerprint))
    # Neighbours in Gray order first: what they join needs no pairs.
    close = np.flatnonzero((node[1:] == node[:-1]) & (_distance(fingerprint[1:], fingerprint[:-1]) <= DISTANCE))
    label = merged(at, close, close + 1)
    joined = levels.joined(label)
    top = len(levels.pattern) - 1
    roots = np.arange(len(levels.pattern[top]))
    waiting = [(top, roots[i : i + STEP], roots[i : i + STEP]) for i in range(0, len(roots), STEP)]
    while waiting:
        level, a, b = waiting.pop()
        if level:
            for low in range(0, len(a), STEP // FAN**2):
                part = slice(low, low + STEP // FAN**2)
                left, right = levels.below(level, a[part], b[part])
                one, other = joined[level - 1][left], joined[level - 1][right]
                go = ((one != other) | (one < 0)) & levels.near(level - 1, left, right)
                if go.any():
                    waiting.append((level - 1, left[go], right[go]))
            continue
        a, b = a[a != b], b[a != b]
        known = label[a] != label[b]
        if known.any():
            label = merged(label, a[known], b[known])
            joined = levels.joined(label)
    return label


def near_links(classes: DataFrame, limit: int = NODE, shard: int = SHARD) -> DataFrame:
    """``classes`` (fingerprint: bigint, distinct) to links (a, b) that join every two fingerprints with at most ``DISTANCE``
    different bits, directly or over others."""
    signed = lambda mask: mask - (1 << 64) if mask >> 63 else mask
    full = (1 << 64) - 1
    masks = divided(full)
    depth = 1
    spread = F.explode(F.array(*[F.lit(signed(m)).cast("bigint") for m in masks]))
    entries = classes.select("fingerprint", spread.alias("mask"))
    shares = F.col("fingerprint").bitwiseAND(F.col("mask")).alias("shared")
    links = None
    while True:
        entries = written(entries.select("fingerprint", "mask", shares), "entries")
        large = written(entries.groupBy("mask", "shared").agg(F.count("*").alias("members")).where(F.col("members") > limit).select("mask", "shared"), "large")
        further = depth < DEPTH and not large.isEmpty()
        small = entries.join(large, ["mask", "shared"], "left_anti") if further else entries
        groups = max(1, -(-small.count() // shard))
        dealt = small.select("mask", "fingerprint", F.pmod(F.xxhash64("mask", "shared"), F.lit(groups)).alias("shard"))
        found = dealt.groupBy("shard").applyInArrow(node_links, "a bigint, b bigint")
        links = found if links is None else links.union(found)
        if not further:
            return links
        children = {m: [m | part for part in divided(full ^ m)] for m in masks}
        table = F.create_map(*[x for m, parts in children.items() for x in (F.lit(signed(m)).cast("bigint"), F.array(*[F.lit(signed(p)).cast("bigint") for p in parts]))])
        entries = entries.join(large, ["mask", "shared"]).select("fingerprint", F.explode(table[F.col("mask")]).alias("mask"))
        masks = sorted({p for parts in children.values() for p in parts})
        depth += 1


def similar_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 3, limit: int = NODE, shard: int = SHARD) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``fingerprint`` (bigint, the bits as they are) and ``component_id``, the smallest
    id that its links reach, its own included.

    A null or empty text and one without words have the fingerprint zero and link like any other. Rows with equal ids are
    rows of their own. A row with a null id links like others and has no id to give; where no id is reached,
    ``component_id`` is null. Ties are no matter: the smallest id is one number. Texts of any length are taken whole; an
    empty table gives an empty one, and other columns of ``docs`` are not looked at."""
    source = docs.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = written(source.mapInArrow(lambda batches: signatures(batches, size), "id bigint, fingerprint bigint"), "fingerprints")
    classes = written(rows.groupBy("fingerprint").agg(F.min("id").alias("least")), "classes")
    joined = components(near_links(classes, limit, shard)).withColumnRenamed("id", "fingerprint")
    grouped = written(classes.join(joined, "fingerprint", "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("component")), "grouped")
    smallest = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(grouped.join(smallest, "component").select("fingerprint", "component_id"), "fingerprint").select("id", "fingerprint", "component_id")


def hexadecimal(fingerprint) -> F.Column:
    """16 lowercase hex digits, the highest bit first."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
