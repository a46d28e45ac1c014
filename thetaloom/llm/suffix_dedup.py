"""Removal of repeated passages: every byte inside a string of ``LENGTH`` bytes that also starts in an earlier document.

A suffix array over one shard finds repeats within the shard, so strings that are equal must meet in one shard. Each
window of ``LENGTH`` bytes goes where its minimizer, the ``SEED``-byte string in it of least hash, sends it: equal windows
have equal minimizers. Neighbouring windows mostly share one and travel together as one short context.

1. ``_seeds``: per batch of documents the minimizers' codes, each once, go to the shard of the code, which tells blocks of
   documents the codes that more than one document has. A code of several documents of one batch needs no answer.
2. ``_contexts``: per block, the contexts of such minimizers, equal ones once, go to the shard with the least and the
   greatest document that has them.
3. ``_repeats``: per shard, induced sorting gives the suffix array of its contexts and permuted common prefixes split it
   into classes of equal windows; the least document of a class is told to the blocks whose documents are greater.
4. ``_removed``: per block, the windows of each document that an earlier document has become removed spans.

Blocks are documents by hash of their id, shards are codes by value; both hold about ``PART`` bytes of text on average,
so tasks stay as they are while the corpus and their number grow. A passage that very many documents share is one entry
a batch and a block, never one a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thetaloom.llm.ragged import U64, flat, gathered, joined_runs, mixed, slices, span_hashes
from thetaloom.llm.suffix_array import common_prefixes, suffix_array

LENGTH, SEED = 50, 24
PART = 8_000_000
_LAST = np.iinfo(np.int64).max
"""Stands for a null id: such a row comes after all others."""


def packed(values: np.ndarray) -> bytes:
    """An array as compressed planes of bytes: sorted or small values leave little."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(values).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpacked(content: bytes, kind) -> np.ndarray:
    kind, count = np.dtype(kind), int.from_bytes(content[:8], "little")
    if not count:
        return np.zeros(0, kind)
    raw = pa.decompress(content[8:], decompressed_size=count * kind.itemsize, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(kind.itemsize, count).T.copy().view(kind).ravel()


def windows(data: np.ndarray, offsets: np.ndarray):
    """Groups of neighbouring windows with one minimizer: first window, number of windows, row, hash of the minimizer."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, np.zeros(0, U64)
    words = np.ndarray((len(data) - 7,), "<u8", buffer=np.ascontiguousarray(data), strides=(1,))
    seeds = len(data) - SEED + 1
    hashes = np.zeros(seeds, U64)
    for at in range(0, SEED, 8):
        hashes = mixed(hashes * U64(3) + words[at : at + seeds])
    # The least hash, leftmost among equals, over all seeds of a window: minima over doubled widths.
    least = (hashes >> U64(32) << U64(32)) | np.arange(seeds, dtype=U64)
    width, wanted = 1, LENGTH - SEED + 1
    while 2 * width <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < wanted:
        least = np.minimum(least[: len(least) - (wanted - width)], least[wanted - width :])
    # Only windows inside a row count.
    counts = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    starts = gathered(offsets[:-1], counts)
    if not len(starts):
        return none, none, none, np.zeros(0, U64)
    place = (least[starts] & U64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return starts[first], np.diff(np.r_[first, len(place)]), np.repeat(np.arange(len(counts)), counts)[first], hashes[place[first]]


def coded(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard and, in it, a 40-bit code. Two minimizers of one code only make more candidates."""
    return (hashes % U64(shards)).astype(np.int64), hashes >> U64(24)


def _ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.fill_null(_LAST).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.fill_null(_LAST).to_numpy()


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination begins, of keys sorted together."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _by(target: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The slices of equal values of a sorted array."""
    edges = [*_groups(target).tolist(), len(target)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(target[a]), slice(a, b)


def _seeds(shards: int):
    """Batches of (block, text) to rows of (target, codes, blocks): to a shard below ``shards``, to block b at shards + b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column("block").to_numpy()
            data, offsets = flat(batch.column("text"))
            parts = []
            for low, high in slices(offsets):
                _, _, row, found = windows(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                parts.append((row + low, found))
            row = np.concatenate([x for x, _ in parts]) if parts else np.zeros(0, np.int64)
            shard, code = coded(np.concatenate([x for _, x in parts]) if parts else np.zeros(0, U64), shards)
            order = np.lexsort((row, code, shard))
            row, shard, code = row[order], shard[order], code[order]
            if not len(row):
                continue
            edges = _groups(shard, code)
            sizes = np.diff(np.r_[edges, len(row)])
            several = row[edges] != row[edges + sizes - 1]
            rows: tuple[list, list, list] = [], [], []

            def put(target, codes, blocks, rows=rows):
                for column, value in zip(rows, (target, packed(codes), packed(blocks)), strict=True):
                    column.append(value)

            # To the shard each code once, with the block of its document, or 0 where several have it.
            asked = np.where(several, 0, block[row[edges]] + 1).astype(np.uint32)
            for target, part in _by(shard[edges]):
                put(target, code[edges][part], asked[part])
            # To the blocks what several documents of this batch have.
            known = np.repeat(several, sizes)
            target, key = block[row[known]], code[known] << U64(24) | shard[known].astype(U64)
            order = np.lexsort((key, target))
            target, key = target[order], key[order]
            edges = _groups(target, key)
            for own, part in _by(target[edges]):
                put(shards + own, key[edges][part], np.zeros(0, np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())], names=["target", "codes", "blocks"])

    return run


def _answers(shards: int):
    """Of one target's rows: the codes of several documents, to each block that has them."""

    def run(table: pa.Table) -> pa.Table:
        target = table.column("target")[0].as_py()
        codes = np.concatenate([unpacked(x.as_py(), U64) for x in table.column("codes")])
        if target >= shards:
            out = [(target - shards, packed(np.unique(codes)))]
        else:
            blocks = np.concatenate([unpacked(x.as_py(), np.uint32) for x in table.column("blocks")]).astype(np.int64)
            order = np.argsort(codes, kind="stable")
            codes, blocks = codes[order], blocks[order]
            edges = _groups(codes)
            sizes = np.diff(np.r_[edges, len(codes)])
            shared = np.repeat((sizes > 1) | (np.minimum.reduceat(blocks, edges) == 0), sizes) & (blocks > 0)
            key, block = codes[shared] << U64(24) | U64(target), blocks[shared] - 1
            order = np.argsort(block, kind="stable")
            out = [(own, packed(key[order][part])) for own, part in _by(block[order])]
        return pa.table({"block": pa.array([x for x, _ in out], pa.int64()), "keys": pa.array([x for _, x in out], pa.binary())})

    return run


def _contexts(shards: int):
    """A block's documents and shared codes to rows of (shard, block, texts, sizes, names, low, high) for its contexts."""
    names = ["shard", "block", "texts", "sizes", "names", "low", "high"]

    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in names]
        if docs.num_rows and shared.num_rows:
            keys = np.unique(np.concatenate([unpacked(x.as_py(), U64) for x in shared.column("keys")]))
            ids, own = _ids(docs.column("id")), docs.column("block")[0].as_py()
            data, offsets = flat(docs.column("text"))
            found: list[list] = [[] for _ in range(5)]
            for low, high in slices(offsets):
                base = offsets[low]
                part = data[base : offsets[high]]
                start, count, row, hashes = windows(part, offsets[low : high + 1] - base)
                shard, code = coded(hashes, shards)
                key = code << U64(24) | shard.astype(U64)
                kept = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key)
                size = count[kept] + LENGTH - 1
                for column, value in zip(found, (start[kept] + base, size, ids[row[kept] + low], shard[kept], span_hashes(part, start[kept], start[kept] + size)), strict=True):
                    column.append(value)
            start, size, id, shard, name = map(np.concatenate, found)
            order = np.lexsort((id, name, shard))
            start, size, id, shard, name = start[order], size[order], id[order], shard[order], name[order]
            if len(order):
                edges = _groups(shard, name)
                last = np.r_[edges[1:], len(order)] - 1
                for target, part in _by(shard[edges]):
                    at = edges[part]
                    values = (target, own, pa.compress(data[gathered(start[at], size[at])].tobytes(), codec="zstd", asbytes=True), packed(size[at].astype(np.uint16)), packed(name[at]), packed(id[at]), packed(id[last[part]]))
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
        return pa.table([pa.array(x, t) for x, t in zip(out, [pa.int64()] * 2 + [pa.binary()] * 5, strict=True)], names=names)

    return run


def repeated_windows(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts that follow one another: the starts of their windows, and for each the number of its class. Windows
    have one number if and only if their bytes are equal."""
    # A separator below all bytes ends each context, so no common prefix of two windows reaches over one.
    ends = np.cumsum(sizes + 1) - 1
    text = np.zeros(int(ends[-1]) + 1, np.uint16)
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = data.astype(np.uint16) + 1
    order = suffix_array(text, 257)
    starts = gathered(ends - sizes, sizes - LENGTH + 1)
    window = np.zeros(len(text), bool)
    window[starts] = True
    plain = np.zeros(len(text), np.uint8)
    plain[inside] = data
    common = common_prefixes(plain, order, LENGTH, window)
    # In suffix order equal windows are neighbours; the one before a window is one too where so much agrees.
    order = order[window[order]]
    number = np.empty(len(text), np.int64)
    number[order] = np.cumsum(common[order] < LENGTH)
    return starts, number[starts]


def _repeats(table: pa.Table) -> pa.Table:
    """A shard's contexts to rows of (block, names, at, count, low): runs of windows in a context whose least document
    is before the greatest one that has the context in the block."""
    sizes = [unpacked(x.as_py(), np.uint16).astype(np.int64) for x in table.column("sizes")]
    texts = [np.frombuffer(pa.decompress(x.as_py(), decompressed_size=int(s.sum()), codec="zstd"), np.uint8) for x, s in zip(table.column("texts"), sizes, strict=True)]
    block = np.repeat(table.column("block").to_numpy(), [len(x) for x in sizes])
    name, low, high = (np.concatenate([unpacked(x.as_py(), kind) for x in table.column(column)]) for column, kind in (("names", U64), ("low", np.int64), ("high", np.int64)))
    size = np.concatenate(sizes)
    start = np.cumsum(size) - size
    distinct, example, which = np.unique(name, return_index=True, return_inverse=True)
    least = np.full(len(distinct), _LAST)
    np.minimum.at(least, which, low)
    length = size[example]
    begins, number = repeated_windows(np.concatenate(texts)[gathered(start[example], length)], length)
    counts = length - LENGTH + 1
    context = np.repeat(np.arange(len(distinct)), counts)
    first = np.full(int(number.max()) + 1, _LAST)
    np.minimum.at(first, number, least[context])
    first = first[number]
    # Runs of windows of one context with one least document.
    edges = _groups(context, first)
    count = np.diff(np.r_[edges, len(first)])
    offset = edges - (np.cumsum(counts) - counts)[context[edges]]
    runs = np.bincount(context[edges], minlength=len(distinct))
    at = gathered((np.cumsum(runs) - runs)[which], runs[which])
    record = np.repeat(np.arange(len(which)), runs[which])
    told = first[edges[at]] < high[record]
    at, record = at[told], record[told]
    order = np.argsort(block[record], kind="stable")
    at, record = at[order], record[order]
    out = [(own, packed(name[record[part]]), packed(offset[at[part]].astype(np.uint16)), packed(count[at[part]].astype(np.uint16)), packed(first[edges[at[part]]])) for own, part in _by(block[record])]
    return pa.table([pa.array(x, t) for x, t in zip([list(x) for x in zip(*out, strict=True)] or [[]] * 5, [pa.int64()] + [pa.binary()] * 4, strict=True)], names=["block", "names", "at", "count", "low"])


REMOVED = "id bigint, n_bytes bigint, removed_from array<bigint>, removed_to array<bigint>, kept binary"


def _removed(docs: pa.Table, told: pa.Table) -> pa.Table:
    """A block's documents with their removed spans and the bytes that are left."""
    known = told.num_rows > 0
    if known:
        name, at, count, low = (np.concatenate([unpacked(x.as_py(), kind) for x in told.column(column)]) for column, kind in (("names", U64), ("at", np.uint16), ("count", np.uint16), ("low", np.int64)))
        order = np.argsort(name, kind="stable")
        name, at, count, low = name[order], at[order].astype(np.int64), count[order].astype(np.int64), low[order]
    ids = _ids(docs.column("id"))
    data, offsets = flat(docs.column("text"))
    begins: list[np.ndarray] = [np.zeros(0, np.int64)]
    ends: list[np.ndarray] = [np.zeros(0, np.int64)]
    for a, b in slices(offsets) if known else ():
        base = offsets[a]
        part = data[base : offsets[b]]
        start, windows_, row, _ = windows(part, offsets[a : b + 1] - base)
        names = span_hashes(part, start, start + windows_ + LENGTH - 1)
        left = np.searchsorted(name, names, "left")
        hits = np.searchsorted(name, names, "right") - left
        run, own = gathered(left, hits), np.repeat(np.arange(len(names)), hits)
        earlier = low[run] < ids[row[own] + a]
        run, own = run[earlier], own[earlier]
        begin = start[own] + at[run] + base
        begins.append(begin)
        ends.append(begin + count[run] - 1 + LENGTH)
    begin, end = np.concatenate(begins), np.concatenate(ends)
    order = np.argsort(begin, kind="stable")
    # Touching spans are one run, unless a document ends between them.
    bounds = np.searchsorted(begin[order], offsets)
    out: list[list] = [[], [], [], []]
    for row in range(len(ids)):
        mine = order[bounds[row] : bounds[row + 1]]
        x, y = joined_runs(begin[mine], end[mine])
        text = data[offsets[row] : offsets[row + 1]]
        x, y = x - offsets[row], y - offsets[row]
        kept = text.tobytes() if not len(x) else b"".join(text[p:q].tobytes() for p, q in zip(np.r_[0, y], np.r_[x, len(text)], strict=True))
        for column, value in zip(out, (len(text), x, y, kept), strict=True):
            column.append(value)
    ranges = pa.list_(pa.int64())
    return pa.table([docs.column("id"), *(pa.array(x, t) for x, t in zip(out, [pa.int64(), ranges, ranges, pa.binary()], strict=True))], names=["id", "n_bytes", "removed_from", "removed_to", "kept"])


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", part: int = PART) -> DataFrame:
    """Each row's ``id``, ``n_bytes``, the removed spans in bytes and ``kept``, the bytes that are left (cuts need not be at
    characters, so it is binary).

    A null or empty text has no bytes. Rows with one id are not earlier than one another. Rows with a null id come after
    all others and are not earlier than one another. Texts shorter than a window keep all."""
    source = docs.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(-(-size // part)) or 1
    blocked = source.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(parts)))
    seeds = blocked.select("block", "text").mapInArrow(_seeds(parts), "target bigint, codes binary, blocks binary")
    shared = seeds.groupBy("target").applyInArrow(_answers(parts), "block bigint, keys binary")
    contexts = blocked.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_contexts(parts), "shard bigint, block bigint, texts binary, sizes binary, names binary, low binary, high binary")
    told = contexts.groupBy("shard").applyInArrow(_repeats, "block bigint, names binary, at binary, count binary, low binary")
    return blocked.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_removed, REMOVED)
