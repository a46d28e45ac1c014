"""Near duplicates by MinHash bands, odd sketches and a check on the whole shingle sets.

1. A text becomes the set of its ``size``-word shingles. Texts with equal sets are one class, found by a 128-bit
   fingerprint; one of a class stands for it from here on.
2. MinHash samples of the set are cut into bands; sets that agree in a band may be similar. The samples are also folded
   into an odd sketch: each (sample, value) flips one bit. The bits in which two sketches differ estimate how many
   samples differ, and so the similarity, most precisely where it is high; pairs far below the limit go.
3. The rest are links if their whole sets say so. Links give connected components.

Each bucket of a band has a pivot, the member that shares most with others over all bands. First every member is held
against its pivots, which costs a pair a bucket at most and joins true copies. Only where members of one pivot are then
still in different components do they meet, in blocks of bounded size; those of the pivot's own component meet the others
and not each other. A block holds sketches and texts, checks what the sketches leave on whole sets, and gives back links
only. So a bucket of any size is worked through whole, no task takes it whole, and no pairs but links leave a task.

A pair at a similarity of 0.85 shares none of the 40 bands of 6 samples with a probability below 1e-8 (at 0.8: 6e-6), and
its sketches are taken for too far apart with one below 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thetaloom.llm.components import components
from thetaloom.llm.names import free_name
from thetaloom.llm.ragged import LOWER, U64, WHITE, flat, mixed, slices, span_hashes, spans, windows_of
from thetaloom.llm.scratch import written
from thetaloom.llm.workers import release

BANDS, ROWS = 40, 6
SKETCH_WORDS = 8
"""64-bit words of an odd sketch."""
BLOCK = 256
"""Members of a pivot in one block."""

_numbers = mixed(np.arange(1, 2 * BANDS * ROWS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
_FACTORS = (_numbers[: BANDS * ROWS] >> U64(32)).astype(np.uint32) | np.uint32(1)
_SHIFTS = (_numbers[BANDS * ROWS :] >> U64(32)).astype(np.uint32)

SIGNATURE = "id bigint, length int, code bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, sketch binary"


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: of ``size`` consecutive words with A-Z lower-cased, of the whole
    sequence where it is shorter; none without words."""
    data, offsets = flat(texts)
    for low, high in slices(offsets):
        part = LOWER[data[offsets[low] : offsets[high]]]
        starts, ends, firsts = spans(~WHITE[part], offsets[low : high + 1] - offsets[low])
        hashes = span_hashes(part, starts, ends)
        for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
            words = hashes[a:b]
            # A shorter sequence has a hash of its own length, so it can't equal a shingle.
            yield np.unique(windows_of(words, min(size, len(words)))) if len(words) else words


def sampled(sets: list[np.ndarray]) -> np.ndarray:
    """The MinHash samples of nonempty sets, a row for each."""
    sizes = np.array([len(x) for x in sets])
    values = (np.concatenate(sets) >> U64(32)).astype(np.uint32)
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), BANDS * ROWS), np.uint32)
    for at in range(BANDS * ROWS):
        out[:, at] = np.minimum.reduceat((values ^ _SHIFTS[at]) * _FACTORS[at], starts)
    return out


def sketched(samples: np.ndarray) -> np.ndarray:
    """Odd sketches: a bit is set if an odd number of (sample, value) fall on it."""
    bit = (mixed(samples.astype(U64) + (np.arange(samples.shape[1], dtype=U64) << U64(32))) % U64(64 * SKETCH_WORDS)).astype(np.int64)
    flips = np.zeros((len(samples), 64 * SKETCH_WORDS), np.uint8)
    rows = np.arange(len(samples))
    for at in range(samples.shape[1]):
        flips[rows, bit[:, at]] ^= 1
    return np.packbits(flips, axis=1)


def farthest(threshold: float) -> int:
    """Differing sketch bits beyond which a similarity of ``threshold`` is ruled out: six deviations above the mean."""
    samples, bits = BANDS * ROWS, 64 * SKETCH_WORDS
    differing = samples * (1 - threshold) + 6 * (samples * threshold * (1 - threshold)) ** 0.5
    flipped = bits * (1 - (1 - 2 / bits) ** (2 * differing)) / 2
    return int(flipped + 6 * (flipped * (1 - flipped / bits)) ** 0.5)


def signatures(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 3 + [pa.list_(pa.int64()), pa.binary()]
    for batch in batches:
        start, waiting, sets = 0, 0, []
        for at, one in enumerate(shingle_sets(batch.column("text"), size)):
            sets.append(one)
            waiting += len(one)
            if at + 1 < batch.num_rows and waiting < 300_000:
                continue
            where = np.flatnonzero([len(x) for x in sets])
            full = [sets[i] for i in where]
            both = np.zeros((2, len(sets)), U64)
            bands: list = [None] * len(sets)
            sketches: list = [None] * len(sets)
            if full:
                samples = sampled(full)
                odd = sketched(samples)
                code = np.tile(np.arange(BANDS, dtype=U64) << U64(32), (len(full), 1))
                for row in range(ROWS):
                    code = mixed(code + samples[:, row::ROWS])
                for i, row in enumerate(where):
                    both[0, row], both[1, row] = full[i].sum(), np.bitwise_xor.reduce(mixed(full[i] ^ U64(0xA5A5A5A5A5A5A5A5)))
                    bands[row], sketches[row] = code[i].view(np.int64), odd[i].tobytes()
            made = [np.array([len(x) for x in sets]), both[0].view(np.int64), both[1].view(np.int64), bands, sketches]
            carried = [batch.column(name).slice(start, len(sets)) for name in ("id", "length", "code")]
            yield pa.RecordBatch.from_arrays(
                [*carried, *(pa.array(x, t) for x, t in zip(made, kinds, strict=True))],
                names=["id", "length", "code", "n_shingles", "set_a", "set_b", "bands", "sketch"],
            )
            start, waiting, sets = at + 1, 0, []
    release()


def _bits(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), U64).reshape(len(column), SKETCH_WORDS)


def _similar(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(one, other, assume_unique=True))
    return shared > 0 and 100 * shared >= percent * (len(one) + len(other) - shared)


def block_links(size: int, percent: int):
    """Of an Arrow table of two blocks of one pivot's members, enough links between different components to join all that
    any links of the blocks join."""
    most = farthest(percent / 100)

    def links(table: pa.Table) -> pa.Table:
        side, ids, part, count = (table.column(x).to_numpy() for x in ("side", "id", "part", "n_shingles"))
        sketch = _bits(table.column("sketch"))
        sets = list(shingle_sets(table.column("text"), size))
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        own = side[0] == 2  # one block with itself
        left = np.flatnonzero(side != 1)
        right = left if own else np.flatnonzero(side == 1)
        out: list[tuple[int, int]] = []
        for i in left.tolist():
            other = right[ids[right] > ids[i]] if own else right
            other = other[(part[other] != part[i]) & (100 * np.minimum(count[other], count[i]) >= percent * np.maximum(count[other], count[i]))]
            apart = np.bitwise_count(sketch[other] ^ sketch[i]).sum(axis=1)
            other, apart = other[apart <= most], apart[apart <= most]
            for j in other[np.argsort(apart, kind="stable")].tolist():
                a, b = top(int(part[i])), top(int(part[j]))
                if a != b and _similar(sets[i], sets[j], percent):
                    root[max(a, b)] = min(a, b)
                    out.append((int(ids[i]), int(ids[j])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return links


def linked(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets have 100 * intersection >= percent * union; ``texts``: (id, text)."""

    @F.arrow_udf("boolean")
    def similar(first: pa.Array, second: pa.Array) -> pa.Array:
        both = zip(shingle_sets(first, size), shingle_sets(second, size), strict=True)
        return pa.array([_similar(one, other, percent) for one, other in both], pa.bool_())

    sides = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return sides.where(similar("text_a", "text_b")).select("a", "b")


def similar_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """Each row's id with ``n_shingles``, ``component_id`` (the smallest id it is linked to over any number of links, itself
    included) and ``kept`` (it is that id).

    Texts that are null, empty or without words have an empty set, link with nothing and are kept. Rows of one id count as
    one document with the longest of their texts. Rows with a null id are left out."""
    content = F.col(f"`{text}`").cast("string")
    # Of rows with one id, the same row must stand for it in every step: the one with the greatest (length, code).
    source = docs.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.coalesce(F.octet_length(content), F.lit(0)).alias("length"), F.xxhash64(content).alias("code"), content.alias("text")).where("id is not null")
    signed = written(source.mapInArrow(lambda batches: signatures(batches, size), SIGNATURE), "signatures")
    whole = signed.groupBy("id").agg(F.max_by(F.struct("n_shingles", "set_a", "set_b", "bands", "sketch"), F.struct("length", "code")).alias("s"))
    whole = whole.select("id", "s.*")
    classes = whole.where("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(F.min("id").alias("class"), F.min_by(F.struct("bands", "sketch"), "id").alias("s"))
    classes = written(classes.select("set_a", "set_b", "n_shingles", "class", "s.bands", "s.sketch"), "classes")
    most = farthest(percent / 100)
    fits = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)  # noqa: E731  sizes too far apart can't link

    sketches = classes.select(F.col("class").alias("id"), "n_shingles", "sketch")
    entries = classes.select(F.col("class").alias("id"), F.explode("bands").alias("band"))
    buckets = entries.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    shared = written(entries.join(buckets, "band"), "buckets")
    reach = shared.groupBy("id").agg(F.sum(F.col("members") - 1).alias("reach"))
    pivots = shared.join(reach, "id").groupBy("band").agg(F.max_by("id", F.struct("reach", -F.col("id"))).alias("pivot"))
    star = written(shared.join(pivots, "band").select("pivot", "id").distinct(), "star")
    pairs = star.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    pairs = pairs.join(sketches.select(F.col("id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("s_a")), "a")
    pairs = pairs.join(sketches.select(F.col("id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("s_b")), "b")

    @F.arrow_udf("int")
    def distance(one: pa.Array, other: pa.Array) -> pa.Array:
        return pa.array(np.bitwise_count(_bits(one) ^ _bits(other)).sum(axis=1), pa.int32())

    near = pairs.where(fits(F.col("n_a"), F.col("n_b"))).where(distance("s_a", "s_b") <= most).select("a", "b")
    # Only texts of members of some bucket are read again.
    # At scale their ids are too many to broadcast, so they are shuffled at every size; hashing them spares sorting texts.
    members = star.select("id").distinct().hint("shuffle_hash")
    texts = written(source.join(members, "id").groupBy("id").agg(F.max_by("text", F.struct("length", "code")).alias("text")), "members")
    known = written(components(linked(near, texts, size, percent)), "components")

    # What is still apart under a pivot meets in blocks. Members of the pivot's component are a side of their own, so that
    # one large group of copies costs its size times the few that are apart.
    placed = star.join(known, "id", "left").select("id", "pivot", F.coalesce("component", "id").alias("part"))
    leading = F.max(F.when(F.col("id") == F.col("pivot"), F.col("part"))).alias("lead")
    sizes = placed.groupBy("pivot", "part").agg(F.count("*").alias("members"), leading)
    sizes = sizes.groupBy("pivot").agg(F.count("*").alias("parts"), F.max("lead").alias("lead"), F.sum("members").alias("all"), F.sum(F.when(F.col("lead").isNotNull(), F.col("members"))).alias("with_pivot"))
    blocks = lambda n: F.ceil(n / block).cast("int")
    # A single other member met the pivot already, which is all there is of its component.
    apart = sizes.where("parts > 1 and all > 2").select("pivot", "lead", blocks(F.col("with_pivot")).alias("leads"), blocks(F.col("all") - F.col("with_pivot")).alias("others"))
    rest = placed.join(apart, "pivot").withColumn("leads_it", F.col("part") == F.col("lead"))
    code = F.xxhash64("id", "pivot")
    rest = rest.withColumn("own", F.when(F.col("leads_it"), F.col("others") + F.pmod(code, F.col("leads"))).otherwise(F.pmod(code, F.col("others"))).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("leads_it"), F.col("others")).otherwise(F.col("others") + F.col("leads")) - 1)))
    meeting = rest.select("pivot", "id", "part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"))
    meeting = meeting.join(sketches, "id").join(texts, "id")
    more = meeting.groupBy("pivot", "i", "j").applyInArrow(block_links(size, percent), "a bigint, b bigint")

    final = components(known.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))
    whole = whole.join(classes.select("set_a", "set_b", "n_shingles", "class"), ["set_a", "set_b", "n_shingles"], "left")
    found = whole.join(final.withColumnRenamed("id", "class"), "class", "left")
    group = F.coalesce("component", "class", "id")
    return found.select("id", "n_shingles", group.alias("component_id"), (F.col("id") == group).alias("kept"))


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows whose document another one stands for. Rows with a null id stay."""
    key = free_name(docs, "near_id")
    gone = similar_documents(docs, id, text, size, percent).where("not kept").select(F.col("id").alias(key))
    return docs.join(gone, F.col(f"`{id}`").cast("bigint") == F.col(key), "left_anti")
