"""SimHash fingerprints, and links in Gray order against all pairs."""

import cases
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from thetaloom.llm import simhash


def fingerprint(text, size=3):
    words = cases.words(text)
    runs = [" ".join(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(run.encode(), seed=42) for run in runs]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def all_pairs(codes):
    """The smallest place that each code reaches over links of all pairs."""
    label = list(range(len(codes)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    codes = np.array(codes, np.uint64)
    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[:i] ^ codes[i]) <= 3).tolist():
            a, b = top(i), top(j)
            label[max(a, b)] = min(a, b)
    return [top(x) for x in range(len(codes))]


def crowd(rng, size, centers, flips):
    codes = rng.integers(0, 2**63, centers, dtype=np.uint64)[rng.integers(0, centers, size)]
    for _ in range(flips):
        codes = codes ^ np.where(rng.random(size) < 0.6, np.uint64(1) << rng.integers(0, 64, size).astype(np.uint64), np.uint64(0))
    return np.unique(codes)


@pytest.mark.parametrize("size, centers, flips", [(1, 1, 0), (3, 1, 2), (700, 6, 5), (900, 900, 0), (1200, 1, 7)])
def test_one_node_against_all_pairs(size, centers, flips):
    codes = crowd(np.random.default_rng(size), size, centers, flips)
    found = simhash.node_links(pa.table({"mask": np.zeros(len(codes), np.int64), "fingerprint": codes.view(np.int64)}))
    place = {code: i for i, code in enumerate(codes.view(np.int64).tolist())}
    a, b = (np.array([place[x] for x in found[side].to_pylist()], int) for side in ("a", "b"))
    assert simhash.merged(np.arange(len(codes)), a, b).tolist() == all_pairs(codes)
    assert found.num_rows < max(len(codes), 1)


def test_nodes_do_not_mix():
    codes = np.array([0b0001, 0b0011, 0b1000, 0b1001], np.uint64).view(np.int64)
    found = simhash.node_links(pa.table({"mask": np.full(4, 0b1000), "fingerprint": codes}))
    assert {frozenset(pair) for pair in zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True)} == {frozenset((1, 3)), frozenset((8, 9))}


def test_gray_rank_and_parts():
    order = np.argsort(simhash.gray_rank(np.arange(64, dtype=np.uint64)))
    assert (np.bitwise_count(order[1:] ^ order[:-1]) == 1).all()
    for free in ((1 << 64) - 1, 0xF0F0F0F0F0F00001, 0b101):
        parts = simhash.divided(free)
        assert sum(parts) == free and sum(map(int.bit_count, parts)) == free.bit_count() and len(parts) == 4


@pytest.mark.parametrize("limit, shard", [(60, 50), (150, 10_000), (5000, 1000)])
def test_divided_nodes_lose_no_link(spark, limit, shard):
    codes = crowd(np.random.default_rng(3), 600, 4, 6)
    classes = spark.createDataFrame([(int(x),) for x in codes.view(np.int64)], "fingerprint bigint")
    found = simhash.near_links(classes, limit, shard).collect()
    place = {code: i for i, code in enumerate(codes.view(np.int64).tolist())}
    a, b = (np.array([place[row[side]] for row in found], int) for side in (0, 1))
    assert simhash.merged(np.arange(len(codes)), a, b).tolist() == all_pairs(codes)


def test_documents_against_all_pairs(spark):
    rows = cases.documents(spark)
    base = [f"w{i}" for i in range(200)]
    edits = [(800000 + i, " ".join(base[:i] + [f"x{i}"] * (i % 5) + base[i + 1 :]), "en", "src1", 1) for i in range(40)]
    rows = rows.union(spark.createDataFrame(edits, rows.schema))
    texts = cases.texts_of(rows)
    codes = [fingerprint(text) for _, text in texts]
    group = all_pairs(codes)
    least = {}
    for at, (id, _) in zip(group, texts, strict=True):
        least[at] = min((x for x in (id, least.get(at)) if x is not None), default=None)
    expected = sorted(((id, f"{code:016x}", least[at]) for (id, _), code, at in zip(texts, codes, group, strict=True)), key=str)
    found = simhash.similar_documents(rows.withColumn("fingerprint", F.lit("kept")).withColumn("id", F.lit(0)), limit=100)
    assert sorted(map(tuple, found.select("id", simhash.hexadecimal("fingerprint"), "component_id").collect()), key=str) == expected


def test_odd_tables(spark):
    schema = "doc_id bigint, text string"
    assert simhash.similar_documents(spark.createDataFrame([], schema)).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, "a b c")], schema)
    assert sorted(map(tuple, simhash.similar_documents(nulls).collect()), key=str) == sorted([(None, 0, None), (None, np.array([fingerprint("a b c")], np.uint64).view(np.int64).tolist()[0], None)], key=str)
    long = "some words of a very long text " * 100_000
    found = simhash.similar_documents(spark.createDataFrame([(2, long), (1, long), (3, None)], schema))
    code = int(simhash.majorities([simhash.shingle_hashes(long, 3)]).view(np.int64)[0])
    assert sorted(map(tuple, found.collect())) == [(1, code, 1), (2, code, 1), (3, 0, 3)]
