"""The source audit against sums over all terms, and joint tables against counting."""

import collections
import re

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from thetaloom.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plainly(rows, least=3, top=200):
    counts, having = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, source, text in rows:
        terms = TERM.findall((text or "").translate(cases.ASCII_LOWER))
        counts[lang or "", source or ""].update(terms)
        having[lang or ""].update(set(terms))
    out = []
    for lang in having:
        kept = [t for t, n in having[lang].items() if n >= least]
        groups = {s: counts[g, s] for g, s in counts if g == lang}
        whole = collections.Counter()
        for count in groups.values():
            whole.update(count)
        rate = lambda count: {t: 1 + 10**9 * (count[t] + 1) // (sum(count[x] for x in kept) + len(kept)) for t in kept}  # noqa: B023,E731
        p, q = {s: rate(count) for s, count in groups.items()}, rate(whole)
        for s in groups:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in groups if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if groups[s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


def test_against_all_terms(spark):
    rows = cases.documents(spark).withColumn("rank", F.lit("kept")).withColumn("TERM", F.lit(1))
    rows = rows.union(spark.createDataFrame([(1, f"same words twice twice z{i}" * (i % 3), None, None, 1, "", 1) for i in range(9)], rows.schema))
    found = divergence.audited(rows, top=20)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == plainly([(r.lang, r.source, r.text) for r in rows.collect()], top=20)


def test_language_without_terms_and_empty_table(spark):
    schema = "lang string, source string, text string"
    rows = [("en", "a", "one two"), ("en", "b", None), ("en", None, ""), (None, None, None), ("xx", "only", "word word word")]
    found = sorted(map(tuple, divergence.audited(spark.createDataFrame(rows, schema)).collect()))
    assert found == plainly(rows) and {row[4] for row in found} == {0} and len(found) == 6
    assert divergence.audited(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("columns, rows", [(4, 7), (256, 2048), (1, 1)])
def test_block_sums_follow_the_joint_tables(monkeypatch, columns, rows):
    monkeypatch.setattr(divergence, "COLUMNS", columns)
    monkeypatch.setattr(divergence, "ROWS", rows)
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 4, (40, 5)) * rng.integers(0, 2, (40, 5))
    counts[:, 0] += 1
    p, p0 = np.array([3, 10**9 // 7, 10**9, 17, 90])[counts % 5] + np.arange(5), np.arange(5) + 1
    row, group = np.nonzero(counts)
    price = lambda a, b: (int(a) - int(b)) ** 2 // int(b)
    expected = collections.Counter()
    for t in range(40):
        for g in np.flatnonzero(counts[t]):
            for h in np.flatnonzero(counts[t]):
                expected[int(g), int(h)] += price(p[t, g], p[t, h]) - price(p[t, g], p0[h]) - price(p0[g], p[t, h]) + price(p0[g], p0[h])
    found = collections.Counter()
    for one, other, upper, lower in divergence.block_sums(group, p[row, group], p0[group], row):
        for key, value in zip(zip(one.tolist(), other.tolist(), strict=True), zip(upper.tolist(), lower.tolist(), strict=True), strict=True):
            found[key] += (value[0] << divergence.HALF) + value[1]
    assert dict(found) == dict(expected)


def test_sums_beyond_64_bits(spark):
    """Prices near the square of the unit over many terms."""
    rows = [("en", "a", "x " * 50), ("en", "b", " ".join(["y"] * 40)), ("en", "a", "x y"), ("en", "b", "x y"), ("en", "c", "x y")]
    frame = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(map(tuple, divergence.audited(frame).collect())) == plainly(rows)


def test_a_task_hands_on_its_counts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "KEPT", 5)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 4, "source": ["a", "a", "b", "a"], "text": ["A b c d e", "f g a", "a a", ""]})
    total = collections.Counter()
    for part in divergence.counted(iter([batch])):
        for row in part.to_pylist():
            total[row["source"], row["term"]] += row["n"]
    assert total["a", "a"] == 2 and total["b", "a"] == 2 and total["a", "f"] == 1 and ("a", None) in total
