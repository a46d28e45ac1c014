"""Suffix arrays and the removal of repeated passages."""

import random

import numpy as np
import pytest
import cases

from thetaloom.llm import suffix_array, suffix_dedup

LENGTH = suffix_dedup.LENGTH


@pytest.mark.parametrize("few", [0, 48, 10**9])
def test_suffix_array_is_the_order_of_suffixes(monkeypatch, few):
    monkeypatch.setattr(suffix_array, "FEW", few)
    rng = np.random.default_rng(few % 91)
    for _ in range(300):
        sigma = int(rng.integers(1, 5))
        text = rng.integers(0, sigma, int(rng.integers(0, 50)))
        whole = text.tolist()
        assert suffix_array.suffix_array(text, sigma).tolist() == sorted(range(len(whole)), key=lambda i: whole[i:])


def test_common_prefixes():
    data = np.frombuffer(b"abracadabra abracadabra abra", np.uint8)
    order = suffix_array.suffix_array(data.astype(np.int64), 256)
    got = suffix_array.common_prefixes(data, order, 12, np.ones(len(data), bool))
    for before, at in zip(order[:-1], order[1:], strict=True):
        a, b = bytes(data[before:]), bytes(data[at:])
        expected = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        # Beyond the shorter suffix zeros are compared, which these texts don't hold.
        assert got[at] == min(expected, 12)


def brute(rows):
    """Per row: bytes, removed spans, what is left."""
    first: dict[bytes, float] = {}
    key = lambda id: float("inf") if id is None else id
    content = [(key(id), (text or "").encode()) for id, text in rows]
    for id, raw in content:
        for at in range(len(raw) - LENGTH + 1):
            window = raw[at : at + LENGTH]
            first[window] = min(first.get(window, float("inf")), id)
    out = []
    for id, raw in content:
        covered = bytearray(len(raw))
        for at in range(len(raw) - LENGTH + 1):
            if first[raw[at : at + LENGTH]] < id:
                covered[at : at + LENGTH] = b"\x01" * LENGTH
        spans = sum(1 for i, x in enumerate(covered) if x and (i == 0 or not covered[i - 1]))
        out.append((id, len(raw), sum(covered), spans, bytes(x for x, gone in zip(raw, covered, strict=True) if not gone)))
    return sorted(out)


def got(frame):
    key = lambda id: float("inf") if id is None else id
    return sorted((key(r.id), r.n_bytes, sum(b - a for a, b in zip(r.removed_from, r.removed_to, strict=True)), len(r.removed_from), bytes(r.kept)) for r in frame.collect())


def test_repeats_against_brute_force(spark):
    rows = cases.documents(spark)
    assert got(suffix_dedup.without_repeats(rows)) == brute(cases.texts_of(rows))


def test_repeats_in_many_small_parts(spark):
    rng = random.Random(4)
    piece = lambda n: "".join(rng.choice("ab\0é") for _ in range(n))
    stock = [piece(80) for _ in range(6)]
    rows = [(i, piece(rng.randrange(40)) + "".join(rng.choice(stock)[: rng.randrange(30, 80)] + piece(rng.randrange(9)) for _ in range(rng.randrange(5)))) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(suffix_dedup.without_repeats(frame, part=500)) == brute(rows)


def test_no_documents(spark):
    assert suffix_dedup.without_repeats(cases.documents(spark).limit(0)).count() == 0
