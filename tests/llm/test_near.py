"""Near duplicates and connected components."""

import collections

import numpy as np
import pyarrow as pa
import cases

from thetaloom.llm import near_dedup
from thetaloom.llm.components import components


def test_components(spark):
    links = [(1, 2), (3, 2), (10, 11), (12, 11), (12, 13), (13, 14), (14, 15), (20, 20), (5, 4), (4, 5), (100, 1)]
    links += [(i, i + 1) for i in range(200, 240)]
    found = dict(map(tuple, components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    expected = {x: 1 for x in (1, 2, 3, 100)} | {x: 10 for x in range(10, 16)} | {4: 4, 5: 4} | {x: 200 for x in range(200, 241)}
    assert found == expected
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute(rows, size, percent):
    sets, root = {}, {}
    for id, text in rows:
        if id is None:
            continue
        w = cases.words(text)
        mine = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
        if len((text or "").encode()) >= sets.get(id, (-1,))[0]:
            sets[id] = (len((text or "").encode()), mine)
        root[id] = id

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    owners = collections.defaultdict(set)
    for id, (_, mine) in sets.items():
        for shingle in mine:
            owners[shingle].add(id)
    shared = collections.Counter((a, b) for ids in owners.values() for a in ids for b in ids if a < b)
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a][1]) + len(sets[b][1]) - n):
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return sorted((id, len(mine), top(id), top(id) == id) for id, (_, mine) in sets.items())


def test_against_brute_force(spark):
    rows = cases.documents(spark)
    # A base text and edits of it, of which some are too far from the base and near to one another.
    base = [f"w{i}" for i in range(120)]
    for i in range(24):
        edit = list(base)
        for at in range(i % 7):
            edit[(i * 11 + at * 17) % 120] = f"x{i}"
        if i % 4 == 0:
            edit[:18] = [f"y{k}" for k in range(18)]
        rows = rows.union(spark.createDataFrame([(800000 + i, " ".join(edit), "en", "src1", 1)], rows.schema))
    found = near_dedup.similar_documents(rows, size=3, percent=85, block=4)
    assert sorted(map(tuple, found.select("id", "n_shingles", "component_id", "kept").collect())) == brute(cases.texts_of(rows), 3, 85)


def test_block_links_join_what_any_link_joins():
    texts = ["a b c d e f g h i j", "a b c d e f g h i k", "z y x w v u t s r q", "z y x w v u t s r p", "lone words that nothing else has at all here"]
    sets = list(near_dedup.shingle_sets(pa.array(texts), 1))
    sketches = [x.tobytes() for x in near_dedup.sketched(near_dedup.sampled(sets))]
    table = pa.table({"side": [2] * 5, "id": [5, 4, 3, 2, 1], "part": [5, 4, 3, 2, 1], "n_shingles": [len(x) for x in sets], "sketch": sketches, "text": texts})
    found = near_dedup.block_links(1, 80)(table).to_pylist()
    assert sorted((min(x["a"], x["b"]), max(x["a"], x["b"])) for x in found) == [(2, 3), (4, 5)]


def test_sketch_distance_follows_similarity():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 1000).astype(np.uint64)
    most = near_dedup.farthest(0.85)
    for share, near in ((1.0, True), (0.92, True), (0.3, False)):
        other = np.unique(np.r_[base[: int(1000 * share)], rng.integers(0, 2**63, 1000 - int(1000 * share)).astype(np.uint64)])
        one, two = near_dedup.sketched(near_dedup.sampled([np.unique(base), other]))
        assert (int(np.bitwise_count(one ^ two).sum()) <= most) is near


def test_filtering_keeps_columns_and_null_ids(spark):
    rows = cases.edges(spark)
    left = near_dedup.deduplicated(rows)
    assert left.columns == rows.columns
    ids = [row.doc_id for row in left.collect()]
    assert ids.count(None) == 2 and ids.count(900006) == 1 and 900007 not in ids and 900010 not in ids and 900002 in ids
    assert near_dedup.similar_documents(rows.limit(0)).count() == 0
