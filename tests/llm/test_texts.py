"""Operators that judge each text by itself: decontamination, quality, licenses, BPE."""

import collections
import random
import re
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import cases
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from thetaloom.llm import bpe, decontaminate, licenses, quality

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def item_words(text):
    return ITEM_WORD.findall((text or "").translate(cases.ASCII_LOWER))


def hit_words(text, items, size):
    w, hit, names = item_words(text), set(), set()
    for name, item in items:
        own = item_words(item)
        length = min(size, len(own))
        windows = {tuple(own[i : i + length]) for i in range(len(own) - length + 1)} if own else set()
        for i in range(len(w) - length + 1):
            if tuple(w[i : i + length]) in windows:
                hit.update(range(i, i + length))
                names.add(name)
    return len(w), len(hit), sorted(names)


def test_automaton_against_brute_force():
    rng = random.Random(2)
    for trial in range(400):
        letters = "ab" if trial % 2 else "abcdé"
        text = lambda n, letters=letters: " ".join(rng.choice(letters) for _ in range(n))
        items = tuple((str(i), text(rng.randrange(8))) for i in range(rng.randrange(5)))
        texts = [text(rng.randrange(30)) for _ in range(4)] + [None, ""]
        size = rng.randrange(1, 5)
        for one, found in zip(texts, decontaminate.found_in(pa.array(texts, pa.string()), decontaminate._automaton(items, size)).to_pylist(), strict=True):
            assert (found["n_words"], sum(b - a for a, b in zip(found["hit_from"], found["hit_to"], strict=True)), found["items"]) == hit_words(one, items, size)


def test_decontamination_in_shards(spark):
    rows = cases.documents(spark)
    items = spark.read.parquet(f"{cases.FOLDER}/benchmark.parquet").union(spark.createDataFrame([(700001, cases.SHARED), (700002, None), (700003, "..."), (700004, "lazy dog")], "item_id bigint, text string"))
    listed = [(str(r.item_id), r.text) for r in items.collect()]
    expected = collections.Counter((id, *map(str, hit_words(text, listed, 10))) for id, text in cases.texts_of(rows))
    for shard_bytes in (decontaminate.SHARD_BYTES, 3_000):
        found = decontaminate.contamination(rows, items, shard_bytes=shard_bytes).select("doc_id", "contamination.*").collect()
        assert collections.Counter((r.doc_id, str(r.n_words), str(r.n_hit), str(sorted(r["items"]))) for r in found) == expected


def test_cutting_passages(spark):
    items = spark.createDataFrame([(1, cases.SHARED)], "item_id bigint, text string")
    rows = cases.edges(spark)
    left = decontaminate.decontaminated(rows, items)
    assert left.columns == rows.columns
    by = {r.doc_id: r.text for r in left.where("doc_id is not null").collect()}
    assert 900006 not in by and 900007 not in by  # nothing but the passage
    assert by[900001] is None and by[900002] == "" and by[900009] == cases.LONG
    half = decontaminate.decontaminated(rows, items, max_coverage=1.0)
    # Two passages side by side are one cut; the last character is no word.
    assert {r.text for r in half.where("doc_id = 900008").collect()} == {"É😀 before . after"}
    nothing = decontaminate.contamination(rows, items.limit(0))
    assert nothing.where("contamination.n_hit > 0").count() == 0 and nothing.count() == rows.count()
    assert decontaminate.decontaminated(rows.limit(0), items).count() == 0


def test_quality_rules(spark):
    rows = cases.documents(spark)
    found = rows.select("doc_id", "text", quality.quality(F.col("text"), PIECES).alias("q")).select("text", "q.*").collect()
    for row in found:
        text = row.text or ""
        w = cases.WORD.findall(text)
        lines = [line for line in text.split("\n") if cases.WORD.search(line)]
        triples = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        again = {i + k for i in range(len(w) - 2) if triples[(w[i], w[i + 1], w[i + 2])] > 1 for k in range(3)}
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == expected
        assert row.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (row.base_failed and row.kept)
    running = [row for row in found if not row.base_failed]
    assert sum(row.kept for row in running) >= 0.98 * len(running)


def test_fertility_bands(spark):
    noise = " ".join("".join(chr(0x2000 + (i * 37 + k * 101) % 900) for k in range(8)) for i in range(80))
    plain = "the people of the town came to the market every day to buy bread and fruit from farmers who live near the old river " * 2
    same = " ".join(f"a{'b' * (i % 3)}" for i in range(90)).replace("b", "")
    rows = spark.createDataFrame([(1, noise), (2, plain + "and " + " ".join(f"number{i}" for i in range(60))), (3, same)], "id int, text string")
    kept = {r.id: r.kept for r in rows.select("id", quality.quality(F.col("text"), PIECES).kept.alias("kept")).collect()}
    assert kept[2] and not kept[1] and not kept[3]
    odd = cases.edges(spark)
    assert quality.kept_documents(odd, PIECES).columns == odd.columns and quality.kept_documents(odd.limit(0), PIECES).count() == 0


def test_bpe_is_the_librarys(spark):
    reference = Tokenizer.from_file(WORD_BPE)
    reference.no_truncation()
    reference.no_padding()
    rng = random.Random(5)
    pool = [chr(c) for c in [*range(1, 600), *range(0x300, 0x600), *range(0x1D00, 0x2100), *range(0x3000, 0x3100), 0x1F600, 0x200D]]
    odd = ["ΑΣ ΣΑΣ", "it'S we'LL o'clock 12½", "<|startoftext|>x<|endoftext|><|endoftext", "a\x1cb\x85c", "x" * 500, *("".join(rng.choice(pool) for _ in range(20)) for _ in range(300))]
    rows = cases.edges(spark).select("doc_id", "text", "ids", "DECODED").union(spark.createDataFrame([(i, x, "", "") for i, x in enumerate(odd)], "doc_id bigint, text string, ids string, DECODED string"))
    found = bpe.encoded(rows, WORD_BPE)
    assert found.columns == ["doc_id", "text", "ids", "DECODED", "_ids", "_decoded"]
    for row in found.collect():
        ids = reference.encode(row.text or "", add_special_tokens=False).ids
        assert np.frombuffer(row._ids, "<u4").tolist() == ids
        assert row._decoded == reference.decode(ids, skip_special_tokens=False)
    assert bpe.encoded(rows.limit(0), WORD_BPE).count() == 0


def test_alignment():
    text, template = list("xxabcyydefzz"), list("abcdef")
    assert [template[c] for _, c in licenses.aligned(text, template)] == list("abcdef")
    assert licenses.aligned([], list("a")) == [] and licenses.aligned(list("ba"), list("ab")) in ([(0, 1)], [(1, 0)])
    values = [3, 1, 2, 5, 4, 6]
    assert [values[i] for i in licenses.increasing(values)] == [1, 2, 4, 6]


def test_licenses(spark):
    mit, apache = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["Apache-2.0"]
    texts = [None, "", "no notice here", mit, f"{'some words ' * 300}{apache.upper()} and {mit} {mit}", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache Licence, Version 2.0", "license version public general", cases.LONG]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = {r.id: [(x.license, x.first_word) for x in r.found] for r in rows.select("id", licenses.licenses(F.col("text")).alias("found")).collect()}
    assert found == {0: [], 1: [], 2: [], 3: [("MIT", 0)], 4: [("Apache-2.0", 600), ("MIT", 609), ("MIT", 614)], 5: [("CC-BY-NC-4.0", 0)], 6: [("Apache-2.0", 0)], 7: [], 8: []}


def found_in(texts):
    scan = licenses.scanned(pa.array(texts, pa.string()), licenses.Templates(tuple(sorted(licenses.TEMPLATES.items()))))
    return [[x["license"] for x in row] for row in scan.to_pylist()]


def test_licenses_that_differ_in_a_word():
    gnu = "This work is licensed under the GNU {} License, version {}."
    of = {
        "Released under the BSD License.": [], "Released under the ISC License.": [], "Released under the Mozilla License.": [],
        "Released under the MIT License.": ["MIT"], "Licensed under CC BY-SA 4.0.": ["CC-BY-SA-4.0"], "Licensed under CC BY 3.0.": ["CC-BY-3.0"],
        "Licensed under CC BY-NC-ND 4.0.": ["CC-BY-NC-ND-4.0"], "Licensed under CC BY-NC-ND-SA 4.0.": [], "Licensed under CC BY 1.0.": [],
        gnu.format("Lesser General Public", 3): ["LGPL-3.0"], gnu.format("Affero General Public", 3): ["AGPL-3.0"],
        gnu.format("General Public", 2): ["GPL-2.0"], gnu.format("Library General Public", 2): [], gnu.format("General Public", 1): [],
        "Licensed under the Apache License, Version 1.1.": [], "Licensed under the Apache Software License, Version 2.0.": [],
    }
    assert dict(zip(of, found_in(list(of)), strict=True)) == of


def test_every_template_is_found_as_itself():
    texts = [f"before it {text.upper()} after it" for text in licenses.TEMPLATES.values()]
    assert found_in(texts) == [[name] for name in licenses.TEMPLATES]
    clauses = licenses.TEMPLATES["BSD-3-Clause"].replace("the copyright holder nor", "Acme nor").replace("1.", "*").replace("2.", "*").replace("3.", "*")
    assert found_in([f"{clauses} {clauses}", clauses.replace("THIS SOFTWARE IS PROVIDED BY", "HERE IS")]) == [["BSD-3-Clause"] * 2, ["BSD-3-Clause"]]


def test_long_texts_of_license_words():
    start = time.time()
    mit = licenses.TEMPLATES["MIT"]
    assert [len(x) for x in found_in(["mit " * 250_000, "gnu cc by apache 2 0 " * 20_000, f"{mit} " * 2_000])] == [0, 0, 2_000]
    assert time.time() - start < 60


def test_alignment_against_longest_common_subsequence():
    """With words that occur once, the alignment is a longest common subsequence; else it is a common one."""

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for at, y in enumerate(b):
                row.append(last[at] + 1 if x == y else max(last[at + 1], row[at]))
        return row[-1]

    rng = random.Random(4)
    for size in range(40):
        template = rng.sample(range(60), size)
        text = rng.sample(range(60), rng.randrange(60))
        assert len(licenses.aligned(text, template)) == longest(text, template)
        text, template = ([rng.randrange(8) for _ in range(size)] for _ in range(2))
        pairs = licenses.aligned(text, template)
        assert all(text[a] == template[b] for a, b in pairs) and len(pairs) <= longest(text, template)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False))


def test_license_query_on_odd_rows(spark):
    rows = cases.edges(spark)
    notices = rows.select("*", licenses.licenses(F.col("text")).alias("found"))
    assert notices.count() == rows.count() and notices.filter("size(found) = 0").count() == rows.count()
    assert notices.limit(0).count() == 0 and set(cases.CLASHING) <= set(notices.columns)


def test_notices_at_the_limit_of_coverage(spark):
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    texts = ["Distributed under the MIT License.", "Available under CC BY 4.0.", "Available under CC BY-NC 4.0.", f"under way: {gpl}", gpl.replace("General", "Lesser General"), "under the sea"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = {r.id: [(x.license, round(x.coverage, 2)) for x in r.found] for r in rows.select("id", licenses.licenses(F.col("text")).alias("found")).collect()}
    assert [found[i] for i in range(6)] == [[("MIT", 0.8)], [("CC-BY-4.0", 0.83)], [("CC-BY-NC-4.0", 0.86)], [("GPL-3.0-header", 1.0)], [("LGPL-3.0-header", 1.0)], []]
    assert licenses.needed([1, 1, 1], 1) == 2 and licenses.needed([1, 3], 2) == 1 and licenses.needed([3], 2) == 1


def test_bands_of_the_language(spark):
    draw = random.Random(5)
    words = ["".join(draw.choice("bcdlmnrst") + draw.choice("aeiou") for _ in range(2 + i % 3)) for i in range(300)]
    plain = [" ".join(draw.choices(words, k=100 + i)) for i in range(60)]
    junk = " ".join(f"{w} ###" for w in plain[0].split())
    rows = spark.createDataFrame([(i, "en", t) for i, t in enumerate([*plain, junk])] + [(100, None, plain[0]), (101, "en", None)], "doc_id int, lang string, text string")
    kept = {r.doc_id: r.kept for r in quality.judged(rows, PIECES).collect()}
    assert len(kept) == 63 and not kept[60] and not kept[101] and kept[100] and sum(kept[i] for i in range(60)) >= 58
    assert quality.judged(rows.limit(0), PIECES).count() == 0
    # The rows that stay are those whose verdict says so, with columns whose names clash.
    clash = rows.withColumn("quality", F.lit(1)).withColumn("quality_line", F.lit(2)).withColumn("chars", F.lit(3)).withColumn("rest", F.lit(4))
    stay = quality.kept_documents(clash, PIECES)
    assert stay.columns == clash.columns and sorted(r.doc_id for r in stay.collect()) == sorted(id for id, one in kept.items() if one)
