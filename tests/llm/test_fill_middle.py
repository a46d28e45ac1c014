"""Fill-in-middle order against a version by lists, and back."""

import hashlib
import re

import cases
from pyspark.sql import functions as F

from thetaloom.llm import fill_middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def by_lists(id, text, rate, spm, seed):
    text = text or ""
    units = UNIT.findall(text)
    code = hashlib.sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()
    h = [int(code[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}", text
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}", text


ODD = [
    (None, "a null id"), (5, None), (6, ""), (7, " "), (8, " \n\t\r\x0b\x0c "), (9, "with <P> mark"), (10, "a <M>"), (11, "$1 \\2 <S <P M> ${x}"), (12, "<"), (13, "S> x <"),
    (14, "é😀   x y\x1cz\x85 \x00 end "), (15, "one"), (15, "one"), (16, "  lead and trail  \n"), (17, "日本語 テキスト\n" * 50),
]


def test_against_lists(spark):
    rows = ODD + [(100 + i, f" word{i}\n\n next  <{i}> x{i} " * (i % 9)) for i in range(60)]
    frame = spark.createDataFrame([(*row, "kept", 1) for row in rows], "doc_id bigint, text string, FIM string, n int")
    for rate, spm, seed in ((50, 80, 42), (100, 0, 7), (100, 100, 42), (0, 50, 42)):
        found = fill_middle.ordered(frame, rate=rate, spm=spm, seed=seed)
        assert found.columns == [*frame.columns, "_fim"]
        back = fill_middle.restored(F.col("_fim.output"), F.col("_fim.form"))
        got = sorted(map(tuple, found.select("doc_id", "text", "_fim.*", back).collect()), key=str)
        assert got == sorted(((id, text, *by_lists(id, text, rate, spm, seed)) for id, text in rows), key=str)


def test_long_texts_take_no_stack(spark):
    text = " ab" * 400_000
    frame = spark.createDataFrame([(1, text), (2, "x" * 1_200_000), (3, " " * 1_200_000), (4, text + "  ")], "doc_id bigint, text string")
    found = fill_middle.ordered(frame, rate=100)
    for id, content, n, form, pre, mid, output in found.select("doc_id", "text", "fim.*").collect():
        assert (n, form, pre, mid, output, content) == by_lists(id, content, 100, 80, 42)


def test_empty_table(spark):
    found = fill_middle.ordered(spark.createDataFrame([], "doc_id bigint, text string"))
    assert found.columns == ["doc_id", "text", "fim"] and found.count() == 0
