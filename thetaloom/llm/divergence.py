"""How sources differ in their words, by joint tables of count levels from one-hot level products.

A group is one (language, source); the terms of a language are those that enough of its documents have. A term's smoothed
frequency in a group depends on nothing but the group and the term's count there, its level. So a sum over all terms of
any price of two groups' frequencies is a sum over the joint table of the two groups' levels: how many terms have level a
in one group and level b in the other. With a 0/1 column for each (group, level above zero) and a row for each term, the
product of the matrix's transpose with the matrix is every joint table at once. Terms without a count in a group need no
column: their share follows from the group's own levels and the number of terms.

Terms are dealt over tasks, which multiply blocks of rows and columns of bounded size. A block's joint tables are priced
where they arise, in integers, and only sums by pair of groups leave a task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thetaloom.llm.scratch import written

UNIT = 1_000_000_000
"""A frequency of one."""
LEAST_DOCUMENTS, TOP = 3, 200
COLUMNS = 256
"""Columns (group, level) of a block of the product at most, but for a term that has more of its own."""
ROWS = 2048
"""Terms of a block at most; a float holds every count of a joint table of so many exactly."""
KEPT = 200_000
"""Terms that a task of the first pass counts before it hands them on."""
HALF = 31
"""Prices are added up in two parts of so many bits, since a sum of prices can pass 64 bits."""

#: Bytes that end a term; others stay, with A-Z lower-cased. Bytes of characters from U+0080 on belong to terms.
_KEEPS = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts by (lang, source, term): occurrences and texts; a null term marks a group that occurs."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (many, texts) in held.items():
            terms = list(many)
            columns = [[lang] * (len(terms) + 1), [source] * (len(terms) + 1), [None, *(x.decode("utf-8", "replace") for x in terms)], [0, *many.values()], [0, *map(texts.__getitem__, terms)]]
            kinds = [pa.string()] * 3 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["lang", "source", "term", "n", "texts"])

    size = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(x) for x in ("lang", "source", "text")), strict=True):
            group = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            words = text.as_py().encode("utf-8", "surrogatepass").translate(_KEEPS).split(b" ")
            mine = Counter(words)
            mine.pop(b"", None)
            size -= len(group[0])
            group[0].update(mine)
            group[1].update(mine.keys())
            size += len(group[0])
            if size > KEPT:
                yield from rows()
                held, size = {}, 0
    yield from rows()


def vocabulary(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """The kept terms (lang, term, total, by: the sources that have it with their counts), and all groups (lang, source,
    own: the sum of its counts, all: that of its language, terms: how many the language keeps)."""
    plain = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
    source_rows = docs.select(plain(lang).alias("lang"), plain(source).alias("source"), plain(text).alias("text"))
    partial = source_rows.mapInArrow(counted, "lang string, source string, term string, n bigint, texts bigint")
    counts = written(partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")), "term-counts")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("texts").alias("texts"), F.collect_list(F.struct("source", "n")).alias("by"))
    kept = written(kept.where(F.col("texts") >= least).drop("texts"), "terms")
    own = kept.select("lang", F.explode("by").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("own"))
    whole = kept.groupBy("lang").agg(F.sum("total").alias("all"), F.count("*").alias("terms"))
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    groups = counts.where("term is null").select("lang", "source").join(own, ["lang", "source"], "left").join(whole, "lang", "left")
    return kept, written(groups.select("lang", "source", zero("own"), zero("all"), zero("terms")), "groups")


def frequency(count: Column, total: Column, terms: Column) -> Column:
    """The smoothed frequency in units, with a numerator that may pass 64 bits; null without terms."""
    exact = (F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")).cast("decimal(38,0)")
    below = F.when(terms > 0, total + terms).cast("decimal(38,0)")
    return _quotient(exact, below) + 1


def _quotient(above: Column, below: Column) -> Column:
    return F.call_function("div", above, below)


def price(p: Column, q: Column) -> Column:
    return _quotient((p - q) * (p - q), q)


def _prices(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    apart = p[:, None] - q[None, :]
    return apart * apart // q[None, :]


def block_sums(group: np.ndarray, level: np.ndarray, none: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Of entries in the order of their terms (the group, the frequency there, the group's frequency without a count, the
    term's row): pairs of groups, and the upper and lower parts of the sum over the terms of what the pair's price is more
    than it is with either or both of the counts at zero. Entries of too many columns are two blocks."""
    order = np.lexsort((level, group))
    g, x = group[order], level[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (x[1:] != x[:-1])]
    if row[-1] > row[0] and (new.sum() > COLUMNS or row[-1] - row[0] >= ROWS):
        half = int(np.searchsorted(row, (row[0] + row[-1] + 1) // 2))
        for part in (slice(None, half), slice(half, None)):
            yield from block_sums(group[part], level[part], none[part], row[part])
        return
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    groups, p, p0 = g[new], x[new], none[order][new]
    indicator = np.zeros((int(row[-1] - row[0]) + 1, len(groups)), np.float32)
    indicator[row - row[0], place] = 1
    begin = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    own = groups[begin]
    for first in range(0, len(begin), COLUMNS):  # whole groups of columns against all
        last = min(first + COLUMNS, len(begin))
        a, b = begin[first], np.r_[begin, len(groups)][last]
        joint = (indicator[:, a:b].T @ indicator).astype(np.int64)
        more = _prices(p[a:b], p) - _prices(p[a:b], p0) - _prices(p0[a:b], p) + _prices(p0[a:b], p0)
        sums = [np.add.reduceat(np.add.reduceat(joint * part, begin, axis=1), begin[first:last] - a, axis=0).ravel() for part in (more >> HALF, more & ((1 << HALF) - 1))]
        yield np.repeat(own[first:last], len(own)), np.tile(own, last - first), *sums


def _added(found: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
    """One array of each kind with the sums by pair of groups."""
    one, other, upper, lower = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((other, one))
    one, other = one[order], other[order]
    new = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (other[1:] != other[:-1])])
    return [(one[new], other[new], np.add.reduceat(upper[order], new), np.add.reduceat(lower[order], new))]


def level_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, by: array of (source, p, p0)) to sums by (lang, source, other) over the rows of a batch."""
    for batch in batches:
        lists = batch.column("by")
        entries = lists.flatten()
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        languages = batch.column("lang").dictionary_encode()
        language = languages.indices.to_numpy()[row]
        sources = entries.field("source").dictionary_encode()
        source, level, none = sources.indices.to_numpy().astype(np.int64), entries.field("p").to_numpy(), entries.field("p0").to_numpy()
        for at, lang in enumerate(languages.dictionary.to_pylist()):
            mine = np.flatnonzero(language == at)
            found: list[tuple[np.ndarray, ...]] = []
            waiting = 0
            for sums in block_sums(source[mine], level[mine], none[mine], row[mine]) if len(mine) else ():
                found.append(sums)
                waiting += len(sums[0])
                if waiting > 1_000_000:
                    found, waiting = _added(found), 0
            if not found:
                continue
            one, other, upper, lower = _added(found)[0]
            apart = one != other
            names = [sources.dictionary.take(pa.array(x[apart])) for x in (one, other)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * int(apart.sum()), pa.string()), *names, pa.array(upper[apart]), pa.array(lower[apart])], names=["lang", "source", "other", "upper", "lower"])


def source_divergence(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Each group with each other source of its language (lang, source, item) and the sum of prices over the language's
    terms; ``rank`` by value, greatest first, then by source."""
    rates = groups.select("lang", "source", "terms", "own", frequency(F.lit(0), F.col("own"), F.col("terms")).alias("p0"))
    entries = kept.select("lang", "term", "total", F.explode("by").alias("x")).select("lang", "term", "total", "x.source", "x.n")
    priced = written(entries.join(rates, ["lang", "source"]).withColumn("p", frequency(F.col("n"), F.col("own"), F.col("terms"))), "levels")
    again = priced.groupBy("lang", "term").agg(F.max("total").alias("total"), F.collect_list(F.struct("source", "p", "p0")).alias("by"))
    # Terms of like counts stand together, so that a block has few levels.
    blocks = again.sortWithinPartitions("lang", "total").select("lang", "by").mapInArrow(level_products, "lang string, source string, other string, upper bigint, lower bigint")
    shared = blocks.groupBy("lang", "source", "other").agg(F.sum(F.col("upper").cast("decimal(38,0)")).alias("upper"), F.sum(F.col("lower").cast("decimal(38,0)")).alias("lower"))
    levels = written(priced.groupBy("lang", "source", "p").agg(F.count("*").alias("terms_at")), "level-sizes")
    pairs = groups.alias("a").join(groups.alias("b"), "lang").where("a.source <> b.source").select("lang", F.col("a.source").alias("source"), F.col("b.source").alias("other"))
    rate = lambda name, key: rates.select("lang", F.col("source").alias(key), F.col("p0").alias(name), *(["terms"] if key == "source" else []))
    pairs = written(pairs.join(rate("mine", "source"), ["lang", "source"]).join(rate("theirs", "other"), ["lang", "other"]), "pairs")
    # What a group's own levels change against the other at zero, and the other way round.
    alone = lambda key, value: levels.withColumnRenamed("source", key).join(pairs, ["lang", key]).groupBy("lang", "source", "other").agg(F.sum(F.col("terms_at").cast("decimal(19,0)") * value).alias("value"))
    p, mine, theirs = F.col("p"), F.col("mine"), F.col("theirs")
    first = alone("source", price(p, theirs) - price(mine, theirs))
    second = alone("other", price(mine, p) - price(mine, theirs))
    empty = pairs.select("lang", "source", "other", (F.col("terms").cast("decimal(19,0)") * price(mine, theirs)).alias("value"))
    both = shared.select("lang", "source", "other", (F.col("upper") * (1 << HALF) + F.col("lower")).cast("decimal(38,0)").alias("value"))
    wide = lambda frame: frame.withColumn("value", F.col("value").cast("decimal(38,0)"))
    value = wide(first).union(wide(second)).union(wide(empty)).union(both).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    found = value.select("lang", "source", F.col("other").alias("item"), F.coalesce("value", F.lit(0)).cast("bigint").alias("value"))
    return found.withColumn("rank", F.row_number().over(order))


def telling_terms(kept: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """Each group's terms (lang, source, item) that are more frequent in it than in its language, by price, greatest first,
    then by term; ``top`` of them."""
    entries = kept.select("lang", "term", "total", F.explode("by").alias("x")).select("lang", "term", "total", "x.source", "x.n").join(groups, ["lang", "source"])
    entries = entries.select("lang", "source", F.col("term").alias("item"), frequency(F.col("n"), F.col("own"), F.col("terms")).alias("p"), frequency(F.col("total"), F.col("all"), F.col("terms")).alias("q"))
    found = entries.where("p > q").select("lang", "source", "item", price(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def audited(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """``lang``, ``source``, ``part`` (``pair`` or ``term``), ``item``, ``value`` and ``rank`` of both reports.

    Null texts, languages and sources are empty strings; each row is a document, repeated rows too. A language without
    kept terms gives pairs of value zero and no terms. A group without another source gives no pair. Ties go by the item's
    UTF-8 bytes. Texts of any length are taken whole; an empty table gives an empty report; other columns are not read."""
    kept, groups = vocabulary(docs, text, lang, source, least)
    parts = (("pair", source_divergence(kept, groups)), ("term", telling_terms(kept, groups, top)))
    one, other = (frame.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, frame in parts)
    return one.union(other)
