"""Words on pages, blocks of sheets, and the coverage of a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thetaloom.functions.text import missing_words, squeezed
from thetaloom.operators.joins import same_keys
from thetaloom.operators.work import row_index
from thetaloom.session import spread, written

# Fixed values of the sheets: cells that mean "not available", and the labels of the rows that structure a block.
NOT_AVAILABLE = ["N/A", "—", "."]
BLOCK_START, BLOCK_FIRST, BLOCK_MARKER, BLOCK_END = "Item classification", "International average", "Benchmarking participants", "Average score not compared"
HOME = "United States"
ITEM_IN_CELL = r"\((M\w+)\)\s*$"


def line_anchors(words: DataFrame, page: str, center: str, tolerance: float = 4.0) -> DataFrame:
    """(page, center, line) of every distinct center: in order, a center joins the open line if it is less than
    ``tolerance`` below the line's first center. Equal centers are combined before the shuffle; each task then streams
    through the sorted centers of its pages and keeps only the open line. Words without a page are on one page."""
    centers = words.groupBy(page, center).agg(F.count("*").alias("_n")).select(page, center)
    kind = centers.schema[page].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, anchor, line = object(), 0.0, 0
        for batch in batches:
            lines = np.empty(len(batch), dtype=np.int64)
            for i, (key, value) in enumerate(zip(batch[page].to_numpy(), batch[center].to_numpy())):
                if key != current and not (pd.isna(key) and pd.isna(current)):
                    current, anchor, line = key, value, 0
                elif value - anchor >= tolerance:
                    anchor, line = value, line + 1
                lines[i] = line
            yield batch.assign(line=lines)

    ordered = centers.repartition(page).sortWithinPartitions(page, center)
    return ordered.mapInPandas(run, f"{page} {kind}, {center} double, line bigint")


def lines(words: DataFrame, page: str, center: str, tolerance: float = 4.0) -> DataFrame:
    """``words`` with the number of their line on the page."""
    return same_keys(words, line_anchors(words, page, center, tolerance), [page, center])


def center(low, high) -> Column:
    return (F.col(low) + F.col(high)) / 2


def line_text(words: DataFrame, page: str, x: str, text: str, tie: str) -> DataFrame:
    """The text of each line, its words left to right. A line holds the few words of one row of a page."""
    ordered = F.array_sort(F.collect_list(F.struct(x, tie, text)))
    return words.groupBy(page, "line").agg(F.array_join(F.transform(ordered, lambda w: w[text]), " ").alias("text"))


def labelled_values(blocks: DataFrame, page: str, y: str, text: str, labels: list[str]) -> DataFrame:
    """Each recognised label with the next block below it as its value. Blocks meet their neighbour by their place on the
    page, so only the labels and one block each are joined, however many blocks a page has."""
    placed = written(row_index(blocks.select(page, y, text), [page], y, "_i"), "blocks")
    below = placed.select(page, (F.col("_i") - 1).alias("_i"), squeezed(text).alias("value"))
    found = placed.select(page, "_i", F.trim(text).alias("label")).filter(F.col("label").isin(labels))
    return found.join(below, [page, "_i"]).filter("value is not null").drop("_i")


def first_at_place(words: DataFrame, page: str, x: str, y: str, text: str, order: str) -> DataFrame:
    """One word per rounded place and text: the first seen, by a minimum that is combined before the shuffle."""
    rest = [name for name in words.columns if name not in (page, text)]
    place = words.groupBy(page, F.bround(x).alias("_x"), F.bround(y).alias("_y"), text).agg(F.min_by(F.struct(*rest), order).alias("_w"))
    return place.select(page, text, "_w.*")


def cell_value(cell) -> Column:
    text = F.trim(cell)
    return F.when(~text.isin(*NOT_AVAILABLE), text).try_cast("double")


def block_percent_correct(cells: DataFrame) -> DataFrame:
    """Percent correct per item and education system from sheets of stacked blocks (sheet, sheet_row, col, value): column
    0 holds the row labels, and the first row of a block the item of each further column. The window that numbers the
    blocks runs over the labels of one sheet, at most the 1,048,576 rows a sheet can have."""
    labels = cells.filter("col = 0").select("sheet", "sheet_row", F.trim("value").alias("label"))
    start = F.col("label").startswith(BLOCK_START)
    before = Window.partitionBy("sheet").orderBy("sheet_row").rowsBetween(Window.unboundedPreceding, 0)
    rows = labels.withColumn("block", F.sum(start.cast("int")).over(before)).filter("sheet is not null and block is not null")
    block = Window.partitionBy("sheet", "block")
    first = lambda test: F.min(F.when(test, F.col("sheet_row"))).over(block)
    placed = rows.withColumns({
        "_start": first(start), "_first": first(F.col("label") == BLOCK_FIRST),
        "_marker": first(F.col("label").startswith(BLOCK_MARKER)), "_end": first(F.col("label").startswith(BLOCK_END)),
    })
    # A column's item stands in the block's first row. A window over the column gives it to the rows below, so the cells are
    # not joined with themselves.
    inside = F.expr("sheet_row >= _first and sheet_row < _end and (sheet_row < _marker or sheet_row > _marker)")
    value = F.struct(
        F.col("label").alias("education_system"), cell_value("value").alias("pct_correct"), (F.col("sheet_row") > F.col("_marker")).alias("benchmarking"),
        (F.col("sheet_row") == F.col("_first")).alias("international"),
    )
    item = F.when(F.col("sheet_row") == F.col("_start"), F.nullif(F.regexp_extract("value", ITEM_IN_CELL, 1), F.lit("")))
    values = cells.filter("col > 0").join(placed, ["sheet", "sheet_row"]).select("sheet", "block", "col", F.when(inside, value).alias("_value"), item.alias("_item"))
    values = values.filter("_value is not null or _item is not null")
    items = F.collect_list("_item").over(Window.partitionBy("sheet", "block", "col"))
    below = values.withColumn("_items", items).filter("_value is not null")
    return below.select("sheet", F.explode("_items").alias("item_id"), "_value.*")


def item_averages(table: DataFrame) -> DataFrame:
    """The international and home row of each item side by side, with its education systems counted."""
    return table.groupBy("sheet", "item_id").agg(
        F.max(F.when(F.col("international"), F.col("pct_correct"))).alias("pct_correct_intl_avg"),
        F.max(F.when(F.col("education_system") == HOME, F.col("pct_correct"))).alias("pct_correct_home"),
        F.sum((~F.col("international")).cast("bigint")).alias("education_systems"),
        F.sum(F.col("benchmarking").cast("bigint")).alias("benchmarking_participants"),
    )


def harmonized(information: DataFrame, names: DataFrame, subject: str = "M") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of one subject with squeezed headings and trimmed values and the framework name of their topic, from a lookup
    (domain, spelling, topic); then the pairs without a name, and the repeated item IDs."""
    clean = information.select(*[F.trim(F.col(f"`{name}`")).alias(" ".join(name.split())) for name in information.columns])
    rows = clean.filter(F.col("`Subject`") == subject).withColumnsRenamed({"Content Domain": "domain", "Topic Area": "spelling", "Item ID": "item_id"})
    unknown = rows.select("domain", "spelling").distinct().join(names, ["domain", "spelling"], "left_anti")
    repeats = rows.groupBy("item_id").count().filter("count > 1").select("item_id")
    return rows.join(names, ["domain", "spelling"]).drop("Subject"), unknown, repeats


def coverage(pairs: DataFrame, key: str, source: str, target: str, min_length: int = 3) -> DataFrame:
    """Words of the source text that the target lacks, for the rows that miss any, worst first."""
    # As a generated row, so that the words are found once and not again for every column that uses them.
    rows = spread(pairs).select(key, F.inline(F.array(missing_words(source, target, min_length)))).filter(F.size("missing") > 0)
    share = 1 - F.size("missing") / F.size("words")
    return rows.select(key, share.alias("coverage"), F.array_join("missing", " ").alias("missing_words")).orderBy("coverage", key)
