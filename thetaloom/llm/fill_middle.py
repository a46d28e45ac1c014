"""Fill-in-middle order by counted quantifiers, in DataFrame functions only.

``regexp_count`` gives a text's number of units. The cut places of a row go into a pattern of its own: possessive
``unit{a}`` and ``unit{b - a}`` are prefix and middle, what follows is the suffix, and one match writes the three parts in
their new order between marks. Possessive groups of possessive units never step back, so a match is linear in the text
and takes no stack, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thetaloom.llm.names import free_name

UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
"""Leading white space with a word, or white space at the end of a text: units tile a text without gaps."""
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = "<[PSM]>"
PLAIN, PSM, SPM = "plain", "psm", "spm"


def draws(id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a row, from the SHA-256 of the seed and the id; a null id is an empty string."""
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(code, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def ordered(docs: DataFrame, id: str = "doc_id", text: str = "text", rate: int = 50, spm: int = 80, seed: int = 42) -> DataFrame:
    """``docs`` with a struct column ``fim`` (underscores before it where ``docs`` has one): ``n`` units, ``form``,
    ``prefix_chars`` and ``middle_chars`` in code points, and ``output``.

    ``rate`` percent of the texts are cut, ``spm`` percent of these with the suffix first. A null text is an empty one.
    Empty texts and texts that hold a mark stay plain, with null lengths. What a row becomes depends on its id and text
    alone: repeated rows become the same, and rows with a null id draw as if the id were an empty string. Texts of any
    length are taken whole; an empty table gives an empty one."""
    name = free_name(docs, "fim")
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    first, second, whether, which = draws(F.col(f"`{id}`"), seed)
    counted = docs.withColumn(name, F.struct(F.regexp_count(content, F.lit(UNIT)).cast("bigint").alias("n"), first.alias("h1"), second.alias("h2"), (whether % 100).alias("h3"), (which % 100).alias("h4")))
    n, cut = F.col(name)["n"], lambda h: F.col(name)[h] % (F.col(name)["n"] + 1)
    stays = (content == "") | content.rlike(MARKS) | (F.col(name)["h3"] >= rate)
    form = F.when(stays, PLAIN).when(F.col(name)["h4"] < spm, SPM).otherwise(PSM)
    a, b = F.least(cut("h1"), cut("h2")), F.greatest(cut("h1"), cut("h2"))
    counted = counted.withColumn(name, F.struct(n.alias("n"), form.alias("form"), a.alias("a"), (b - a).alias("span")))
    shape = F.col(name)["form"]
    pattern = F.format_string(rf"(?s)\A((?:{UNIT}){{%d}}+)((?:{UNIT}){{%d}}+)(.*+)\z", F.col(name)["a"], F.col(name)["span"])
    moved = F.when(shape == PSM, f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    output = F.when(shape == PLAIN, content).otherwise(F.regexp_replace(content, pattern, moved))
    made = counted.withColumn(name, F.struct(n.alias("n"), shape.alias("form"), output.alias("output")))
    prefix, middle, _ = parts(F.col(name)["output"], shape)
    return made.withColumn(name, F.struct(n.alias("n"), shape.alias("form"), F.length(prefix).cast("bigint").alias("prefix_chars"), F.length(middle).cast("bigint").alias("middle_chars"), F.col(name)["output"].alias("output")))


def parts(output: Column, form: Column) -> tuple[Column, Column, Column]:
    """Prefix, middle and suffix of an output, null where it is plain. A text that is cut holds no mark and none can arise
    where a part meets a mark, so the three marks are where the parts were joined."""
    pieces = F.split(output, MARKS, -1)
    cut = lambda psm, spm: F.when(form == PSM, pieces[psm]).when(form == SPM, pieces[spm])
    return cut(1, 2), cut(3, 3), cut(2, 1)


def restored(output: Column, form: Column) -> Column:
    """The text as it was, from an output and its form."""
    prefix, middle, suffix = parts(output, form)
    return F.when(form == PLAIN, output).otherwise(F.concat(prefix, middle, suffix))
