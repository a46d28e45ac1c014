"""Secret scans with corpus-wide ownership, in DataFrame functions only.

Patterns find candidates and their places. Each value's hash is counted over the distinct repositories and owners of the
whole corpus: a value that many owners have is a copied example, one that few have and that looks random is taken for
live. Candidates of the base kinds always stay; further kinds, whose patterns alone say little, stay only where they are
live.

Places come from the texts between the matches: the k-th match starts after the first k gaps and k - 1 matches. They are
summed in exploded rows, so a text may have any number of matches. The patterns read a run of any length once or twice, so a
very long text costs in proportion. Ties don't arise: spans are ordered by start and kind. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thetaloom.llm.names import free_name
from thetaloom.llm.scratch import written

#: Kind, pattern, the group that holds the value, its least length; in the order in which kinds are listed.
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    # A run of at least so many characters is found at the same places as any run that is then held against the least length.
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
FURTHER = [
    ("prefixed", r"(?:gh[pousr]_|xox[abprs]-|sk-|AIza|glpat-)[A-Za-z0-9_-]{16,}", 0, 20),
    ("bearer", r"[Bb]earer\x20+([A-Za-z0-9._~+/=-]{20,})", 1, 20),
    # Both begin at the left end of a run and don't step back into it, so a run of any length is read once.
    ("webtoken", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, 28),
    ("login", r"(?<![A-Za-z0-9+.-])[a-z][a-z0-9+.-]*+://[^\s:/@]++:([^\s:/@]{8,}+)@", 1, 8),
]
MAX_OWNERS, MAX_REPOSITORIES = 2, 4
"""A value of more owners or repositories than these is an example."""
DIFFERENT_CHARACTERS = 6
"""A live value has as many different characters at least."""
KEY = ["id", "code", "size"]
"""What stands for a row: its id, and hash and length of its text. Rows that agree have the same spans."""


def _key(docs: DataFrame, id: str, text: str) -> list[Column]:
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return [F.col(f"`{id}`").alias("id"), F.xxhash64(content).alias("code"), F.octet_length(content).alias("size")]


def _found(text: Column, kinds: list) -> Column:
    """The candidates of each kind that has any: lengths of the gaps before them, whole matches and values."""

    def one(rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
        matches = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
        gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
        each = F.arrays_zip(F.slice(gaps, 1, F.size(gaps) - 1).alias("gap"), matches(0).alias("match"), matches(group).alias("value"))
        return F.when(text.rlike(pattern), F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.lit(least).alias("least"), each.alias("each")))

    return F.filter(F.array(*[one(rank, *kind) for rank, kind in enumerate(kinds)]), lambda x: x.isNotNull())


def candidates(docs: DataFrame, id: str, text: str, owner: str, repository: Column, base: list = BASE, further: list = FURTHER) -> DataFrame:
    """One row per row of ``docs``, with ``found``; written once, since texts are scanned here only."""
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(*_key(docs, id, text), F.col(f"`{owner}`").cast("string").alias("owner"), repository.cast("string").alias("repository"), _found(content, [*base, *further]).alias("found"))
    return written(rows, "candidates")


def owners(rows: DataFrame) -> DataFrame:
    """By value hash: the numbers of distinct owners and repositories. Rows with a null owner or repository count as one
    owner or repository of no name. A value's rows are reduced to distinct places before they meet."""
    values = rows.select("owner", "repository", F.explode("found").alias("f")).select("owner", "repository", F.explode("f.each.value").alias("value"))
    places = values.select(F.sha2("value", 256).alias("hash"), F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.lit("")).alias("repository")).distinct()
    by_owner = places.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def spans(rows: DataFrame, base: list = BASE) -> DataFrame:
    """The spans of the rows of :func:`candidates`: key, rank, kind, start and end in code points (end exclusive), the
    owners and repositories of the value, and ``live``."""
    single = rows.where(F.size("found") > 0).select(*KEY, "found").dropDuplicates(KEY)
    each = single.select(*KEY, F.explode("found").alias("f")).select(*KEY, "f.rank", "f.kind", "f.least", F.posexplode("f.each").alias("i", "x"))
    sizes = each.select(*KEY, "rank", "kind", "least", "i", F.col("x.value").alias("value"), F.length("x.match").alias("length"), F.col("x.gap").alias("gap"))
    upto = Window.partitionBy(*KEY, "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sizes.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(upto)).withColumn("start", F.col("end") - F.col("length"))
    right = placed.where(F.length("value") >= F.col("least")).withColumn("hash", F.sha2("value", 256))
    different = F.size(F.array_distinct(F.split("value", "")))
    judged = right.join(owners(rows), "hash").withColumn("live", (F.col("n_owners") <= MAX_OWNERS) & (F.col("n_repositories") <= MAX_REPOSITORIES) & (different > DIFFERENT_CHARACTERS))
    return judged.where((F.col("rank") < len(base)) | F.col("live")).select(*KEY, "rank", "kind", "start", "end", "n_owners", "n_repositories", "live")


def _same(frame: DataFrame, names: list[str], other: DataFrame, others: list[str]) -> Column:
    condition = F.lit(True)
    for x, y in zip(names, others, strict=True):
        condition = condition & frame[x].eqNullSafe(other[y])
    return condition


def scanned(docs: DataFrame, id: str, text: str, owner: str, repository: Column, base: list = BASE) -> DataFrame:
    """Each row's ``id`` and its ``spans``: sorted by start and kind, with ``live`` and the numbers of owners and
    repositories of the value. A null or empty text has none; rows that repeat have the same."""
    rows = candidates(docs, id, text, owner, repository, base)
    found = spans(rows, base).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end", "n_owners", "n_repositories", "live"))).alias("spans"))
    names = [f"found_{x}" for x in KEY]
    found = found.select(*[F.col(x).alias(y) for x, y in zip(KEY, names, strict=True)], "spans")
    empty = F.array().cast("array<struct<start: bigint, rank: int, kind: string, end: bigint, n_owners: bigint, n_repositories: bigint, live: boolean>>")
    return rows.join(found, _same(rows, KEY, found, names), "left").select("id", F.coalesce("spans", empty).alias("spans"))


def redacted(docs: DataFrame, id: str, text: str, owner: str, repository: Column, mark: str = "[SECRET]", only_live: bool = True) -> DataFrame:
    """``docs`` with the spans of live values replaced by ``mark`` in the text; copied examples stay unless ``only_live``
    is false. Overlapping spans are one."""
    found = spans(candidates(docs, id, text, owner, repository))
    found = found.where("live") if only_live else found
    row = Window.partitionBy(*KEY).orderBy("start", "rank")
    before = F.max("end").over(row.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.withColumn("new", (F.col("start") > F.coalesce(before, F.lit(-1))).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(row.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = runs.groupBy(*KEY, "run").agg(F.min("start").alias("a"), F.max("end").alias("b"))
    cuts = free_name(docs, "secret_spans")
    names = [free_name(docs, f"secret_{x}") for x in KEY]
    runs = runs.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias(cuts)).select(*[F.col(x).alias(y) for x, y in zip(KEY, names, strict=True)], cuts)
    keys = [free_name(docs, f"secret_own_{x}") for x in KEY]
    keyed = docs.select("*", *[column.alias(name) for column, name in zip(_key(docs, id, text), keys, strict=True)])
    joined = keyed.join(runs, _same(keyed, keys, runs, names), "left")
    content = F.col(f"`{text}`")
    zero = F.lit(0).cast("bigint")
    begins = F.concat(F.array(zero), F.transform(cuts, lambda x: x.b))
    ends = F.concat(F.transform(cuts, lambda x: x.a), F.array(F.length(content).cast("bigint")))
    kept = F.zip_with(begins, ends, lambda a, b: F.substring(content, (a + 1).cast("int"), (b - a).cast("int")))
    return joined.withColumn(text, F.when(F.col(cuts).isNotNull(), F.array_join(kept, mark)).otherwise(content)).drop(cuts, *names, *keys)
