"""URL verdicts: listed rules, and for the rest a logistic regression on hashed character n-grams of host and path.

DataFrame functions only. A small labelled table is one row's array of examples; the weights are one array, and training
is a fold over epochs and examples. Scoring looks the n-grams of a URL up in that array, a scalar of the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WEIGHTS = 4096
"""Length of the weight array; the last weight is the intercept."""
GRAMS = (3, 4)
EPOCHS, RATE, DECAY = 16, 0.6, 1e-4
MAX_LABELLED = 5_000
"""Labelled rows that are learned from: those of least hash, where there are more."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Labelled URLs of the kinds that web filters know: 1 is to be blocked.
LABELLED = [
    ("https://www.casino-royal.example/en/bonus", 1), ("http://online-casino.example.net/play/slots", 1), ("https://best-casino-win.example.org/en/77", 1),
    ("http://free-bets.example.com/en/12?ref=x", 1), ("https://m.freebets.example/football/odds", 1), ("http://sport-betting.example.org/free-bets/", 1),
    ("http://cheap-pills.example.net/en/9", 1), ("https://pills-online.example/cheap/viagra.html", 1), ("https://blog.cheap-meds.example/buy-pills", 1),
    ("http://poker-win.example/jackpot/4", 1), ("https://slots-jackpot.example.net/win/", 1), ("http://xxx-videos.example/adult/1", 1),
    ("http://hot-singles.example.org/adult/chat", 1), ("https://warez-download.example/crack/keygen", 1), ("http://free-crack.example.net/serial", 1),
    ("https://win-big-prize.example/claim?utm_source=mail", 1), ("http://cheap-replica-watches.example/buy", 1), ("https://payday-loans-fast.example/en/apply", 1),
    ("https://www.university.example/en/research/5", 0), ("http://library.example.org/en/1234", 0), ("https://news.example.net/de/4321", 0),
    ("https://blog.gardening.example.com/en/55.html", 0), ("http://m.weather.example.org/fr/31/", 0), ("https://docs.software.example/en/guide#top", 0),
    ("https://www.museum.example.net/es/820", 0), ("http://history.example.org/en/1914?page=2", 0), ("https://recipes.example.com/fr/77", 0),
    ("http://www.townhall.example.org/de/9001.html", 0), ("https://forum.astronomy.example/en/6158/", 0), ("https://travel.example.net/en/5?utm_source=feed", 0),
    ("http://blog.teaching.example.org/en/8085", 0), ("https://m.music.example.com/en/2389?page=2&ref=x", 0), ("http://science.example.net/en/701#top", 0),
    ("https://www.hospital.example.org/en/health/3", 0), ("https://wiki.example.org/en/Main_Page", 0), ("http://sports.example.net/en/results/14", 0),
    ("https://www.bakery.example/en/bread/2", 0), ("http://council.example.org/minutes/44", 0), ("https://physics.example.com/fr/12", 0),
    ("http://parish.example.org/de/1", 0), ("https://chessclub.example/es/33", 0), ("https://children-books.example.com/en/8", 0),
]


def labelled_table(spark: SparkSession) -> DataFrame:
    """``LABELLED`` as a table (url, label)."""
    rows = F.array(*[F.struct(F.lit(url).alias("url"), F.lit(label).alias("label")) for url, label in LABELLED])
    return spark.range(0, 1, 1, 1).select(F.inline(rows))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host with A-Z lower-cased, from the first ``://`` up to ``/``, ``?``, ``#`` or the end, and the path after it up
    to ``?``, ``#`` or the end. Both are empty for a null or a URL without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda group: F.coalesce(F.regexp_extract(url, pattern, group), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (action, host, path) that fits, as its text and its action; null where none does. Of rules of one
    length the one with the longer host is taken."""
    text = action = F.lit(None).cast("string")
    for kind, own, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        text, action = F.when(fits, own + start).otherwise(text), F.when(fits, kind).otherwise(action)
    return text, action


def features(host: Column, path: Column) -> Column:
    """The distinct places of the n-grams in the weight array. Host and path have n-grams of their own; an end mark
    stands on both sides of the host."""

    def grams(prefix: str, text: Column) -> list[Column]:
        cut = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda at: F.pmod(F.xxhash64(F.lit(prefix), text.substr(at, F.lit(n))), F.lit(WEIGHTS - 1)).cast("int"))
        return [F.when(F.length(text) >= n, cut(n)).otherwise(F.array().cast("array<int>")) for n in GRAMS]

    return F.array_distinct(F.concat(*grams("host", F.concat(F.lit("^"), host, F.lit("$"))), *grams("path", path)))


def _chance(score: Column) -> Column:
    return 1 / (1 + F.exp(-score))


def trained(labelled: DataFrame, url: str = "url", label: str = "label") -> DataFrame:
    """One row with ``weights``, an array of ``WEIGHTS``. Examples are taken in the order of their URLs; those with a null
    URL or a label other than 0 and 1 teach nothing. Without examples all weights are 0."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.select(F.col(f"`{url}`").alias("url"), F.col(f"`{label}`").cast("double").alias("y")).where("url is not null and y in (0, 1)")
    rows = rows.orderBy(F.xxhash64("url"), "url", "y").limit(MAX_LABELLED).select("url", "y", features(host, path).alias("at"))
    share = F.when(F.size("at") > 0, 1 / F.sqrt(F.size("at"))).otherwise(F.lit(0.0))
    places = F.sequence(F.lit(0), F.lit(WEIGHTS - 1))
    dense = F.transform(places, lambda k: F.when(k == WEIGHTS - 1, F.lit(1.0)).when(F.array_contains("at", k), share).otherwise(F.lit(0.0)))
    whole = rows.select(F.struct("url", "y", dense.alias("x")).alias("e")).agg(F.array_sort(F.collect_list("e")).alias("examples"))
    dot = lambda w, x: F.aggregate(F.zip_with(w, x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    moved = lambda w, step, x: F.zip_with(w, x, lambda a, b: a * (1 - RATE * DECAY) + step * b)
    # The step is worked out once and not for each weight: it is the single element of an array.
    once = lambda step, v, x: F.get(F.transform(F.array(step), lambda s: moved(v, s, x)), F.lit(0))
    epoch = lambda w: F.aggregate(F.col("examples"), w, lambda v, e: once(RATE * (e.y - _chance(dot(v, e.x))), v, e.x))
    return whole.select(F.aggregate(F.sequence(F.lit(1), F.lit(EPOCHS)), F.array_repeat(F.lit(0.0), WEIGHTS), lambda w, _: epoch(w)).alias("weights"))


def judged(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", id: str = "page_id", threshold: float = 0.5) -> DataFrame:
    """Each row's ``id``, ``host``, ``path``, ``rule``, ``score`` (the chance to be blocked) and ``verdict`` (allow or block:
    the rule's, else by the score). A URL without host and path has the score of the intercept. Rows that repeat are
    judged alike."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(f"`{id}`").alias("id"), F.col(f"`{url}`").cast("string").alias("url")).select("id", host.alias("host"), path.alias("path"))
    text, action = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("id", "host", "path", text.alias("rule"), action.alias("action"), features(F.col("host"), F.col("path")).alias("at"))
    weights = trained(labelled).scalar()
    rows = rows.withColumn("w", weights)
    total = F.aggregate("at", F.lit(0.0), lambda s, k: s + F.get("w", k))
    score = _chance(F.get("w", F.lit(WEIGHTS - 1)) + F.when(F.size("at") > 0, total / F.sqrt(F.size("at"))).otherwise(F.lit(0.0)))
    rows = rows.withColumn("score", score)
    return rows.select("id", "host", "path", "rule", "score", F.coalesce("action", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"))
