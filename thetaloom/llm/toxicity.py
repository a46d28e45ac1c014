"""Toxic passages as maximum-scoring segments of token log-odds, calibrated by extreme values.

Learning. Over all labelled texts of the training part, each word is counted in toxic and clean texts. The share of
toxic texts of a word has a Dirichlet prior around the share of its first ``STEM`` bytes, and that one a prior around
the share of all texts; so a rare word scores near its stem, and a rare stem near nothing. A word's score is the
log-odds of its share against the share of all texts. The model keeps the words and stems that score ``LEAST`` and more
(and the words that must not take their stem's score), at most ``WORDS`` and ``STEMS`` of them, the best first.

Scoring. Each token outside the model costs ``DRIFT``, so scores fall on average and every passage that rises is a
segment. One scan finds all maximal segments. The number of segments of score S or more that n tokens of clean text hold by chance
is K n exp(-lambda S) (extreme values of sums with negative drift); lambda follows from the scores and frequencies in clean
text, K from the segments that clean training texts have. A text's evidence is the sum of -log of this number over its
significant segments; a logistic curve on evidence, fitted on counts over all training texts, gives the score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thetaloom.llm.decontaminate import words_of
from thetaloom.llm.ragged import LOWER, U64, flat, slices, span_hashes
from thetaloom.llm.scratch import written

STEM, PRIOR, LEAST, DRIFT = 4, 8.0, 1.0, 0.2
WORDS, STEMS = 200_000, 20_000
"""Bounds of the model, which is sent to the tasks: about 4 MB."""
_BITS = 1 << 20


def _tokens(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row, word hashes and stem hashes of each text."""
    data, offsets = flat(texts)
    for low, high in slices(offsets):
        part = data[offsets[low] : offsets[high]]
        starts, ends, firsts, hashes = words_of(part, offsets[low : high + 1] - offsets[low])
        stems = span_hashes(LOWER[part], starts, np.minimum(starts + STEM, ends))
        for row in range(high - low):
            a, b = firsts[row], firsts[row + 1]
            yield low + row, hashes[a:b], stems[a:b]


def _summed(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    edges = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return [key[edges], *(np.add.reduceat(x[order], edges) if len(key) else x for x in values)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (text, toxic) to counts of words and stems: texts of either label and tokens in clean ones. Row
    kind 2 counts the texts and tokens themselves."""
    names = ["kind", "key", "stem", "toxic", "clean", "tokens"]
    for batch in batches:
        label = batch.column("toxic").to_numpy(zero_copy_only=False)
        words: list[tuple] = []
        stem_rows: list[tuple] = []
        total = 0
        for row, hashes, stem in _tokens(batch.column("text")):
            one, at, count = np.unique(hashes, return_index=True, return_counts=True)
            bad = int(label[row])
            words.append((one, stem[at], np.full(len(one), bad), count * (1 - bad)))
            two, times = np.unique(stem, return_counts=True)
            stem_rows.append((two, np.full(len(two), bad), times * (1 - bad)))
            total += len(hashes) * (1 - bad)
        if not words:
            continue
        key, stem, bad, clean_tokens = (np.concatenate(x) for x in zip(*words, strict=True))
        # A word has one stem, so any of its rows tells it.
        where = np.unique(key, return_index=True)[1]
        key_, bad_, good_, tokens_ = _summed(key, bad, 1 - bad, clean_tokens)
        two, bad2, times = (np.concatenate(x) for x in zip(*stem_rows, strict=True))
        stem_key, stem_bad, stem_good, stem_tokens = _summed(two, bad2, 1 - bad2, times)
        count = int(label.sum())
        columns = [
            np.r_[np.zeros(len(key_), np.int32), np.ones(len(stem_key), np.int32), np.int32(2)],
            np.r_[key_, stem_key, U64(0)].view(np.int64), np.r_[stem[where], stem_key, U64(0)].view(np.int64),
            np.r_[bad_, stem_bad, count], np.r_[good_, stem_good, len(label) - count], np.r_[tokens_, stem_tokens, total],
        ]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32) if i == 0 else x.astype(np.int64)) for i, x in enumerate(columns)], names=names)


class Lexicon:
    """The model in a task: scores by word, and by stem for words that it doesn't list."""

    def __init__(self, words: list[tuple[int, float]], stems: list[tuple[int, float]]):
        self.tables = []
        for entries in (words, stems):
            keys = np.array([x for x, _ in entries], np.int64).view(U64)
            order = np.argsort(keys)
            maybe = np.zeros(_BITS, bool)
            maybe[(keys & U64(_BITS - 1)).astype(np.int64)] = True
            self.tables.append((keys[order], np.array([s for _, s in entries], float)[order], maybe))

    def _known(self, table: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, scores, maybe = self.tables[table]
        at = np.flatnonzero(maybe[(keys & U64(_BITS - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(own, keys[at]), len(own) - 1)
        sure = own[place] == keys[at] if len(own) else np.zeros(0, bool)
        return at[sure], scores[place[sure]]

    def hits(self, words: np.ndarray, stems: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the tokens in the model whose score is positive."""
        score = np.zeros(len(words))
        for table, keys in ((1, stems), (0, words)):  # a word's own score is set over its stem's
            at, value = self._known(table, keys)
            score[at] = value
        at = np.flatnonzero(score > 0)
        return at, score[at]


def maximal_segments(places: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence that falls by ``drift`` except at ``places``, where it
    rises by ``scores``. Each rise looks back for the nearest earlier segment that starts lower; where that one also ended
    lower, all between become one segment, which looks back again."""
    found: list[tuple[int, int, float, float]] = []
    total, last = 0.0, -1
    for place, score in zip(places, scores, strict=True):
        low = total - drift * (place - last - 1)
        total, last = low + score, place
        start, high = place, total
        while True:
            at = len(found) - 1
            while at >= 0 and found[at][2] >= low:
                at -= 1
            if at < 0 or found[at][3] >= high:
                break
            start, low = found[at][0], found[at][2]
            del found[at:]
        found.append((start, place + 1, low, high))
    return [(a, b, high - low) for a, b, low, high in found]


SEGMENTS = "struct<n_tokens: bigint, segments: array<struct<start: bigint, end: bigint, score: double>>>"


def segments(text: Column, lexicon: tuple[list, list]) -> Column:
    """A struct of the number of tokens and the maximal segments (tokens, end exclusive) of a text. Null: no tokens."""
    words, stems = lexicon
    held: list[Lexicon] = []

    @F.arrow_udf(SEGMENTS)
    def scan(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(Lexicon(words, stems))
        out = []
        for _, hashes, stem in _tokens(texts):
            at, score = held[0].hits(hashes, stem)
            found = maximal_segments(at.tolist(), (score - DRIFT).tolist(), DRIFT) if len(at) else ()
            out.append({"n_tokens": len(hashes), "segments": [{"start": a, "end": b, "score": s} for a, b, s in found]})
        kind = pa.struct([("n_tokens", pa.int64()), ("segments", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))])
        return pa.array(out, kind)

    return scan(text)


def _best(rows: DataFrame, most: int) -> DataFrame:
    """The rows of the best scores, at most ``most``: those above a cut that counts per hundredth of a score give, so
    nothing is sorted in one place. Scores are bounded, and so is the number of counts."""
    step = F.floor(F.col("score") * 100)
    counts = sorted(((x.step, x.n) for x in rows.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, cut = 0, None
    for at, n in counts:
        total += n
        if total > most:
            break
        cut = at
    return rows.where(step >= cut) if cut is not None else rows.limit(0)


def learned(labelled: DataFrame) -> dict:
    """The model from ``labelled`` (text, toxic: 0 or 1): word and stem scores, and the frequencies in clean text that
    lambda rests on. The driver gets the bounded model only."""
    counts = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(_counted, "kind int, key bigint, stem bigint, toxic bigint, clean bigint, tokens bigint")
    counts = written(counts.groupBy("kind", "key").agg(F.first("stem").alias("stem"), *[F.sum(x).alias(x) for x in ("toxic", "clean", "tokens")]), "counts")
    whole = counts.where("kind = 2").select("toxic", "clean", "tokens").first()
    toxic, clean, tokens = (whole.toxic, whole.clean, whole.tokens) if whole else (0, 0, 0)
    if not toxic or not clean:
        return {"words": [], "stems": [], "rate": (toxic + 0.5) / (toxic + clean + 1), "clean": [], "tokens": tokens}
    rate = toxic / (toxic + clean)
    prior = math.log(rate / (1 - rate))
    share = lambda up, all_, around: (up + PRIOR * around) / (all_ + PRIOR)
    odds = lambda q: F.log(q / (1 - q)) - F.lit(prior)
    texts = F.col("toxic") + F.col("clean")
    stems = counts.where("kind = 1").select(F.col("key").alias("stem"), share(F.col("toxic"), texts, F.lit(rate)).alias("stem_share"))
    words = counts.where("kind = 0").join(stems, "stem").withColumn("score", odds(share(F.col("toxic"), texts, F.col("stem_share"))))
    told = (F.col("score") >= LEAST) | (odds(F.col("stem_share")) >= LEAST)
    best = _best(words.where(told), WORDS).select("key", "score", "tokens").orderBy("key").collect()
    best_stems = _best(stems.withColumn("score", odds(F.col("stem_share"))).where(F.col("score") >= LEAST), STEMS).select("stem", "score").orderBy("stem").collect()
    return {
        "words": [(x.key, x.score if x.score >= LEAST else 0.0) for x in best],
        "stems": [(x.stem, x.score) for x in best_stems],
        "rate": rate, "clean": [(x.score - DRIFT, x.tokens) for x in best if x.score >= LEAST], "tokens": tokens,
    }


def extreme_rate(clean: list[tuple[float, int]], tokens: int) -> float:
    """Lambda: the positive root of the mean of exp(lambda x) = 1 over the tokens of clean text, with x their scores. A
    listed word that clean text lacks counts half a token."""
    scores = np.array([s for s, _ in clean] or [1.0])
    counts = np.array([n + 0.5 for _, n in clean] or [0.5])
    total = tokens + counts.sum()
    rest = (total - counts.sum()) / total
    low, high = 0.0, 60.0
    # The mean minus one is negative just above 0 (scores fall on average) and grows without bound.
    for _ in range(200):
        middle = (low + high) / 2
        value = rest * math.exp(-middle * DRIFT) + float((counts / total * np.exp(np.minimum(middle * scores, 700))).sum())
        low, high = (middle, high) if value < 1 else (low, middle)
    return max(low, 1e-3)


def logistic(points: list[tuple[float, int, int]], rate: float) -> tuple[float, float]:
    """Intercept and slope of a logistic curve over (evidence, toxic texts, clean texts), with a weak prior around an
    intercept of ``rate`` and a slope of 1."""
    start = np.array([math.log(rate / (1 - rate)), 1.0])
    x, up, down = (np.array([p[i] for p in points], float) for i in range(3))
    rows = np.stack([np.ones(len(x)), x], axis=1)

    def loss(at: np.ndarray) -> float:
        z = rows @ at
        return float((up * np.logaddexp(0, -z) + down * np.logaddexp(0, z)).sum() + 0.05 * ((at - start) ** 2).sum())

    at = start
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(rows @ at, -500, 500)))
        gradient = rows.T @ (up - (up + down) * p) - 0.1 * (at - start)
        hessian = (rows * ((up + down) * p * (1 - p))[:, None]).T @ rows + 0.1 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        while loss(at + step) > loss(at) and np.abs(step).max() > 1e-9:
            step /= 2
        at = at + step
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0]), float(max(at[1], 0.0))


MOST_EVIDENCE = 60.0


def scored(docs: DataFrame, labels: DataFrame, held_out: Column, id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> DataFrame:
    """Each row's ``id``, ``held_out``, ``n_tokens``, ``segments``, ``evidence`` and ``score`` (0 to 1). Only labels of rows
    that aren't ``held_out`` (a condition on ``id``, null counting as false) are read.

    A null or empty text has no evidence and the score of such texts. Rows with a null id are scored and teach nothing;
    labels that are null or neither 0 nor 1 teach nothing. Without labels of both kinds the score is a constant."""
    out = F.coalesce(held_out, F.lit(False))
    source = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"), out.alias("held_out"))
    truth = labels.select(F.col(f"`{id}`").alias("id"), F.col(f"`{toxic}`").alias("toxic")).where("toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    train = source.where("not held_out and id is not null")
    model = learned(train.join(truth.hint("shuffle_hash"), "id").select("text", "toxic"))
    found = source.select("id", "held_out", segments(F.col("text"), (model["words"], model["stems"])).alias("s")).select("id", "held_out", "s.*")
    found = written(found, "segments")
    rate = extreme_rate(model["clean"], model["tokens"])
    seen = found.where("not held_out and id is not null").join(truth, "id")
    chance = seen.where("toxic = 0").select("n_tokens", F.aggregate("segments", F.lit(0.0), lambda n, x: n + F.when(x.score >= LEAST, 1.0).otherwise(0.0)).alias("n")).agg(F.sum("n").alias("n"), F.sum("n_tokens").alias("tokens")).first()
    factor = math.log(((chance.n or 0) + 0.5) / ((chance.tokens or 0) + 1)) + rate * LEAST
    bound = F.lit(factor) + F.log(F.greatest(F.col("n_tokens"), F.lit(1)))
    evidence = F.least(F.lit(MOST_EVIDENCE), F.aggregate("segments", F.lit(0.0), lambda n, x: n + F.greatest(F.lit(0.0), F.lit(rate) * x.score - bound)))
    bins = seen.select(F.round(evidence * 4).alias("bin"), "toxic").groupBy("bin").agg(F.sum("toxic").alias("up"), F.sum(1 - F.col("toxic")).alias("down")).collect()
    a, b = logistic(sorted((x.bin / 4, int(x.up), int(x.down)) for x in bins), model["rate"])
    judged = found.withColumn("evidence", evidence)
    return judged.select("id", "held_out", "n_tokens", "segments", "evidence", (1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("evidence"))))).alias("score"))
