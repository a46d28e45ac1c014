"""Language-model scores: a self-attention model over subword ids, beside word counts of the whole training part.

A text is the sequence of its words' subword ids in a public vocabulary, each word with a space before it, and an end. The
attention model gives every id, and whether its word ends with it, a probability after the ids before it: a word's
probability is the product of those of its ids. For the ids after a word's first there is a second opinion, the word's share
in the counts of words with this first id, one more standing for all unseen. The two are mixed, by how well each foretold the
last ``PAST`` words of the text, and the text's score is the sum over its words and its end.

The attention model begins with a sample of training texts. From there each block fits it further to all of its training
texts, and the mean of the blocks' models, by their symbols, is the model: so every training text counts, at any size. How often
a symbol occurs, from which its logits start, is counted over the whole training part.

Texts are hashed to blocks of about ``PART`` bytes. A block sends each of its words once, with its count in
training texts, to the shard of the word's hash; the shard adds up and answers with the counts over the whole corpus.
No table of all words is ever in one place, and a frequent word is one entry a block.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thetaloom.llm import attention
from thetaloom.llm.attention import END, IDS, SYMBOLS
from thetaloom.llm.ragged import LOWER, U64, WHITE, Memo, flat, gathered, slices, span_hashes, spans
from thetaloom.llm.scratch import written
from thetaloom.llm.suffix_dedup import _by, packed, unpacked

PART = 16_000_000
SAMPLE = 3_000
"""Training texts, about, that the attention model begins with: those whose hash falls in as small a share of all hashes."""
SAMPLE_WORDS = 2_000
"""Words in one stretch of a longer sample text; stretches are taken at places spread over the whole text."""
PIECES = 16
"""Parts in which blocks send their models to be averaged and their counts of symbols to be added up, each to a shard of its own."""
PAST = 32
"""Words before a word by which the two opinions on it are weighed."""
STRETCH = 50_000
"""Words, about, of the texts whose ids are in memory at once."""


class Subwords:
    """Subword ids of words; kept from block to block."""

    def __init__(self, path: str, pattern: str):
        import base64

        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        if max(ranks.values()) >= IDS - 1:
            raise ValueError(f"subword ids must be below {IDS - 1}")
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.memo, self.sizes, self.ids = Memo(), np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def of(self, keys: np.ndarray, words) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each distinct word has, and the ids of all, word by word; ``words(i)`` are the words at ``i``."""

        def make(new: np.ndarray, fresh: bool) -> None:
            each = [self.encode(" " + word) for word in words(new)]
            sizes, ids = np.array([len(x) for x in each], np.int64), np.fromiter(chain.from_iterable(each), np.uint16)
            self.sizes, self.ids = (sizes, ids) if fresh else (np.r_[self.sizes, sizes], np.r_[self.ids, ids])
            self.starts = np.cumsum(self.sizes) - self.sizes

        places = self.memo.places(keys, make)  # may add to the ids
        sizes = self.sizes[places]
        return sizes, self.ids[gathered(self.starts[places], sizes)] if len(keys) else self.ids[:0]


@lru_cache(maxsize=2)
def subwords(vocabulary: tuple[str, str]) -> Subwords:
    return Subwords(*vocabulary)


class Block:
    """The words of many texts: each distinct word's hash (sorted) and symbols, and of each text which words it has."""

    def __init__(self, texts: pa.Array, vocabulary: tuple[str, str]):
        data, offsets = flat(texts)
        known = subwords(vocabulary)
        self.counts = np.zeros(len(offsets) - 1, np.int64)
        parts, examples = [np.zeros(0, U64)], [(np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.uint16))]
        for low, high in slices(offsets):
            part = LOWER[data[offsets[low] : offsets[high]]]
            starts, ends, firsts = spans(~WHITE[part], offsets[low : high + 1] - offsets[low])
            hashes = span_hashes(part, starts, ends)
            self.counts[low:high] = np.diff(firsts)
            keys, example = np.unique(hashes, return_index=True)
            raw = part.tobytes()
            words = lambda i, raw=raw, a=starts[example], b=ends[example]: [raw[x:y].decode("utf-8", "replace") for x, y in zip(a[i].tolist(), b[i].tolist(), strict=True)]
            parts.append(hashes)
            examples.append((keys, *known.of(keys, words)))
        self.words, self.which = np.unique(np.concatenate(parts), return_inverse=True)
        keys, sizes, ids = (np.concatenate(x) for x in zip(*examples, strict=True))
        _, example = np.unique(keys, return_index=True)
        self.sizes, self.starts = sizes[example], (np.cumsum(sizes) - sizes)[example]
        self.firsts = ids[self.starts]
        self.symbols = 2 * ids.astype(np.int32)
        self.symbols[np.cumsum(sizes) - 1] += 1

    def stretches(self):
        """Ranges of texts of about ``STRETCH`` words, with the place of their first word and the end of their last."""
        offsets = np.r_[0, np.cumsum(self.counts)]
        for low, high in slices(offsets, STRETCH):
            yield low, high, offsets[low], offsets[high]

    def sequences(self, low: int, high: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of a range of texts, each with its end, and their numbers."""
        which = self.which[first:last]
        sizes = self.sizes[which]
        sums = np.r_[0, np.cumsum(sizes)]
        words = np.r_[0, np.cumsum(self.counts[low:high])]
        counts = np.diff(sums[words]) + 1
        symbols = np.full(int(counts.sum()), END, np.int32)
        inner = np.ones(len(symbols), bool)
        inner[np.cumsum(counts) - 1] = False
        symbols[inner] = self.symbols[gathered(self.starts[which], sizes)]
        return symbols, counts

    def every(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of the ``chosen`` texts, each with its end, and their numbers."""
        parts = [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
        for low, high, first, last in self.stretches():
            symbols, counts = self.sequences(low, high, first, last)
            mine = chosen[low:high]
            parts.append((symbols[np.repeat(mine, counts)], counts[mine]))
        return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])

    def shards(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct words in the order of their shards, and those shards."""
        shard = (self.words % U64(count)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        return order, shard[order]


def _block_counts(vocabulary: tuple[str, str], parts: int, begun: bytes):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("text", "ascending")])
        block = Block(table.column("text"), vocabulary)
        learns = ~table.column("held_out").to_numpy()
        counts = np.bincount(block.which[np.repeat(learns, block.counts)], minlength=len(block.words))
        order, shard = block.shards(parts)
        own = table.column("block")[0].as_py()
        out = [(target, own, packed(block.words[order[part]]), packed(counts[order[part]].astype(np.int64)), packed(block.firsts[order[part]]), None) for target, part in _by(shard)]
        symbols, sizes = block.every(learns)
        del block
        if len(symbols):
            fitted = attention.refined(attention.unpacked(begun, None), symbols, sizes)
            model, seen = np.frombuffer(attention.packed(fitted), np.float32), attention.occurring(symbols, sizes).ravel()
            out += [(-1 - piece, own, packed(part), packed(told), None, len(symbols)) for piece, (part, told) in enumerate(zip(np.array_split(model, PIECES), np.array_split(seen, PIECES), strict=True))]
        kinds = [pa.int64()] * 2 + [pa.binary()] * 3 + [pa.int64()]
        return pa.table([pa.array(list(x), t) for x, t in zip(list(zip(*out, strict=True)) or [()] * 6, kinds, strict=True)], names=["shard", "block", "words", "counts", "firsts", "size"])

    return run


ANSWERS = "block bigint, shard bigint, counts binary, model binary, firsts array<bigint>, types array<bigint>"
ANSWERED = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("counts", pa.binary()), ("model", pa.binary()), ("firsts", pa.list_(pa.int64())), ("types", pa.list_(pa.int64()))])


def _answers(table: pa.Table) -> pa.Table:
    """A shard's counts over all blocks to each block, in the order in which it asked; in a row without block how many
    distinct training words begin with an id. A shard below 0 has a part of each block's model and of its counts of symbols, and gives the
    models' mean and the counts' sum."""
    shard = table.column("shard")[0].as_py()
    if shard < 0:
        table = table.sort_by("block")
        sizes = table.column("size").to_numpy()
        mean = sum(unpacked(x.as_py(), np.float32).astype(np.float64) * n for x, n in zip(table.column("words"), sizes, strict=True)) / sizes.sum()
        seen = sum(unpacked(x.as_py(), np.int64) for x in table.column("counts"))
        row = {"block": None, "shard": shard, "counts": packed(seen), "model": packed(mean.astype(np.float32)), "firsts": None, "types": None}
        return pa.Table.from_pylist([row], ANSWERED)
    words = [unpacked(x.as_py(), U64) for x in table.column("words")]
    keys, which = np.unique(np.concatenate(words), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, which, np.concatenate([unpacked(x.as_py(), np.int64) for x in table.column("counts")]))
    first = np.zeros(len(keys), np.int64)
    first[which] = np.concatenate([unpacked(x.as_py(), np.uint16) for x in table.column("firsts")])
    ends = np.cumsum([len(x) for x in words])
    answers = [packed(total[which[b - len(x) : b]]) for x, b in zip(words, ends, strict=True)]
    none = [None] * len(answers)
    firsts, types = np.unique(first[total > 0], return_counts=True)
    return pa.table({
        "block": pa.array([*table.column("block").to_pylist(), None], pa.int64()), "shard": pa.array([shard] * (len(answers) + 1), pa.int64()),
        "counts": pa.array([*answers, None], pa.binary()), "model": pa.array([*none, None], pa.binary()),
        "firsts": pa.array([*none, firsts], pa.list_(pa.int64())), "types": pa.array([*none, types], pa.list_(pa.int64())),
    })


def _fitted(vocabulary: tuple[str, str]):
    """The sample in one task, which its bound makes small, to the packed attention model."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("text", "ascending")])
        texts = []
        for text in table.column("text").to_pylist():
            words = (text or "").split()
            piece = SAMPLE_WORDS // 8
            places = np.linspace(0, len(words) - piece, 8).astype(int) if len(words) > SAMPLE_WORDS else [0]
            texts += [" ".join(words[at : at + piece] if len(places) > 1 else words) for at in places]
        symbols, counts = Block(pa.array(texts, pa.string()), vocabulary).every(np.ones(len(texts), bool))
        return pa.table({"model": pa.array([attention.packed(attention.trained(symbols, counts))], pa.binary())})

    return run


SCORES = "id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _mixed(one: np.ndarray, other: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The log-probabilities of two opinions on the words of texts with ``counts`` words as one, each weighed by what it gave
    the ``PAST`` words before in the text; alike at first."""
    better = np.r_[0, np.cumsum(other - one)]
    at = np.arange(len(one))
    since = np.maximum(np.repeat(np.cumsum(counts) - counts, counts), at - PAST)
    weight = better[at] - better[since]
    return np.logaddexp(one - np.logaddexp(0, weight), other - np.logaddexp(0, -weight))


def _block_scores(vocabulary: tuple[str, str], parts: int, learned: bytes, seen: bytes, train_texts: int, types: np.ndarray):
    """``types`` are the distinct words of training texts by their first id."""
    occurring = np.frombuffer(seen, np.int64).reshape(2, SYMBOLS)
    tokens = occurring[1].reshape(IDS, 2).sum(axis=1)
    total, distinct = int(tokens.sum()), int(types.sum()) + int(train_texts > 0)

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(docs.column("text"), vocabulary)
        order, shard = block.shards(parts)
        told = {x: unpacked(y, np.int64) for x, y in zip(answers.column("shard").to_pylist(), answers.column("counts").to_pylist(), strict=True)}
        count = np.zeros(len(block.words), np.int64)
        for target, part in _by(shard):
            count[order[part]] = told[target]
        known, base = count > 0, np.log10((count + 1) / (total + 1 * (distinct + 1)))
        end = np.log10((train_texts + 1) / (total + 1 * (distinct + 1)))
        # A word among those of its first id, where one more stands for the unseen.
        within = np.log((count + 1) / (tokens + types + 1)[block.firsts])
        model = attention.unpacked(learned, occurring)
        begun = attention.started(occurring)
        n_known, base_score, score = np.zeros(len(docs), np.int64), np.zeros(len(docs)), np.zeros(len(docs))
        for low, high, first, last in block.stretches():
            which, words = block.which[first:last], block.counts[low:high]
            owner = np.repeat(np.arange(high - low), words)
            summed = lambda x, owner=owner, size=high - low: np.bincount(owner, weights=x, minlength=size)
            n_known[low:high] = summed(known[which]) + int(train_texts > 0)
            base_score[low:high] = summed(base[which]) + end
            symbols, counts = block.sequences(low, high, first, last)
            ids, ends = attention.log_shares(model, begun, symbols, counts)
            closing = np.cumsum(counts) - 1
            inner = np.ones(len(symbols), bool)
            inner[closing] = False
            opening = np.cumsum(block.sizes[which]) - block.sizes[which]
            every = (ids + ends)[inner]
            opened = ids[inner][opening]
            rest = np.add.reduceat(every, opening) - opened if len(opening) else opened
            score[low:high] = (summed(opened + _mixed(within[which], rest, words)) + (ids + ends)[closing]) / np.log(10)
        return pa.table({"id": docs.column("id"), "held_out": docs.column("held_out"), "n_tokens": block.counts + 1, "n_known": n_known, "base_score": base_score, "score": score})

    return run


def scored(docs: DataFrame, held_out: Column, vocabulary: tuple[str, str], id: str = "doc_id", text: str = "text", part: int = PART, sample: int = SAMPLE) -> DataFrame:
    """Each row's ``id``, ``held_out``, ``n_tokens`` (words and the end), ``n_known`` (those that training texts have),
    ``train_tokens``, ``base_score`` (log10 by word counts with one added) and ``score`` (log10 by the model).

    ``vocabulary``: the path of a rank file and the pattern that splits text for it. ``held_out`` is a condition on columns
    of ``docs``, null counting as false. A null or empty text is an end alone. Rows that repeat count each."""
    out = F.coalesce(held_out, F.lit(False))
    source = docs.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text"), out.alias("held_out"))
    size, train_texts = source.agg(F.sum(F.octet_length("text")), F.count_if(~F.col("held_out"))).first()
    parts = int(-(-(size or 0) // part)) or 1
    blocked = source.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(parts)))
    # By a share of the hashes, each task finds its part of the sample by itself. Rows that repeat have one hash and count once.
    order = F.xxhash64("id", "text")
    share = F.pmod(order, F.lit(1_000_000_007)) < F.lit(1_000_000_007 * sample / max(train_texts, sample, 1))
    chosen = source.where("not held_out").where(share).select(order.alias("order"), "text").dropDuplicates(["order"])
    fitted = chosen.groupBy(F.lit(0).alias("one")).applyInArrow(_fitted(vocabulary), "model binary").first()
    begun = bytes(fitted.model) if fitted else attention.packed(attention.trained(np.zeros(0, np.int64), np.zeros(0, np.int64)))
    asked = blocked.groupBy("block").applyInArrow(_block_counts(vocabulary, parts, begun), "shard bigint, block bigint, words binary, counts binary, firsts binary, size bigint")
    answers = written(asked.groupBy("shard").applyInArrow(_answers, ANSWERS), "word_counts")
    types = np.zeros(IDS, np.int64)
    for row in answers.where("block is null").select(F.inline(F.arrays_zip("firsts", "types"))).groupBy("firsts").agg(F.sum("types").alias("types")).collect():
        types[row.firsts] = row.types
    pieces = sorted((-row.shard, unpacked(row.model, np.float32).tobytes(), unpacked(row.counts, np.int64).tobytes()) for row in answers.where("block is null and shard < 0").select("shard", "model", "counts").collect())
    model = b"".join(piece for _, piece, _ in pieces) or begun
    seen = b"".join(piece for _, _, piece in pieces) or bytes(16 * SYMBOLS)
    replies = answers.where("block is not null").select("block", "shard", "counts")
    scores = blocked.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_block_scores(vocabulary, parts, model, seen, train_texts, types), SCORES)
    return scores.withColumn("train_tokens", F.lit(int(np.frombuffer(seen, np.int64)[SYMBOLS:].sum())).cast("bigint"))
