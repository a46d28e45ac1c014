"""Quality rules on repetition and on tokeniser fertility.

Fertility is how a public subword vocabulary takes a text: characters per token, the share of tokens that fall back to
single bytes, and the entropy of the tokens. Each script has a band for each measure; a text outside is rejected. Bands
are parameters, wide enough for any running text of the script, and hold for texts of ``MEASURED_FROM`` tokens and more,
since the measures of a few tokens say little. Fixed bands by script only catch what is no running text; ``judged`` takes
further bands by language from the table itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thetaloom.llm.names import free_name
from thetaloom.llm.ragged import WHITE, Memo, flat, gathered, slices, span_hashes, spans, windows_of
from thetaloom.llm.scratch import written
from thetaloom.llm.workers import each

MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 50, 50, 3
SYMBOLS = "#*$%&|<>"

#: By script: (least, most) characters per token, most byte-fallback share, least token entropy in bits.
BANDS: dict[str, tuple[float, float, float, float]] = {
    "latin": (1.2, 9.0, 0.10, 3.0),
    "cyrillic": (1.0, 9.0, 0.15, 3.0),
    "greek": (0.7, 9.0, 0.35, 3.0),
    "arabic": (0.7, 9.0, 0.35, 3.0),
    "han": (0.3, 3.0, 0.80, 3.0),
    "other": (0.25, 9.0, 0.95, 3.0),
    "none": (1.0, 9.0, 0.50, 3.0),
}
MEASURED_FROM = 50
"""Tokens from which the bands are applied."""

#: How many robust deviations from a language's median characters per token may lie, and entropy below its line.
CHARS_MARGIN, ENTROPY_MARGIN = 6.0, 4.0
LEAST_CHARS, LEAST_ENTROPY = 0.05, 0.1
"""The least such deviations, so that many copies of one text don't make a band of one point."""

#: The Unicode blocks that stand for a script: first and last code point.
SCRIPTS: dict[str, list[tuple[int, int]]] = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F)],
    "greek": [(0x370, 0x3FF)],
    "cyrillic": [(0x400, 0x52F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "han": [(0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
OTHER_LETTERS = [(0x530, 0x1FFF), (0x2C00, 0x2DFF), (0xA000, 0xD7FF), (0x10000, 0x1BFFF)]
"""Blocks of letters of further scripts."""

_symbol = np.zeros(256, bool)
_symbol[list(SYMBOLS.encode())] = True

RESULT = (
    "struct<n_words: bigint, word_chars: bigint, n_symbols: bigint, n_dup_lines: bigint, n_repeat_words: bigint, "
    "base_failed: boolean, script: string, n_tokens: bigint, chars_per_token: double, byte_share: double, "
    "token_entropy: double, kept: boolean>"
)


class Pieces:
    """A piece vocabulary; ids of words are kept from batch to batch."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.single = np.fromiter((self.model.is_byte(i) for i in range(size)), bool, size)
        self.memo = Memo()
        self._clear()

    def _clear(self) -> None:
        self.ids, self.sizes, self.begin = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def places(self, keys: np.ndarray, words) -> np.ndarray:
        """Where ``begin`` and ``sizes`` tell the ids of each distinct word; ``words(i)`` are the words at ``i``."""

        def make(new: np.ndarray, fresh: bool) -> None:
            if fresh:
                self._clear()
            rows = self.model.encode(words(new)) if len(new) else []
            sizes = np.fromiter(map(len, rows), np.int64, len(rows))
            self.begin = np.r_[self.begin, len(self.ids) + np.cumsum(sizes) - sizes]
            self.sizes = np.r_[self.sizes, sizes]
            self.ids = np.r_[self.ids, np.fromiter(chain.from_iterable(rows), np.int32, int(sizes.sum()))]

        return self.memo.places(keys, make)


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def script_of(text: str) -> str:
    """The script of most letters; ties go to the first in ``SCRIPTS``; without letters ``none``."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = {name: sum(int(np.count_nonzero((points >= a) & (points <= b))) for a, b in blocks) for name, blocks in SCRIPTS.items()}
    counts["other"] = sum(int(np.count_nonzero((points >= a) & (points <= b))) for a, b in OTHER_LETTERS) - counts["arabic"]
    best = max(counts, key=counts.get)
    return best if counts[best] > 0 else "none"


def duplicate_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def repeated_words(hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more."""
    found = windows_of(hashes, window)
    if len(found) < 2:
        return 0
    _, place, count = np.unique(found, return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[place] > 1)
    inside = np.zeros(len(hashes), bool)
    for at in range(window):
        inside[again + at] = True
    return int(inside.sum())


def entropy(ids: np.ndarray) -> float:
    counts = np.unique(ids, return_counts=True)[1] / len(ids)
    return float(max(0.0, -(counts * np.log2(counts)).sum()))


def measured(texts: pa.Array, path: str, bands: dict = BANDS) -> pa.StructArray:
    """The rules and measures of each text of a batch."""
    pieces = _pieces(path)
    data, offsets = flat(texts)
    out: dict[str, list] = {name: [] for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "script", "n_tokens", "chars_per_token", "byte_share", "token_entropy", "kept")}
    for low, high in slices(offsets):
        part, places = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        strings = texts.slice(low, high - low).to_pylist()
        word = ~WHITE[part]
        starts, ends, firsts = spans(word, places)
        hashes = span_hashes(part, starts, ends)
        lead = word & ((part & 0xC0) != 0x80)
        chars, symbols = np.r_[0, np.cumsum(lead)][places], np.r_[0, np.cumsum(_symbol[part])][places]
        # Each distinct word goes to the vocabulary once.
        keys, example, which = np.unique(hashes, return_index=True, return_inverse=True)
        raw = part.tobytes()
        words = lambda i: [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[example[i]].tolist(), ends[example[i]].tolist(), strict=True)]
        place = pieces.places(keys, words)[which] if len(keys) else which
        for row in range(high - low):
            a, b = firsts[row], firsts[row + 1]
            mine = place[a:b]
            tokens = pieces.ids[gathered(pieces.begin[mine], pieces.sizes[mine])]
            count, letters = b - a, int(chars[row + 1] - chars[row])
            repeated = repeated_words(hashes[a:b])
            text = strings[row] or ""
            script = script_of(text)
            failed = bool(count < MIN_WORDS or 100 * repeated > MAX_REPEATED_PERCENT * count)
            per, share, spread = (letters / len(tokens), float(pieces.single[tokens].mean()), entropy(tokens)) if len(tokens) else (None, None, None)
            least, most, fallback, narrow = bands[script]
            fits = len(tokens) < MEASURED_FROM or (least <= per <= most and share <= fallback and spread >= narrow)
            for name, value in zip(out, (int(count), letters, int(symbols[row + 1] - symbols[row]), duplicate_lines(text), repeated, failed, script, len(tokens), per, share, spread, not failed and fits), strict=True):
                out[name].append(value)
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.string(), pa.int64()] + [pa.float64()] * 3 + [pa.bool_()]
    return pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(out.values(), kinds, strict=True)], names=list(out))


def quality(text: Column, path: str, bands: dict = BANDS) -> Column:
    """A struct of rules, measures and the verdict ``kept`` for a text column; ``path``: a piece vocabulary with byte
    fallback. Null and empty texts have no words: they fail the base rule, and their measures are null."""

    @F.arrow_udf(RESULT)
    def rules(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from each(lambda batch: measured(batch, path, bands), texts, _pieces.cache_clear)

    return rules(text)


def kept_documents(docs: DataFrame, path: str, language: str = "lang", text: str = "text", bands: dict = BANDS) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, with their columns as they are. Rows that repeat are judged alike; an
    empty table stays one."""
    rows, name = _with_verdict(docs, docs.columns, path, language, text, bands)
    return rows.where(F.col(f"{name}.kept")).select(*[F.col(f"`{x}`") for x in docs.columns])


def judged(docs: DataFrame, path: str, language: str = "lang", text: str = "text", id: str = "doc_id", bands: dict = BANDS) -> DataFrame:
    """``id`` and the fields of ``quality``, where ``kept`` also needs the bands of the row's language: characters per token
    around the median, and token entropy above a line in the logarithm of the number of tokens, since short texts have less.
    Medians, lines and deviations are those of all rows that pass the base rules and are measured. A null language is one.
    Rows that repeat, ties and very long texts count as they are; an empty table gives an empty one."""
    rows, name = _with_verdict(docs, [id], path, language, text, bands)
    return rows.select(F.col(f"`{id}`"), f"{name}.*")


def _with_verdict(docs: DataFrame, columns: list[str], path: str, language: str, text: str, bands: dict) -> tuple[DataFrame, str]:
    """The ``columns`` of ``docs`` and a struct column with the verdict, and that column's name. Texts are read once: rows
    are written with their measures, and the few lines of the languages come to them by a plain join."""
    name, tongue, line = (free_name(docs, x) for x in ("quality", "quality_language", "quality_line"))
    spoken = F.coalesce(F.col(f"`{language}`").cast("string"), F.lit("")).alias(tongue)
    rows = written(docs.select(*[F.col(f"`{x}`") for x in columns], spoken, quality(F.col(f"`{text}`"), path, bands).alias(name)), "quality")
    base = rows.select(tongue, f"{name}.*").where(~F.col("base_failed") & (F.col("n_tokens") >= MEASURED_FROM))
    quartiles = lambda x: F.percentile_approx(x, [0.25, 0.5, 0.75], 10_000)
    size = lambda x: F.log2(x.n_tokens)
    above = lambda x: x.token_entropy - F.col(line).entropy - F.col(line).slope * (size(x) - F.col(line)["size"])
    one = F.struct("n_tokens", "token_entropy")
    base = base.select(tongue, "chars_per_token", one.alias("m"))
    m = F.col("m")
    lines = base.groupBy(tongue).agg(
        quartiles("chars_per_token").alias("chars"), F.coalesce(F.regr_slope(m.token_entropy, size(m)), F.lit(0.0)).alias("slope"),
        F.avg(m.token_entropy).alias("entropy"), F.avg(size(m)).alias("size"),
    )
    lines = written(lines.select(tongue, F.struct("chars", "slope", "entropy", "size").alias(line)), "lines")
    spreads = base.join(lines, tongue).groupBy(tongue).agg(F.first(line).alias(line), quartiles(above(m)).alias("rest"))
    lines = written(spreads.select(tongue, F.struct(f"{line}.*", "rest").alias(line)), "spreads")
    q, chars, rest = F.col(name), F.col(line).chars, F.col(line).rest
    deviation = lambda x, least: F.greatest((x[2] - x[0]) / 1.349, F.lit(least))
    inside = (F.abs(q.chars_per_token - chars[1]) <= CHARS_MARGIN * deviation(chars, LEAST_CHARS)) & (above(q) >= rest[1] - ENTROPY_MARGIN * deviation(rest, LEAST_ENTROPY))
    kept = q.kept & ((q.n_tokens < MEASURED_FROM) | F.coalesce(inside, F.lit(True)))
    return rows.join(lines, tongue, "left").withColumn(name, q.withField("kept", kept)), name
