"""Operators that learn: URL verdicts, toxicity, language-model scores; and the secret scan with its counts."""

import collections
import math
import re
import zlib

import numpy as np
import public_tokenizers
import cases
from pyspark.sql import functions as F

from thetaloom.llm import attention, lm_score, secrets, toxicity, url_filter
from thetaloom.llm.queries import URL_RULES, part_of

VOCABULARY = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile("[0-9a-f]+"), 0, 16),
]


def test_hosts_paths_and_rules(spark):
    urls = {
        "https://WWW.Example.com/en/5?x#y": ("www.example.com", "/en/5", "www.example.com/en/", "allow"),
        "http://example.com/en/": ("example.com", "/en/", "example.com/en/", "block"),
        "http://a.b.example.com/en/x://y": ("a.b.example.com", "/en/x://y", "example.com/en/", "block"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "x://m.site.net/fr/1": ("m.site.net", "/fr/1", "net/fr/", "block"),
        "x://com": ("com", "", None, None),
        "x://net?/es/": ("net", "", None, None),
        "no scheme": ("", "", None, None),
        "": ("", "", None, None),
        "a\nb://h\n/p": ("h\n", "/p", None, None),
    }
    rows = spark.createDataFrame([(i, u, "kept") for i, u in enumerate([*urls, None, *urls])], "page_id int, url string, host string")
    found = url_filter.judged(rows, url_filter.labelled_table(spark), URL_RULES).collect()
    assert len(found) == 2 * len(urls) + 1
    for row in found:
        host, path, rule, verdict = [*urls.values(), ("", "", None, None), *urls.values()][row.id]
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict == (verdict or ("block" if row.score >= 0.5 else "allow"))
    assert url_filter.judged(rows.limit(0), url_filter.labelled_table(spark), URL_RULES).count() == 0
    untaught = url_filter.judged(rows, url_filter.labelled_table(spark).limit(0), []).select("score").distinct().collect()
    assert [r.score for r in untaught] == [0.5]


def test_url_model_on_unseen_hosts(spark):
    urls = ["http://casino-win.test/en/3", "https://www.free-bets.test/de/1", "http://m.cheap-pills.test/4", "https://news.village.test/en/7", "http://school.test/fr/12", "https://blog.rivers.test/en/9.html"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    found = {r.id: r.verdict for r in url_filter.judged(rows, url_filter.labelled_table(spark), []).collect()}
    assert [found[i] for i in range(6)] == ["block"] * 3 + ["allow"] * 3


def test_maximal_segments():
    def brute(values):
        """A segment is maximal if its score is positive, all its parts score less, and no longer one has both."""
        sums = np.r_[0, np.cumsum(values)]
        size = len(values)
        good = [(a, b) for a in range(size) for b in range(a + 1, size + 1) if all(sums[b] - sums[a] > sums[b] - sums[c] + 1e-12 and sums[b] - sums[a] > sums[c] - sums[a] + 1e-12 for c in range(a + 1, b))]
        good = [(a, b) for a, b in good if sums[b] > sums[a]]
        return sorted((a, b) for a, b in good if not any((c <= a and b <= d) and (c, d) != (a, b) for c, d in good))

    rng = np.random.default_rng(3)
    for _ in range(150):
        size = int(rng.integers(1, 14))
        places = sorted(rng.choice(size, int(rng.integers(0, size + 1)), replace=False).tolist())
        scores = rng.uniform(0.3, 3, len(places)).tolist()
        values = np.full(size, -0.7)
        values[places] = scores
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(places, scores, 0.7)] == brute(values)


def test_toxicity(spark):
    rows = cases.documents(spark)
    calm, rude = "it was a fine day by the sea and we went home in the evening", "you are a wretched gloober and a vile snark"
    made = [(500000 + i, f"{calm} {i} {'the old town ' * (i % 9)} {rude if i % 4 == 0 else ''} {calm} item{i}", "en", "src1", 1) for i in range(400)]
    rows = rows.union(spark.createDataFrame(made, rows.schema))
    labels = spark.createDataFrame([(id, int("gloober" in text)) for id, text, *_ in made] + [(900002, None), (None, 1), (900001, 0), (500000, 1)], "doc_id bigint, toxic int")
    held = part_of("doc_id", 4) == 2
    found = toxicity.scored(rows, labels, held).collect()
    assert len(found) == rows.count() and all(0 <= r.score <= 1 for r in found)
    by = {r.id: r for r in found if r.id is not None and r.id >= 500000 and r.id < 600000}
    assert all(by[id].held_out == (zlib.crc32(str(id).encode()) % 4 == 2) for id, *_ in made)
    assert all((by[id].score >= 0.3) == ("gloober" in text) for id, text, *_ in made)
    hit = next(r for id, r in by.items() if r.segments)
    assert hit.segments[0].end - hit.segments[0].start <= 12
    # Held-out labels don't matter.
    changed = labels.withColumn("toxic", F.when(F.coalesce(held, F.lit(False)), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.id: r.score for r in toxicity.scored(rows, changed, held).collect() if r.id is not None}
    assert all(abs(again[r.id] - r.score) < 1e-9 for r in found if r.id is not None)
    assert len({r.score for r in toxicity.scored(rows, labels.limit(0), held).collect()}) == 1
    assert toxicity.scored(rows.limit(0), labels, held).count() == 0


def spans_of(text):
    out = []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        out += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    return sorted(out)


def test_secrets(spark):
    rows = cases.documents(spark)
    found = secrets.scanned(rows, "doc_id", "text", "source", F.col("lang")).collect()
    base = lambda r: tuple((x.start, x["rank"], x.kind, x.end) for x in r.spans if x["rank"] < 3)
    assert collections.Counter((r.id, base(r)) for r in found) == collections.Counter((id, tuple(spans_of(text))) for id, text in cases.texts_of(rows))
    assert secrets.scanned(rows.limit(0), "doc_id", "text", "source", F.col("lang")).count() == 0


def test_long_runs_are_read_once(spark):
    import time

    texts = ["g" * 1_000_000, "eyJ" * 330_000, "g" * 500_000 + "://user:password12@host eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK"]
    rows = spark.createDataFrame([(i, t, "o", "r") for i, t in enumerate(texts)], "doc_id int, text string, source string, repo string")
    secrets.scanned(rows.limit(0), "doc_id", "text", "source", F.col("repo")).collect()
    started = time.time()
    found = {r.id: [x.kind for x in r.spans] for r in secrets.scanned(rows, "doc_id", "text", "source", F.col("repo")).collect()}
    assert found[0] == [] and found[1] == [] and found[2] == ["login", "webtoken"]
    assert time.time() - started < 30


def test_owned_and_copied_values(spark):
    own, copied, token = "password=Zk3vQ9xLm2Tt", "password=Aa1Bb2Cc3Dd4Ee", "ghp_0123456789abcdefghijABCDEFGHIJ"
    rows = [(i, f"é😀 {copied} end", f"owner{i}", "r", "kept") for i in range(6)] + [(10, f"{own} and {token} x", "owner0", "r", "kept"), (11, None, None, None, None), (11, token, "owner1", "r", "kept")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string, repo string, secret_spans string")
    found = {(r.id, x.kind): (x.live, x.n_owners) for r in secrets.scanned(frame, "doc_id", "text", "source", F.col("repo")).collect() for x in r.spans}
    assert found[(0, "assign")] == (False, 6) and found[(10, "assign")] == (True, 1) and found[(10, "prefixed")] == (True, 2)
    left = secrets.redacted(frame, "doc_id", "text", "source", F.col("repo"))
    assert left.columns == frame.columns
    texts = sorted((r.doc_id, r.text or "") for r in left.collect())
    assert texts[0] == (0, f"é😀 {copied} end") and texts[-3:] == [(10, "[SECRET] and [SECRET] x"), (11, ""), (11, "[SECRET]")]


def test_attention_learns_and_sums_to_one():
    symbols = np.r_[np.tile([1, 2, 3], 60), attention.END, np.tile([5, 6], 50), attention.END]
    counts = np.array([181, 101])
    model = attention.trained(symbols, counts, steps=150)
    assert attention.log_probabilities(model, symbols, counts)[70:180].mean() > -0.2
    # Any last symbol: the probabilities of all of them sum to one, in a first and in a later window.
    for length in (5, 90):
        start = symbols[: length - 1]
        every = np.concatenate([np.r_[start, s] for s in range(attention.SYMBOLS)])
        last = attention.log_probabilities(model, every, np.full(attention.SYMBOLS, length))[length - 1 :: length]
        assert abs(np.exp(last).sum() - 1) < 1e-4
    # A symbol's probability doesn't depend on what follows.
    changed = symbols[:181].copy()
    changed[100:] = 9
    assert np.allclose(attention.log_probabilities(model, symbols[:181], counts[:1])[:100], attention.log_probabilities(model, changed, counts[:1])[:100], atol=1e-4)
    assert len(attention.log_probabilities(model, np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def test_lm_scores(spark):
    rows = cases.documents(spark)
    held = part_of("doc_id", 7) == 2
    found = lm_score.scored(rows, held, VOCABULARY, part=100_000).collect()
    texts = [(id, cases.words(text) + [""]) for id, text in cases.texts_of(rows)]
    out = lambda id: id is not None and zlib.crc32(str(id).encode()) % 7 == 2
    counts = collections.Counter(w for id, ws in texts if not out(id) for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    expected = sorted((id or -1, out(id), len(ws), sum(counts[w] > 0 for w in ws), total, round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws), 4)) for id, ws in texts)
    assert sorted((r.id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found) == expected
    unseen = [r for r in found if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    assert all(r.score < 0 for r in found)
    assert lm_score.scored(rows.limit(0), held, VOCABULARY).count() == 0
    none = lm_score.scored(cases.edges(spark), F.lit(True), VOCABULARY).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in none)


def test_all_training_texts_reach_the_context_model(spark):
    """With no text in the sample, all that is known of contexts comes from the blocks."""
    rows = spark.createDataFrame([(i, "red by green by blue by black by " * 120) for i in range(1500)], "doc_id bigint, text string")
    found = lm_score.scored(rows, part_of("doc_id", 7) == 2, VOCABULARY, part=4_000_000, sample=0).collect()
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) / sum(r.n_tokens for r in held) > -0.6  # words alone: -0.605; untrained: -2.39


def test_every_subword_is_predicted_from_its_context(spark):
    """Words with one first subword, whose later ones follow from the words before: counts alone leave one in two open."""
    known = lm_score.subwords(VOCABULARY)
    one, other = "qwertle", "qwerton"
    first, second = known.encode(" " + one), known.encode(" " + other)
    assert first[0] == second[0] and first != second
    rows = spark.createDataFrame([(i, f"{one} {other} " * 150) for i in range(1500)], "doc_id bigint, text string")
    found = lm_score.scored(rows, part_of("doc_id", 7) == 2, VOCABULARY, part=2_000_000).collect()
    held = [r for r in found if r.held_out]
    assert held and sum(r.score for r in held) / sum(r.n_tokens for r in held) > -0.1  # by counts of words: -0.301
    # The model's symbols are all ids of the text, with the ends of words, and its end.
    block = lm_score.Block(lm_score.pa.array([f"{one}  {other.upper()}", None, one]), VOCABULARY)
    symbols, counts = block.every(np.array([True, True, True]))
    ids, ends = symbols >> 1, symbols & 1
    assert ids.tolist() == [*first, *second, attention.IDS - 1, attention.IDS - 1, *first, attention.IDS - 1]
    assert ends.tolist() == [0] * (len(first) - 1) + [1] + [0] * (len(second) - 1) + [1, 1, 1] + [0] * (len(first) - 1) + [1, 1]
    assert counts.tolist() == [len(first) + len(second) + 1, 1, len(first) + 1]


def test_steps_follow_the_slope():
    """The first step of a rate is against the sign of the slope, found here by differences."""
    rng = np.random.default_rng(5)
    ids = np.r_[rng.integers(0, 9000, 50), attention.END, rng.integers(0, 9000, 8), attention.END]
    counts, model = np.array([51, 9]), attention.fresh(3)
    seen = attention.occurring(ids, counts)
    loss = lambda m: -attention.log_probabilities({**m, "seen": seen}, ids, counts).sum()
    stepped = attention.refined(model, ids, counts, rate=1e-3)
    for name in attention.SHAPES:
        change = (stepped[name] - model[name]).ravel()
        for at in np.flatnonzero(change)[:: max(1, np.count_nonzero(change) // 12)]:
            sides = []
            for move in (1e-2, -1e-2):
                other = model[name].copy()
                other.ravel()[at] += move
                sides.append(loss({**model, name: other}))
            slope = (sides[0] - sides[1]) / 2e-2
            assert abs(slope) < 5e-3 or np.sign(slope) == -np.sign(change[at]), (name, at, slope)
