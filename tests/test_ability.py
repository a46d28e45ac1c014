"""Both forms of the ability estimates, and their special cases."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from thetaloom.operators import ability
from thetaloom.operators.ability import estimate_theta, estimate_theta_relational, grid
from thetaloom.operators.bootstrap import bootstrap_interval

SCHEMA = "who string, irt_model string, scaled_points int, score int, slope double, location double, guessing double, step1 double, step2 double"


LOCATIONS = (-1.7, -0.4, 0.3, 0.9, 2.2)


def patterns(spark, scores):
    rows = [(who, "2PL", 1, s, 0.8 + 0.2 * i, b, None, None, None) for who, pattern in scores.items() for i, (s, b) in enumerate(zip(pattern, LOCATIONS))]
    return spark.createDataFrame(rows, SCHEMA)


def direct(pattern):
    """EAP by a plain sum over a wide grid, and the root of the score equation by bisection."""
    slopes = [0.8 + 0.2 * i for i in range(len(LOCATIONS))]
    chance = lambda t, i: 1 / (1 + math.exp(-1.7 * slopes[i] * (t - LOCATIONS[i])))
    points = [k / 500 for k in range(-3000, 3001)]
    weights = [math.exp(-t * t / 2) * math.prod(chance(t, i) if s else 1 - chance(t, i) for i, s in enumerate(pattern)) for t in points]
    slope_sum = lambda t: sum(slopes[i] * (s - chance(t, i)) for i, s in enumerate(pattern))
    low, high = -6.0, 6.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if slope_sum(middle) > 0 else (low, middle)
    return sum(t * w for t, w in zip(points, weights)) / sum(weights), low


@pytest.mark.parametrize("estimate", [estimate_theta, estimate_theta_relational])
def test_patterns_against_direct_sums(spark, estimate):
    mixed = {"up": (1, 1, 1, 0, 0), "odd": (0, 1, 0, 1, 1), "one": (0, 0, 0, 0, 1), None: (1, 1, 0, 1, 1)}
    df = patterns(spark, mixed | {"all": (1,) * 5, "none": (0,) * 5})
    rows = {row["who"]: row for row in estimate(df, ["who"]).collect()}
    assert len(rows) == 6 and all(row["items"] == 5 for row in rows.values())
    for who, pattern in mixed.items():
        eap, mle = direct(pattern)
        assert rows[who]["theta_eap"] == pytest.approx(eap, abs=1e-4) and rows[who]["theta_mle"] == pytest.approx(mle, abs=2e-4)
        assert rows[who]["mle_note"] is None and rows[who]["theta_mle_se"] > 0
    for who, sign, note in (("all", 1, "perfect score"), ("none", -1, "zero score")):
        assert (rows[who]["theta_mle"], rows[who]["mle_note"], rows[who]["theta_mle_se"]) == (sign * math.inf, note, None)
        assert rows[who]["theta_eap"] == pytest.approx(direct((1,) * 5 if sign > 0 else (0,) * 5)[0], abs=1e-4)


@pytest.mark.parametrize("estimate", [estimate_theta, estimate_theta_relational])
def test_a_missing_integer_key_is_one_group(spark, estimate):
    rows = [(key, "2PL", 1, s, 1.0, b, None, None, None) for key in (None, 2**53, 2**53 + 1) for s, b in ((1, -1.0), (0, 0.5), (1, 0.2))]
    df = spark.createDataFrame(rows, SCHEMA.replace("who string", "who bigint"))
    assert sorted((r["who"] or 0, r["items"]) for r in estimate(df, ["who"]).collect()) == [(0, 3), (2**53, 3), (2**53 + 1, 3)]


def test_likelihood_beyond_the_grid(spark):
    rows = [("a", "3PL", 1, 1, 1.0, 0.0, 0.2, None, None), ("a", "3PL", 1, 0, 0.2, -9.0, 0.2, None, None), ("a", "3PL", 1, 0, 2.0, -9.5, 0.2, None, None)]
    for estimate in (estimate_theta, estimate_theta_relational):
        row = estimate(spark.createDataFrame(rows, SCHEMA), ["who"]).first()
        assert (row["theta_mle"], row["mle_note"]) == (-math.inf, "beyond ±6")


def test_both_forms_agree(tables):
    keys = ["respondent", "calibration"]
    streamed = estimate_theta(tables.v_responses, keys, max_group_rows=1000)
    related = estimate_theta_relational(tables.v_responses, keys)
    # With a low bound for large groups, some groups of this table take each form.
    split = estimate_theta(tables.v_responses, keys, large_group=30)
    names = ["theta_eap", "theta_eap_se", "theta_mle", "theta_mle_se"]
    expected = {tuple(r[k] for k in keys): r for r in streamed.collect()}
    for frame in (related, split):
        rows = frame.collect()
        assert len(rows) == len(expected)
        for row in rows:
            other = expected[tuple(row[k] for k in keys)]
            assert row["mle_note"] == other["mle_note"] and row["items"] == other["items"]
            for name in names:
                if row[name] is None or math.isinf(row[name]):
                    assert row[name] == other[name]
                else:
                    assert row[name] == pytest.approx(other[name], abs=1e-6)


def test_ways_to_sum_the_grid_agree():
    rng = np.random.default_rng(1)
    n = 500
    kind = rng.choice(["3PL", "2PL", "GPCM"], n)
    gpcm, long = kind == "GPCM", rng.integers(0, 2, n).astype(bool)
    steps = rng.normal(size=(n, 3))
    columns = {
        "irt_model": kind, "scaled_points": np.where(gpcm, np.where(long, 3, 2), 1), "slope": rng.uniform(0.3, 2, n), "location": rng.normal(size=n),
        "guessing": np.where(kind == "3PL", 0.2, np.nan), "step1": np.where(gpcm, steps[:, 0], np.nan), "step2": np.where(gpcm, steps[:, 1], np.nan),
        "step3": np.where(gpcm & long, steps[:, 2], np.nan),
    }
    columns["score"] = rng.integers(0, columns["scaled_points"] + 1)
    block, starts = ability._Block(columns), np.array([0, 3, 4, 200])
    theta = grid()[None, :]
    direct = ability._sums_by_group(block.log_likelihood, theta, starts, n)
    assert block.moderate()
    assert np.allclose(ability._products_by_group(block, 0.01, theta.shape[1], starts), direct, rtol=1e-6, atol=1e-3)
    probabilities = block.probabilities(theta, slice(0, n))
    assert np.allclose(sum(probabilities), 1)
    observed = np.select([columns["score"][:, None] == k for k in range(4)], probabilities)
    assert np.allclose(np.log(observed), block.log_likelihood(theta, slice(0, n)), atol=1e-6)
    doubled = ability._Block({name: np.concatenate([v, v, v]) for name, v in columns.items()})
    thrice = ability._grid_likelihood(doubled, 0.01, np.array([0, n, 2 * n]))  # few distinct pairs: their curves are added up
    assert np.allclose(thrice, np.tile(direct.sum(axis=0), (3, 1)), atol=1e-6)


def test_missing_scores_are_left_out(spark):
    df = patterns(spark, {"a": (1, 0, 0)}).unionByName(patterns(spark, {"a": (None, None, None)}))
    assert estimate_theta(df, ["who"]).first()["items"] == 3


def test_grid():
    assert len(grid()) == 1201 and grid()[0] == -6 and grid()[-1] == 6


def test_bootstrap_forms_agree(spark):
    rng = np.random.default_rng(0)
    rows = [("g", f"i{i}", float(rng.integers(0, 2)), 1.0) for i in range(800)]
    df = spark.createDataFrame(rows, "g string, item string, points double, top double")
    exact = bootstrap_interval(df, ["g"], "item", "points", "top").first()
    poisson = bootstrap_interval(df, ["g"], "item", "points", "top", method="poisson").first()
    share = df.agg(F.avg("points")).first()[0]
    half = 1.96 * math.sqrt(share * (1 - share) / 800) * 100
    for row in (exact, poisson):
        assert row["ci_low"] == pytest.approx(100 * share - half, abs=0.6)
        assert row["ci_high"] == pytest.approx(100 * share + half, abs=0.6)
    # The result does not depend on the partitioning.
    again = bootstrap_interval(df.repartition(5, "item"), ["g"], "item", "points", "top").first()
    assert tuple(again) == tuple(exact)


def test_interpolated_likelihood():
    """Against the sums at every point of the grid: mixed models, short and long groups, groups of one model alone."""
    rng = np.random.default_rng(3)
    rows = 3000
    gpcm = np.where(np.arange(rows) < 40, np.arange(rows) < 20, rng.random(rows) < 0.2)
    points = np.where(gpcm, 2, 1)
    columns = {
        "irt_model": np.where(gpcm, "GPCM", np.where(rng.random(rows) < 0.5, "3PL", "2PL")).astype(object), "score": rng.integers(0, points + 1), "scaled_points": points,
        "slope": rng.uniform(0.5, 2.0, rows), "location": rng.uniform(-2.5, 2.5, rows), "guessing": np.where(gpcm, np.nan, rng.uniform(0, 0.3, rows)),
    }
    step = rng.uniform(0.2, 0.9, rows)
    columns |= {"step1": np.where(gpcm, step, np.nan), "step2": np.where(gpcm, -step, np.nan), "step3": np.full(rows, np.nan)}
    starts = np.unique(np.r_[0, 20, 40, 41, rng.integers(42, rows, 25)])
    block = ability._Block(columns)
    found = ability._interpolated(block, 0.01, starts)
    assert np.abs(found - ability._products_by_group(block, 0.01, 1201, starts)).max() < 1e-9
    assert ability._interpolated(block, 0.5, starts) is None  # fewer points than nodes
    columns["slope"][7] = 9.0
    assert ability._interpolated(ability._Block(columns), 0.01, starts) is None
    columns["slope"][7], columns["scaled_points"][3] = 1.0, 3
    assert ability._interpolated(ability._Block(columns), 0.01, starts) is None


def test_poisson_weights_are_those_of_their_definition():
    from thetaloom.operators import bootstrap

    hashes = np.r_[np.random.default_rng(2).integers(0, 2**28, 300), 0, 2**28 - 1]
    uniform = bootstrap._mix(hashes[:, None] * 65_537 + np.arange(500)[None, :]) / bootstrap.PRIME
    steps = np.cumsum([np.exp(-1.0) / math.factorial(k) for k in range(11)])
    assert (bootstrap._weights(hashes, 500) == np.searchsorted(steps, uniform, side="right")).all()


def test_an_item_draws_its_weights_once(spark, monkeypatch):
    """Rows of an item in several groups, missing groups among them, share the item's weights, in any order."""
    from thetaloom.operators import bootstrap

    rng = np.random.default_rng(3)
    rows = [(g, f"i{i}", float(rng.integers(0, 3)), 2.0) for i in range(300) for g in (1, 2, None) if (i + (g or 0)) % 4]
    df = spark.createDataFrame(rows, "g bigint, item string, points double, top double")
    found = {r["g"]: (r["ci_low"], r["ci_high"]) for r in bootstrap_interval(df, ["g"], "item", "points", "top").collect()}
    monkeypatch.setattr(bootstrap, "DRAWN", 7)
    monkeypatch.setattr(bootstrap, "HELD", 1)
    parts = {r["g"]: (r["ci_low"], r["ci_high"]) for r in bootstrap_interval(df, ["g"], "item", "points", "top").collect()}
    assert found == parts and len(found) == 3
    for group, interval in found.items():
        mine = [(int(hashlib.md5(item.encode()).hexdigest()[:7], 16), points, top) for g, item, points, top in rows if g == group]
        h, points, top = (np.array(x) for x in zip(*mine, strict=True))
        steps = np.cumsum([np.exp(-1.0) / math.factorial(k) for k in range(11)])
        weights = np.searchsorted(steps, bootstrap._mix(h[:, None] * 65_537 + np.arange(2000)[None, :]) / bootstrap.PRIME, side="right")
        assert interval == pytest.approx(np.quantile(100 * (points @ weights) / (top @ weights), [0.025, 0.975]), abs=1e-9)


def test_large_groups_are_added_up(spark, monkeypatch):
    """Groups above the bound, over several tasks and hand-overs, as the definition has them; missing parameters add nothing."""
    monkeypatch.setattr(ability, "HELD", 2)
    rng = np.random.default_rng(7)
    rows = []
    for who in ("a", "b", None, "all", "none"):
        for i in range(120):
            kind = ("3PL", "2PL", "GPCM")[i % 3]
            top = 2 if kind == "GPCM" else 1
            score = {"all": top, "none": 0}.get(who, int(rng.integers(0, top + 1)))
            steps = (0.4, -0.4) if kind == "GPCM" else (None, None)
            rows.append((who, kind, top, score, float(rng.uniform(0.4, 1.9)) if i % 17 else None, float(rng.normal()), 0.2 if kind == "3PL" else None, *steps))
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    keys = ["who"]
    assert "Generate" not in estimate_theta(df, keys, large_group=100)._jdf.queryExecution().optimizedPlan().toString()  # no row for each response and ability
    found = {r["who"]: r.asDict() for r in estimate_theta(df, keys, large_group=100).collect()}
    expected = {r["who"]: r.asDict() for r in estimate_theta_relational(df, keys).collect()}
    assert found.keys() == expected.keys() and len(found) == 5
    for who, row in expected.items():
        for name, value in row.items():
            assert found[who][name] == (pytest.approx(value, abs=1e-6) if isinstance(value, float) and math.isfinite(value) else value), (who, name)
