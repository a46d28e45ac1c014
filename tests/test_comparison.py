"""Comparison of runs, effects and agreement against plain loops over random and planted cases."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from thetaloom.operators import comparison as C
from thetaloom.operators import errors as E
from thetaloom.operators import order_stats as O
from thetaloom.sources.files import DataError

RUNS = ["north", "south", "west"]
ITEMS = [f"q{i:02d}" for i in range(14)]
SCALES = {"slope": [0.2, 0.7, 1.3, 2.1], "location": [-2.2, -0.9, 0.4, 1.6]}
#: Items that a run didn't predict.
ABSENT = {("south", "q03"), ("west", "q03"), ("west", "q11")}
SHARED = [item for item in ITEMS if item not in ("q03", "q11")]


def world():
    """Calibrated values by item and parameter, and predictions, reference and calibration means by run."""
    rng = random.Random(20)
    truth = {(i, p): round(rng.uniform(0.3, 2) if p == "slope" else rng.uniform(-2, 2), 3) for i in ITEMS for p in SCALES}
    said = {(run, i, p): round(value + rng.gauss(0, 0.1 * (1 + RUNS.index(run))), 3) for run in RUNS for (i, p), value in truth.items() if (run, i) not in ABSENT}
    means = {(i, p): (round(rng.uniform(-1, 1), 3), round(rng.uniform(-1, 1), 3)) for i in ITEMS for p in SCALES}
    return truth, said, means


TRUTH, SAID, MEANS = world()


@pytest.fixture(scope="module")
def errors(spark):
    rows = []
    for (run, item, parameter), value in SAID.items():
        calibration, reference = MEANS[item, parameter]
        # Only the western run was shown reference items.
        rows.append((run, item, 4 + 4 * (item < "q07"), parameter, value, TRUTH[item, parameter], calibration, reference if run == "west" else None, value + 0.3))
    return spark.createDataFrame(rows, "run string, item_key string, grade int, parameter string, predicted double, calibrated double, calibration_mean double, reference_mean double, map double")


def test_items_of_all_runs_and_baselines_as_runs(errors):
    assert {r["item_key"] for r in C.common_items(errors, 3).collect()} == set(SHARED)
    found = {(r["run"], r["item_key"], r["parameter"]): r["predicted"] for r in C.stacked(errors, RUNS, reference_run="west").collect()}
    expected = {(run, i, p): SAID[run, i, p] for run in RUNS for i in SHARED for p in SCALES}
    for name, at in (("calibration_mean", 0), ("reference_mean", 1)):
        expected |= {(name, i, p): MEANS[i, p][at] for i in SHARED for p in SCALES}
    assert found == expected
    without = {r["run"] for r in C.stacked(errors, RUNS).select("run").distinct().collect()}
    assert without == {*RUNS, "calibration_mean"}


@pytest.mark.parametrize("runs", [[], ["reference_mean", "x"], ["x", "y", "x"]])
def test_names_of_runs(runs):
    with pytest.raises(ValueError):
        C.check_runs(runs)


def test_runs_that_disagree_on_the_truth(errors):
    assert C.disagreements(errors).count() == 0
    moved = errors.withColumn("calibrated", F.when((F.col("run") == "west") & (F.col("item_key") == "q05"), 9.0).otherwise(F.col("calibrated")))
    # Two other runs, two parameters, one item; the pairs count once.
    assert {r["item_key"] for r in C.disagreements(moved).select("item_key").collect()} == {"q05"}


def test_mean_errors_and_pairs(errors):
    every = [*RUNS, *C.BASELINES]
    stack = C.stacked(errors, RUNS, reference_run="west")
    value = lambda run, i, p: SAID[run, i, p] if run in RUNS else MEANS[i, p][C.BASELINES.index(run)]
    off = lambda run, i, p: abs(value(run, i, p) - TRUTH[i, p])
    order = {"calibration_mean": 0, "reference_mean": 1}
    assert [order[name] for name in C.BASELINES] == [0, 1]
    for row in E.mae_table(stack, ["parameter"], every).collect():
        assert row["items"] == len(SHARED)
        for run in every:
            assert row[run] == pytest.approx(sum(off(run, i, row["parameter"]) for i in SHARED) / len(SHARED))
    rows = C.paired(stack, C.comparisons(RUNS, C.BASELINES)).collect()
    assert len(rows) == len(SCALES) * (3 + 3 * 2)
    for row in rows:
        a, b = row["comparison"].split(" − ")
        gaps = [off(a, i, row["parameter"]) - off(b, i, row["parameter"]) for i in SHARED]
        mean = sum(gaps) / len(gaps)
        sd = math.sqrt(sum((g - mean) ** 2 for g in gaps) / (len(gaps) - 1))
        assert row["estimate"] == pytest.approx(mean)
        assert row["t"] == pytest.approx(mean / (sd / math.sqrt(len(gaps))))
        assert row["p_holm"] >= row["p_value"]


def direct_holm(values):
    out, highest = {}, 0.0
    present = sorted((v, i) for i, v in enumerate(values) if v is not None)
    for k, (v, i) in enumerate(present):
        highest = max(highest, min(1.0, v * (len(present) - k)))
        out[i] = highest
    return [out.get(i) for i in range(len(values))]


def test_holm_in_families(spark):
    families = {"f": [0.2, 0.011, None, 0.6, 0.011, 0.04], "g": [0.9], "h": [None], None: [0.3, 0.002]}
    df = spark.createDataFrame([(f, i, p) for f, values in families.items() for i, p in enumerate(values)], "family string, i int, p_value double")
    found = {(r["family"], r["i"]): r["p_holm"] for r in C.holm(df, ["family"]).collect()}
    for family, values in families.items():
        for i, expected in enumerate(direct_holm(values)):
            assert found[family, i] == (None if expected is None else pytest.approx(expected))


def test_t_test_of_few_and_equal_values(spark):
    values = {"single": [4.5], "equal": [-1.5] * 4, "spread": [0.3, -2.0, 5.1, 0.0, 1.7]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v double")
    rows = {r["g"]: r for r in C.t_test(df, ["g"], "v").collect()}
    assert [rows["single"][name] for name in ("estimate", "se", "df", "t", "p_value")] == [4.5, None, None, None, None]
    assert (rows["equal"]["t"], rows["equal"]["p_value"], rows["equal"]["ci_low"], rows["equal"]["ci_high"]) == (None, None, -1.5, -1.5)
    vs = values["spread"]
    mean = sum(vs) / 5
    assert rows["spread"]["t"] == pytest.approx(mean / math.sqrt(sum((v - mean) ** 2 for v in vs) / 4 / 5)) and rows["spread"]["df"] == 4


def direct_kappa(a, b):
    """One minus observed over expected squared distance, over all pairs of a value of either side."""
    seen = sum((x - y) ** 2 for x, y in zip(a, b)) / len(a)
    chance = sum((x - y) ** 2 for x in a for y in b) / len(a) ** 2
    return None if chance == 0 else 1 - seen / chance


def test_weighted_kappa_against_all_pairs(spark):
    rng = random.Random(8)
    cases = {f"r{k}": ([rng.randrange(5) for _ in range(30)], [rng.randrange(5) for _ in range(30)]) for k in range(4)} | {"flat": ([4] * 3, [4] * 3), "opposite": ([0, 4, 0, 4], [4, 0, 4, 0])}
    df = spark.createDataFrame([(g, x, y) for g, (a, b) in cases.items() for x, y in zip(a, b)], "g string, a int, b int")
    found = {r["g"]: r["weighted_kappa"] for r in C.agreement(df, ["g"], "a", "b").collect()}
    for g, (a, b) in cases.items():
        expected = direct_kappa(a, b)
        assert found[g] == (None if expected is None else pytest.approx(expected))


def test_choices_on_scales(errors):
    nearest = lambda x, p: min(SCALES[p], key=lambda v: (abs(v - x), v))
    rows = C.scale_choices(errors, SCALES).collect()
    assert len(rows) == len(SAID)
    for r in rows:
        assert r["value"] == nearest(SAID[r["run"], r["item_key"], r["parameter"]], r["parameter"])
        assert r["calibrated_value"] == nearest(TRUTH[r["item_key"], r["parameter"]], r["parameter"])
    # The most likely value must be one of the scale; here it never is, unless it is put there.
    assert C.scale_choices(errors, SCALES, mode="map").filter("on_scale").count() == 0
    C.require_on_scale(C.scale_choices(errors, SCALES))
    with pytest.raises(DataError, match="not on the comparison's scale"):
        C.require_on_scale(C.scale_choices(errors, SCALES, mode="map"))
    placed = errors.withColumn("map", F.when(F.col("parameter") == "slope", 0.7).otherwise(-0.9))
    exact = C.scale_choices(placed, SCALES, mode="map")
    assert exact.filter("not on_scale").count() == 0 and {r["value"] for r in exact.select("value").distinct().collect()} == {0.7, -0.9}
    spread = {(r["parameter"], r["value"]): r for r in C.value_spread(C.scale_choices(errors, SCALES), SCALES, RUNS).collect()}
    assert len(spread) == 8
    for (p, v), row in spread.items():
        for run in RUNS:
            assert row[run] == sum(nearest(x, p) == v for (r, _, q), x in SAID.items() if (r, q) == (run, p))


FACTORS = {"prompt": ["short", "long"], "temperature": ["cold", "warm"]}


def designed(spark, factors, missing=()):
    rng = random.Random(3)
    rows, off = [], {}
    for levels in itertools.product(*factors.values()):
        for item in ("i1", "i2", "i3", "i4", "i5"):
            error = round(rng.gauss(0, 1), 3)
            if (levels, item) not in missing:
                rows.append((*levels, item, "slope", 0.8 + error, 0.8))
                off[levels, item] = abs(error)
    names = ", ".join(f"{name} string" for name in factors)
    return spark.createDataFrame(rows, f"{names}, item_key string, parameter string, predicted double, calibrated double"), off


def test_effects_against_differences_of_differences(spark):
    gone = {(("long", "cold"), "i2")}
    df, off = designed(spark, FACTORS, gone)
    items = ["i1", "i3", "i4", "i5"]
    at = lambda p, t, i: off[(p, t), i]
    gains = {
        "prompt": [sum(at("long", t, i) - at("short", t, i) for t in FACTORS["temperature"]) / 2 for i in items],
        "temperature": [sum(at(p, "warm", i) - at(p, "cold", i) for p in FACTORS["prompt"]) / 2 for i in items],
        "prompt × temperature": [(at("long", "warm", i) - at("long", "cold", i)) - (at("short", "warm", i) - at("short", "cold", i)) for i in items],
    }
    found = {r["effect"]: r for r in C.factorial_effects(df, FACTORS).collect()}
    assert set(found) == set(gains)
    for name, values in gains.items():
        mean = sum(values) / 4
        se = math.sqrt(sum((v - mean) ** 2 for v in values) / 3 / 4)
        assert found[name]["items"] == 4
        assert (found[name]["estimate"], found[name]["t"]) == (pytest.approx(mean), pytest.approx(mean / se))
    assert found["temperature"]["comparison"] == "warm − cold"


def test_weights_of_contrasts():
    with pytest.raises(ValueError):
        C.contrast_weights({"prompt": ["short", "long", "longer"], "temperature": ["cold", "warm"]})
    weights = C.contrast_weights({name: ["no", "yes"] for name in "pqrs"})
    by: dict = {}
    for effect, *_, weight in weights:
        by.setdefault(effect, []).append(weight)
    # Every nonempty set of four factors has an effect over all sixteen conditions, and each sums to nothing.
    assert len(by) == 15 and all(len(w) == 16 and sum(w) == 0 for w in by.values())


def test_leave_one_out_equals_direct_mean(tables):
    items = tables.v_items
    result = E.leave_one_out(items, ["location"]).select("item_key", "location_mean")
    a, b = items.alias("a"), items.alias("b")
    same = [F.col(f"a.{n}") == F.col(f"b.{n}") for n in E.SCORING]
    direct = a.join(b, [*same, F.col("a.part_group") != F.col("b.part_group")]).groupBy("a.item_key").agg(F.avg("b.location").alias("direct"))
    joined = result.join(direct, "item_key")
    assert joined.count() == direct.count() > 0
    assert joined.filter(F.abs(F.col("location_mean") - F.col("direct")) > 1e-9).count() == 0


def direct_quantile(values, p):
    values = sorted(values)
    at = p * (len(values) - 1)
    low = int(at)
    return values[low] + (at - low) * (values[min(low + 1, len(values) - 1)] - values[low])


def test_ranks_and_quantiles_against_sorting(spark):
    """A far outlier, many ties, infinite and missing values, a group of NULL and one of a single row."""
    rng = random.Random(11)
    groups = {
        "ties": [float(rng.randrange(4)) for _ in range(300)], "far": [rng.random() for _ in range(200)] + [1e15], None: [5.0, -2.0, 5.0, 9.0],
        "one": [3.0], "ends": [math.inf, -math.inf, 0.0, 0.0, None],
    }
    rows = [(g, v, i) for g, values in groups.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, v double, i int")
    ranked = O.average_ranks(df, ["g"], {"v": "r"}).collect()
    assert len(ranked) == len(rows)
    for r in ranked:
        present = [v for v in groups[r["g"]] if v is not None]
        expected = None if r["v"] is None else sum(v < r["v"] for v in present) + (sum(v == r["v"] for v in present) + 1) / 2
        assert r["r"] == expected
    places = {(r["g"], r["i"]): r["at"] for r in O.unique_index(df.filter("v is not null"), ["g"], "v", "i", "at").collect()}
    for g, values in groups.items():
        order = sorted((i for i, v in enumerate(values) if v is not None), key=lambda i: (values[i], i))
        assert [places[g, i] for i in order] == list(range(len(order)))
    wanted = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.975, "e": 1.0}
    found = {r["g"]: r for r in O.quantiles(df.filter("g is null or g <> 'ends'"), ["g"], "v", wanted).collect()}
    assert set(found) == {"ties", "far", "one", None}
    for g, r in found.items():
        for name, p in wanted.items():
            assert r[name] == pytest.approx(direct_quantile(groups[g], p))


def test_ranks_of_text(spark):
    rows = [("g", name) for name in ("pear", "fig", "fig", "apple")]
    found = O.average_ranks(spark.createDataFrame(rows, "g string, v string"), ["g"], {"v": "r"}).collect()
    assert sorted((r["v"], r["r"]) for r in found) == [("apple", 1.0), ("fig", 2.5), ("fig", 2.5), ("pear", 4.0)]


def test_an_outlier_leaves_the_ranges_even(spark):
    df = spark.range(20_000).selectExpr("'g' as g", "case when id = 7 then 1e15 else rand(3) end as v")
    sizes = [r["n"] for r in O._ranges(df, ["g"], ["v"], F.count("*")).groupBy("_part").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 4 and max(sizes) < 3 * 20_000 / len(sizes)


def test_correlation_guards(spark):
    df = spark.createDataFrame([("two", 1.0, 2.0), ("two", 2.0, 3.0), *[("flat", 1.0, float(i)) for i in range(4)], *[("ok", float(i), float(-i)) for i in range(4)]], "g string, x double, y double")
    rows = {r["g"]: r for r in E.correlations(df, ["g"], "x", "y").collect()}
    assert rows["two"]["pearson"] is None and rows["flat"]["spearman"] is None
    assert rows["ok"]["pearson"] == pytest.approx(-1) and rows["ok"]["spearman"] == pytest.approx(-1)


def test_leave_one_out_hashes_totals(spark):
    """Equal and missing keys and repeats; the items are not the hashed side, and those of one scoring group are in many tasks."""
    rows = [("a", "2PL", 1, 7, 1.0), ("a", "2PL", 1, 7, 1.0), ("b", "2PL", 1, 8, 4.0), ("c", "2PL", 1, None, None), ("d", None, 1, 7, 5.0), ("e", None, 1, 9, 3.0)]
    items = spark.createDataFrame(rows, "item_key string, irt_model string, scaled_points int, part_group int, slope double").withColumn("grade", F.lit(4))
    found = E.leave_one_out(items, ["slope"])
    assert sorted((r["item_key"], r["peers"], r["slope_mean"]) for r in found.collect()) == [("a", 2, 4.0), ("a", 2, 4.0), ("b", 3, 1.0), ("c", 3, 2.0), ("d", 1, 3.0), ("e", 1, 5.0)]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ShuffledHashJoin") == plan.count("BuildRight") == 2 and "BroadcastHashJoin" not in plan
    alike = spark.range(2_000).selectExpr("id as item_key", "4 as grade", "'2PL' as irt_model", "1 as scaled_points", "id as part_group", "1.5d as slope")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = E.leave_one_out(alike, ["slope"]).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(parts) > 1 and max(r["count"] for r in parts) < 1_500


def test_stacked_in_one_pass(spark):
    """Baselines come from the first run's rows, repeats and missing values included, in the pass over the runs' rows; rows are hashed to, not sorted."""
    rows = [("r1", "a", 1.0, 2.0, 5.0, 7.0), ("r2", "a", 3.0, 2.0, 5.0, 8.0), ("r2", "a", 3.0, 2.0, 5.0, None), ("r1", "b", 1.0, 1.0, 1.0, 1.0), (None, "a", 9.0, 2.0, 5.0, 6.0)]
    errors = spark.createDataFrame(rows, "run string, item_key string, predicted double, calibrated double, calibration_mean double, reference_mean double").withColumn("parameter", F.lit("slope"))
    found = C.stacked(errors, ["r1", "r2"], reference_run="r2")
    seen = [(r["run"], r["predicted"], r["abs_error"], r["reference_mean"]) for r in found.collect()]
    own = [(None, 9.0, 7.0), ("calibration_mean", 5.0, 3.0), ("r1", 1.0, 1.0), ("r2", 3.0, 1.0), ("r2", 3.0, 1.0)]
    expected = [(*row, reference) for row in own for reference in (None, 8.0)] + [("reference_mean", 8.0, 6.0, 8.0), ("reference_mean", None, None, None)]
    assert sorted(seen, key=str) == sorted(expected, key=str)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2 and "Union" not in plan and "SortMergeJoin" not in plan
