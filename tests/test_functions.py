"""Expressions against hand-computed and published values."""

import math

import pytest
from pyspark.sql import functions as F

from thetaloom.functions import keys as K
from thetaloom.functions import scoring as P
from thetaloom.functions import stats as S
from thetaloom.functions import text as X
from thetaloom.functions.irt import ItemModel
from thetaloom.functions.posterior import nearest_position, posterior
from thetaloom.operators.reporting import benchmark


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def doubles(values):
    return F.array(*[F.lit(float(v)) for v in values])


def estimates(spark, p, v):
    return one(spark, posterior(doubles(p), doubles(v)).alias("r"))["r"]


def test_posterior_against_direct_sums(spark):
    p, v = [0.05, 0.4, 0.1, 0.33, 0.12], [-3.0, -1.0, 0.5, 2.0, 7.0]
    r = estimates(spark, p, v)
    mean = sum(x * y for x, y in zip(p, v))
    assert r["eap"] == pytest.approx(mean)
    assert r["sd"] == pytest.approx(math.sqrt(sum(x * (y - mean) ** 2 for x, y in zip(p, v))))
    # The mode is the second value; half of the mass is reached within the third.
    assert (r["map"], r["median"]) == (-1.0, 0.5) and r["map_probability"] == pytest.approx(0.4)


def test_posterior_of_rounded_and_even_masses(spark):
    p = [0.3, 0.3, 0.2, 0.19]
    r = estimates(spark, p, [5, 6, 7, 8])
    assert r["map"] == 5.0 and r["map_probability"] == pytest.approx(0.3 / 0.99)
    assert r["eap"] == pytest.approx(sum(x * y for x, y in zip(p, (5, 6, 7, 8))) / 0.99)
    # Exactly half below: the median lies between the neighbours.
    assert estimates(spark, [0.5, 0.0, 0.5], [1, 2, 9])["median"] == 1.5


@pytest.mark.parametrize("p", [[1.0], [0.4, 0.3, 0.2, 0.1], [0.0, 0.0, 0.0], [1.2, -0.1, -0.1]])
def test_posterior_of_masses_that_do_not_fit_three_values(spark, p):
    assert estimates(spark, p, [10, 20, 30]) is None


def test_nearest_value(spark):
    grid = doubles([-2.0, -1.0, -0.5, 0.0, 0.2, 0.5, 0.8, 1.0, 1.5, 2.0])
    values = [F.lit(0.15), F.lit(None).cast("double"), F.lit(5.0), F.lit(-3.0)]
    assert list(one(spark, *[nearest_position(v, grid).alias(f"c{i}") for i, v in enumerate(values)])) == [4, None, 9, 0]


def test_t_tail_matches_tables(spark):
    cases = {(2.0, 1): 0.2952, (2.0, 2): 0.1835, (2.0, 3): 0.1393, (2.0, 10): 0.0734, (2.0, 721): 0.0459, (0.0, 5): 1.0}
    for (t, df), p in cases.items():
        assert one(spark, S.t_two_sided(F.lit(t), F.lit(df)).alias("p"))["p"] == pytest.approx(p, abs=5e-5)
    # The series and the expansion agree where they meet.
    series, expansion = one(spark, S._series_tail(F.lit(2.5), F.lit(1000.0)).alias("a"), S._normal_tail(F.lit(2.5), F.lit(1000.0)).alias("b"))
    assert series == pytest.approx(expansion, abs=1e-11)
    assert one(spark, S.t_two_sided(F.lit(None).cast("double"), F.lit(5)).alias("p"))["p"] is None


def test_t_quantile_matches_tables(spark):
    cases = {1: 12.7062, 2: 4.3027, 3: 3.1824, 10: 2.2281, 30: 2.0423, 60: 2.0003, 61: 1.9996, 721: 1.9633}
    for df, q in cases.items():
        assert one(spark, S.t_quantile_975(F.lit(df)).alias("q"))["q"] == pytest.approx(q, abs=6e-5)


def test_normal_cdf(spark):
    for x in (-8.0, -3.0, -0.5, 0.0, 1.0, 1.959963984540054, 6.0):
        expected = 0.5 * math.erfc(-x / math.sqrt(2))
        assert one(spark, S.normal_cdf(F.lit(x)).alias("p"))["p"] == pytest.approx(expected, rel=1e-9, abs=1e-15)


def item(spark, **values):
    base = {"irt_model": "3PL", "slope": 1.0, "location": 0.0, "guessing": None, "step1": None, "step2": None, "step3": None} | values
    return spark.createDataFrame([base], "irt_model string, slope double, location double, guessing double, step1 double, step2 double, step3 double")


def test_dichotomous_models_against_the_formula(spark):
    model = ItemModel()
    for kind, c in (("3PL", 0.31), ("2PL", 0.0)):
        for a, b, theta in ((0.7, -1.3, 0.4), (1.9, 0.8, -2.0), (1.2, 0.0, 5.5)):
            row = item(spark, irt_model=kind, slope=a, location=b, guessing=c or None).select(model.correct(theta).alias("p"), model.expected_score(theta).alias("e"), model.information(theta).alias("i")).first()
            logistic = 1 / (1 + math.exp(-1.7 * a * (theta - b)))
            p = c + (1 - c) * logistic
            slope = (1 - c) * 1.7 * a * logistic * (1 - logistic)
            assert (row["p"], row["e"], row["i"]) == (pytest.approx(p), pytest.approx(p), pytest.approx(slope**2 / (p * (1 - p))))


@pytest.mark.parametrize("steps", [(0.45, -0.45, None), (0.5, 0.3, -0.8), (0.9, -1.1, 0.2)])
def test_partial_credit_against_the_formula(spark, steps):
    """Two- and three-point items: every score's probability, the moments, and scores above the item's points."""
    model, a, b = ItemModel(), 1.15, -0.35
    present = [d for d in steps if d is not None]
    for theta in (-2.5, 0.1, 1.8):
        sums = [0.0]
        for d in present:
            sums.append(sums[-1] + 1.7 * a * (theta - b + d))
        weights = [math.exp(x) for x in sums]
        expected = [w / sum(weights) for w in weights]
        frame = item(spark, irt_model="GPCM", slope=a, location=b, step1=steps[0], step2=steps[1], step3=steps[2])
        mean, square = model.entropy_terms(theta)
        row = frame.select(
            *[p.alias(f"p{k}") for k, p in enumerate(model.probabilities(theta))], model.expected_score(theta).alias("e"), mean.alias("m"), square.alias("v"),
            *[model.log_probability(theta, F.lit(k)).alias(f"l{k}") for k in range(4)],
        ).first()
        for k in range(4):
            if k < len(expected):
                assert row[f"p{k}"] == pytest.approx(expected[k]) and row[f"l{k}"] == pytest.approx(math.log(expected[k]))
            else:
                assert row[f"p{k}"] is None and row[f"l{k}"] is None
        assert row["e"] == pytest.approx(sum(k * p for k, p in enumerate(expected)))
        entropy = sum(p * math.log(p) for p in expected)
        assert row["m"] == pytest.approx(entropy) and row["v"] == pytest.approx(sum(p * math.log(p) ** 2 for p in expected) - entropy**2)


def test_category_points(spark):
    cases = {
        ("Correct Response", 2): 2, ("Partial Response", 3): 2, ("Minimal Response", 3): 1, ("Nonresponse", 1): 0,
        ("Partial Response", 1): None, ("Fully Correct", 3): 3, ("Minimal Response", 2): None, ("incorrect", 2): 0,
    }
    for (category, top), points in cases.items():
        assert one(spark, P.category_points(F.lit(category), F.lit(top)).alias("p"))["p"] == points


def test_benchmarks(spark):
    cases = {(625.0, 8): "Advanced (625)", (420.0, 4): "Low (400)", (420.0, 12): "below the lowest benchmark", (399.9, 4): "below the lowest benchmark"}
    for (score, grade), name in cases.items():
        assert one(spark, benchmark(F.lit(score), F.lit(grade)).alias("b"))["b"] == name


def test_keys_and_labels(spark):
    df = spark.createDataFrame([("A 1995", 4, "Mathematics", "M061480A", "Joint 1995 and 1999-2003 calibration")], "assessment string, grade int, subject string, item_id string, calibration string")
    row = df.select(
        K.item_key("assessment", "grade", "subject", "item_id").alias("key"), K.base_item_id("item_id").alias("base"), K.calibration_label("calibration", "grade").alias("label")
    ).first()
    assert tuple(row) == ("A 1995/grade 4/Mathematics/M061480A", "M061480", "Grade 4, 1995-2003")
    names = {"V4": "V4", "T02B": "T02", "AB": "AB", "K1a": "K1a"}
    for name, base in names.items():
        assert one(spark, K.base_item_id(F.lit(name)).alias("b"))["b"] == base
    # The published example of a version 5 UUID in the URL namespace.
    import uuid

    assert one(spark, K.point_id(F.lit("http://example.org/ä")).alias("u"))["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "http://example.org/ä"))


def test_condition_labels(spark):
    rows = [
        ("openai/x-luna", "openrouter", "high", "test_taker", "x-luna, high reasoning"),
        ("y-5", "anthropic", "none", "student", "y-5 (anthropic), no reasoning, as a student"),
        ("y-5", "anthropic", None, "test_taker", "y-5 (anthropic), default thinking"),
        ("g/z", "openrouter", None, "student", "z, as a student"),
    ]
    df = spark.createDataFrame(rows, "model string, provider string, effort string, role string, expected string")
    for row in df.select(K.condition_label("model", "provider", "effort", "role").alias("label"), "expected").collect():
        assert row["label"] == row["expected"]


def test_terms(spark):
    text = "It's 1,234,567.8 CARDS and 12,3456 pennies; buses, shoes, glass a_b x9 éAs"
    assert one(spark, X.terms(F.lit(text)).alias("t"))["t"] == ["it", "s", "1234567.8", "card", "and", "12", "3456", "penny", "buse", "shoe", "glass", "a", "b", "x", "9", "éas"]


def test_stemmer(spark):
    cases = {"cards": "card", "pennies": "penny", "bus": "bus", "is": "is", "boxes": "boxe", "shoes": "shoe", "trees": "tree", "glass": "glass", "corpus": "corpus", "eies": "eie", "ties": "ty"}
    for word, stem in cases.items():
        assert one(spark, X.s_stem(F.lit(word)).alias("s"))["s"] == stem, word


def test_item_text_drops_empty_parts(spark):
    options = F.array(F.struct(F.lit("A").alias("label"), F.lit("one").alias("text")), F.struct(F.lit("B").alias("label"), F.lit("two").alias("text")))
    none = F.lit(None).cast("array<struct<label:string,text:string>>")
    row = one(spark, X.item_text(F.lit("Stem"), options).alias("a"), X.item_text(F.lit("Stem"), none).alias("b"), X.item_text(F.lit(""), options).alias("c"))
    assert tuple(row) == ("Stem\n\nA. one\nB. two", "Stem", "A. one\nB. two")


def test_cell_limit(spark):
    row = one(spark, K.cell_safe(F.repeat(F.lit("x"), F.lit(40_000))).alias("long"), K.cell_safe(F.lit("a\x07b")).alias("clean"))
    assert len(row["long"]) == K.CELL_LIMIT and row["long"].endswith(K.CELL_NOTE)
    assert row["clean"] == "ab"
