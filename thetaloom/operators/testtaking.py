"""Scoring of answers and the tables of test-taking conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thetaloom.functions.irt import MAX_STEPS, THETA_MAX, THETA_MIN, THETA_STEP, ItemModel
from thetaloom.functions.scoring import category_points
from thetaloom.functions.stats import guarded_corr
from thetaloom.operators.integrity import PART_CATEGORY
from thetaloom.operators.order_stats import quantiles
from thetaloom.session import spread
from thetaloom.sources.files import require_empty

# Fixed value: what stands for an empty answer.
NO_RESPONSE = "(no response)"


def verdict_points(verdicts: DataFrame, items: DataFrame) -> DataFrame:
    """One row per item and response hash from verdicts with one category per part: the points of the parts added up,
    their categories joined in the order of the parts, and the reasoning."""
    graded = verdicts.join(items.select("item_key", "max_points"), "item_key")
    part = F.nullif(F.regexp_extract("category", PART_CATEGORY, 1), F.lit(""))
    name = F.when(part.isNull(), F.col("category")).otherwise(F.regexp_extract("category", PART_CATEGORY, 2))
    top = F.when(part.isNull(), F.col("max_points")).otherwise(F.lit(1))
    rows = graded.withColumn("_points", category_points(name, top))
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("part", F.lit("")).alias("part"), "category")))
    return rows.groupBy("item_key", "response_hash").agg(
        F.sum("_points").alias("verdict_points"),
        F.array_join(F.transform(ordered, lambda e: e["category"]), " + ").alias("scorer_category"),
        F.min("reasoning").alias("scorer_reasoning"),
    )


def score_answers(answers: DataFrame, items: DataFrame, parameters: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Points and scaled score of every answer to a calibrated item. A multiple-choice answer is compared with the key,
    a blank response earns 0, and a response without a verdict has no score yet. Where the scaling has other points than
    the guide, only full credit scores 1."""
    known = answers.join(items, "item_key").join(parameters.select("item_key", "irt_model", "scaled_points"), "item_key")
    keyed = known.withColumn("response_hash", F.sha2("answer", 256))
    judged = keyed.join(verdict_points(verdicts, items), ["item_key", "response_hash"], "left")
    choice = F.col("item_type") == "multiple_choice"
    blank = F.trim("answer") == ""
    points = (
        F.when(choice, F.coalesce(F.col("answer") == F.col("correct_option"), F.lit(False)).cast("int")).when(blank, F.lit(0)).otherwise(F.col("verdict_points").cast("int"))
    )
    full = (F.col("points") == F.col("max_points")).cast("int")
    return (
        judged.withColumn("points", points)
        .withColumn("score", F.when(F.col("points").isNull() | (F.col("scaled_points") == F.col("max_points")), F.col("points")).otherwise(full))
        .withColumn("scorer_category", F.when(choice, F.lit(None)).when(blank, F.lit(NO_RESPONSE)).otherwise(F.col("scorer_category")))
        .withColumn("scorer_reasoning", F.when(~choice & ~blank, F.col("scorer_reasoning")))
        .drop("response_hash", "verdict_points")
    )


def verdict_requests(answers: DataFrame, items: DataFrame, parameters: DataFrame) -> DataFrame:
    """Non-blank constructed responses to calibrated items, each distinct (item, response) once. Identical responses are
    combined in every task before the shuffle, so a response that a third of the rows repeat costs one row per task."""
    open_ended = items.filter("item_type = 'constructed_response'").join(parameters.select("item_key"), "item_key", "left_semi")
    rows = answers.join(open_ended.select("item_key"), "item_key", "left_semi").filter(F.trim("answer") != "")
    return rows.groupBy("item_key", F.sha2("answer", 256).alias("response_hash")).agg(F.first("answer").alias("response"), F.count("*").alias("answers"))


def items_on_scale(responses: DataFrame, overall: DataFrame, keys: list[str]) -> DataFrame:
    """Item scores with the item's place on the reporting scale and what the ability predicts: probability of the score,
    expected score, residual."""
    joined = responses.filter("score is not null").join(overall.select(*keys, "theta_eap", "scale_eap", "a", "b"), keys)
    model = ItemModel()
    return joined.withColumns(
        {
            "location_scale": F.col("a") + F.col("b") * F.col("location"),
            "probability_of_score": model.score_probability("theta_eap"),
            "expected_score": model.expected_score("theta_eap"),
            "residual": F.col("score") - model.expected_score("theta_eap"),
        }
    )


def person_fit(responses: DataFrame, abilities: DataFrame, keys: list[str]) -> DataFrame:
    """The standardised log-likelihood of each response pattern at its ability."""
    joined = responses.filter("score is not null").join(abilities.select(*keys, "theta_eap"), keys)
    model = ItemModel()
    mean, variance = model.entropy_terms("theta_eap")
    sums = joined.groupBy(*keys).agg(
        F.sum(model.log_probability("theta_eap")).alias("_o"), F.sum(mean).alias("_e"), F.sum(variance).alias("_v"), F.count("*").alias("items")
    )
    return sums.select(*keys, "items", F.try_divide(F.col("_o") - F.col("_e"), F.sqrt("_v")).alias("l_z"))


def with_grid(items: DataFrame, low: float = THETA_MIN, high: float = THETA_MAX, step: float = THETA_STEP) -> DataFrame:
    """Each item at every ability of a grid. The items, few bytes that cost much, are spread over all tasks first."""
    last = int(round((high - low) / step))
    return spread(items).withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(last)))).withColumn("theta", F.lit(low) + F.col("_g") * F.lit(step))


def log_probability_grid(items: DataFrame, step: float = THETA_STEP) -> DataFrame:
    """ln P of every score of every item at every ability of the grid."""
    values = ItemModel().probabilities("theta")
    entries = F.array(*[F.struct(F.lit(k).alias("score"), F.ln(F.greatest(p, F.lit(1e-300))).alias("log_probability")) for k, p in enumerate(values)])
    rows = with_grid(items, step=step).select("item_key", "theta", "scaled_points", F.inline(entries))
    return rows.filter("score <= scaled_points").drop("scaled_points")


def model_checks(items: DataFrame, low: float = -4.0, high: float = 4.0, step: float = 0.1, shift: float = 1e-5) -> DataFrame:
    """Each item's model against its definition: the largest departure of the probabilities from a sum of 1, of P(b) from
    (1 + c) / 2, of adjacent scores from being equally likely at b - d_k, and of the information from the numeric one
    (the sum of P'^2 / P with P' by central differences), with ``passes``. One pass over items x grid."""
    model, theta = ItemModel(), F.col("theta")
    at = [F.coalesce(p, F.lit(0.0)) for p in model.probabilities(theta)]
    numeric = F.lit(0.0)
    for p, up, down in zip(model.probabilities(theta), model.probabilities(theta + shift), model.probabilities(theta - shift)):
        slope = (up - down) / (2 * shift)
        numeric = numeric + F.coalesce(slope * slope / p, F.lit(0.0))
    gpcm = F.col("irt_model") == "GPCM"
    crossing = F.lit(0.0)
    for k in range(1, MAX_STEPS + 1):
        there = model.probabilities(F.col("location") - F.col(f"step{k}"))
        crossing = F.greatest(crossing, F.coalesce(F.abs(there[k] - there[k - 1]), F.lit(0.0)))
    half = F.abs(model.correct(F.col("location")) - (1 + F.coalesce("guessing", F.lit(0.0))) / 2)
    points = with_grid(items, low, high, step).withColumns(
        {
            "_sum": F.abs(sum(at[1:], at[0]) - 1), "_least": F.least(*at), "_half": F.when(gpcm, F.lit(0.0)).otherwise(half),
            "_cross": F.when(gpcm, crossing).otherwise(F.lit(0.0)), "_information": model.information(theta), "_numeric": numeric,
        }
    )
    wrong = F.abs(F.col("_information") - F.col("_numeric")) > 1e-8 + 1e-4 * F.abs(F.col("_numeric"))
    table = points.groupBy("item_key").agg(
        F.max("_sum").alias("sum_departure"), F.min("_least").alias("least_probability"), F.max("_half").alias("half_departure"),
        F.max("_cross").alias("crossing_departure"), F.sum("_information").alias("information"), F.sum("_numeric").alias("numeric_information"),
        F.max(wrong.cast("int")).alias("_wrong"),
    )
    close = F.greatest("sum_departure", "half_departure", "crossing_departure") <= 1e-8
    return table.withColumn("passes", close & (F.col("least_probability") >= 0) & (F.col("_wrong") == 0)).drop("_wrong")


LEAST_CORRELATION = 0.8


def implied_percent_correct(items: DataFrame, groups: list[str], percent: str = "percent_correct", step: float = THETA_STEP) -> DataFrame:
    """The percent correct that each dichotomous item's parameters imply under a standard normal ability, against the
    observed one: items, correlation and both means per group, and whether the correlation reaches ``LEAST_CORRELATION``."""
    rows = with_grid(items.filter((F.col("irt_model") != "GPCM") & F.col(percent).isNotNull()), step=step)
    weight = F.exp(-F.col("theta") * F.col("theta") / 2)
    implied = rows.groupBy("item_key", *groups, percent).agg((100 * F.sum(ItemModel().correct("theta") * weight) / F.sum(weight)).alias("implied"))
    return implied.groupBy(*groups).agg(
        F.count("*").alias("items"), guarded_corr(F.col("implied"), F.col(percent)).alias("correlation"),
        F.avg("implied").alias("mean_implied"), F.avg(percent).alias("mean_observed"),
    ).withColumn("agrees", F.coalesce(F.col("correlation") >= LEAST_CORRELATION, F.lit(False)))


def require_agreement(implied: DataFrame, groups: list[str]) -> None:
    """Raise where a group's implied and observed percents do not agree: its parameters or their scale are wrong."""
    require_empty(implied.filter("not agrees").select(*groups, "items", "correlation"), f"Implied and observed percents correlate below {LEAST_CORRELATION}")


def texts_at_two_grades(items: DataFrame, text: str, measures: dict[str, Column]) -> DataFrame:
    """Texts that items of several grades share: a row per text and pair of grades, with the items and the ``measures`` (each
    an aggregate) of either grade in columns ``first_`` and ``second_``. Items of a text are aggregated by grade first, so a
    text that many items share makes no pairs of items."""
    names = {"items": F.count_distinct("item_key"), **measures}
    per = items.filter(F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("text_sha256"), "grade").agg(*[c.alias(n) for n, c in names.items()])
    first, second = (
        per.select("text_sha256", *[F.col(name).alias(f"{side}_{name}") for name in ("grade", *names)]) for side in ("first", "second")
    )
    return first.join(second, "text_sha256").filter("first_grade < second_grade")


def percent_of_points(where: Column | None = None) -> Column:
    """100 * sum(points) / sum(max_points) of the rows that meet a condition, NULL if none does."""
    points, top = F.col("points"), F.col("max_points")
    if where is not None:
        points, top = F.when(where, points), F.when(where, top)
    return F.try_divide(100 * F.sum(points), F.sum(top))


def credit_class(score, scaled_points) -> Column:
    return F.when(F.col(score) == F.col(scaled_points), "full credit").when(F.col(score) == 0, "no credit").otherwise("partial credit")


def quantile_bins(items: DataFrame, rows: DataFrame, value: str, bins: int, by: str, outcome: str) -> DataFrame:
    """Mean outcome per bin of items and ``by``. The edges are linear quantiles of the distinct items' values; bins are
    right-closed, the lowest edge included, and duplicate edges are dropped."""
    names = {f"q{i}": i / bins for i in range(bins + 1)}
    edges = quantiles(items.withColumn("_one", F.lit(1)), ["_one"], value, names)
    edges = edges.select("_one", F.array_distinct(F.array(*names)).alias("_edges"))
    below = F.size(F.filter(F.col("_edges"), lambda e: e < F.col(value)))
    binned = rows.filter(F.col(value).isNotNull()).withColumn("_one", F.lit(1)).join(F.broadcast(edges), "_one")
    return binned.withColumn("bin", F.greatest(below, F.lit(1))).groupBy("bin", by).agg(
        F.count("*").alias("n"), F.avg(outcome).alias("mean_outcome"), F.avg(value).alias("mean_value")
    )


def paired_rows(rows: DataFrame, pairs: DataFrame, condition: str, item: str = "item_key") -> DataFrame:
    """One row per pair of conditions (first, second) and item that both have, with both sides' points and full credit. The
    pairs are few; an item's rows meet by (condition, item), so no item and no pair is ever in one place."""
    sides = []
    for name, side in (("first", "a"), ("second", "b")):
        extra = ["max_points"] if side == "a" else []
        sides.append(rows.select(F.col(condition).alias(name), item, F.col("points").alias(f"points_{side}"), F.col("full_credit").alias(f"full_credit_{side}"), *extra))
    return pairs.select("first", "second").join(sides[0], "first").join(sides[1], ["second", item])


def adjacent_pairs(leaderboard: DataFrame, condition: str, score: str, model: str) -> DataFrame:
    """Each row of a leaderboard with the next, and all pairs of one model in leaderboard order, each pair once. A
    leaderboard has one row per condition."""
    order = Window.orderBy(F.desc(score), condition)
    placed = leaderboard.withColumn("place", F.row_number().over(order))
    following = placed.select(
        F.col(condition).alias("first"), F.lead(condition).over(order).alias("second")
    ).filter("second is not null")
    other = placed.select(F.col(condition).alias("second"), F.col(model).alias("_m"), F.col("place").alias("_p"))
    same = placed.join(other, (F.col(model) == F.col("_m")) & (F.col("place") < F.col("_p"))).select(F.col(condition).alias("first"), "second")
    return same.unionByName(following).dropDuplicates(["first", "second"])


def linked_constants(common: DataFrame, groups: list[str], old: str, new: str) -> DataFrame:
    """Mean-sigma linking of common items' locations: new = k * old + m."""
    stats = common.groupBy(*groups).agg(
        F.avg(old).alias("_mo"), F.avg(new).alias("_mn"), F.stddev_samp(old).alias("_so"), F.stddev_samp(new).alias("_sn"), F.count("*").alias("common_items")
    )
    k = F.try_divide(F.col("_sn"), F.col("_so"))
    return stats.select(*groups, "common_items", k.alias("k"), (F.col("_mn") - k * F.col("_mo")).alias("m"))

