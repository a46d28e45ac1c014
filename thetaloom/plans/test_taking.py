"""Scoring of answers, item response functions, and the tables of test-taking conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thetaloom.functions.irt import ItemModel
from thetaloom.functions.stats import normal_cdf
from thetaloom.operators import records as D
from thetaloom.operators import testtaking as T
from thetaloom.operators.ability import estimate_theta
from thetaloom.operators.bootstrap import bootstrap_interval
from thetaloom.operators.curves import log_probability_totals
from thetaloom.operators.errors import correlations
from thetaloom.operators.reporting import largest_calibration
from thetaloom.operators.usage import condition_usage
from thetaloom.plans import sqltext as S
from thetaloom.plans.abilities import KEYS, estimates, overall
from thetaloom.plans.prediction import rounded
from thetaloom.plans.registry import query
from thetaloom.session import written
from thetaloom.sources.tables import Tables

ITEMS_SQL = """
select concat('P', cast(p_partkey as varchar(20))) as item_key, case when p_partkey % 10 < 6 then 'multiple_choice' else 'constructed_response' end as item_type,
       substr('ABCD', cast(1 + p_partkey % 4 as int), 1) as correct_option, case when p_partkey % 10 >= 8 then 2 else 1 end as max_points from part"""
VERDICTS_SQL = """
select item_key, answer, max(category) as category from v_answers
where item_type = 'constructed_response' and trim(answer) <> '' and category is not null group by 1, 2"""
TAKERS, STUDENTS = list(range(5)), list(range(5, 10))


def answers(t: Tables) -> DataFrame:
    return t.v_answers.select("condition_id", "item_key", "l_orderkey", "l_linenumber", "answer")


def item_level(t: Tables) -> DataFrame:
    """The scored items of every condition, written once for the tables that read it several times."""
    return written(t.v_item_level, "item_level")


# --- scoring --------------------------------------------------------------------------------------------------------


@query(
    "c9_score_answers",
    """select a.condition_id, a.item_key, a.l_orderkey, a.l_linenumber, a.answer, category as scorer_category, points,
       case when points is null or scaled_points = max_points then points when points = max_points then 1 else 0 end as score from (
       select a.*, i.scaled_points, m.max_points, case when m.item_type = 'multiple_choice' then null when trim(a.answer) = '' then '(no response)' else v.category end as category,
       case when m.item_type = 'multiple_choice' then case when a.answer = m.correct_option then 1 else 0 end when trim(a.answer) = '' then 0
            when v.category like 'Incorrect%' then 0 when v.category like 'Partial%' then m.max_points - 1 when v.category like 'Correct%' then m.max_points end as points
       from (select condition_id, item_key, l_orderkey, l_linenumber, answer from v_answers) a join o_items m on a.item_key = m.item_key join v_items i on a.item_key = i.item_key
       left join o_verdicts v on a.item_key = v.item_key and a.answer = v.answer and m.item_type = 'constructed_response') a""",
    {"o_items": ITEMS_SQL, "o_verdicts": VERDICTS_SQL},
)
def score_answers(t: Tables) -> DataFrame:
    verdicts = t.sql(VERDICTS_SQL).select(
        "item_key", F.sha2("answer", 256).alias("response_hash"), F.lit(None).cast("string").alias("part"), "category", F.lit("why").alias("reasoning")
    )
    scores = T.score_answers(answers(t), t.sql(ITEMS_SQL), t.v_items, verdicts)
    return scores.select("condition_id", "item_key", "l_orderkey", "l_linenumber", "answer", "scorer_category", "points", "score")


@query(
    "c13_verdict_requests",
    "select item_key, answer as response, count(*) as answers from v_answers where item_type = 'constructed_response' and trim(answer) <> '' group by 1, 2",
)
def verdict_requests(t: Tables) -> DataFrame:
    return T.verdict_requests(answers(t), t.sql(ITEMS_SQL), t.v_items).select("item_key", "response", "answers")


# --- item models ----------------------------------------------------------------------------------------------------


@query("g1_category_probabilities", f"select item_key, th as theta, round({S.probability('th', 0)}, 9) as p0, round({S.probability('th', 1)}, 9) as p1, round({S.probability('th', 2)}, 9) as p2 from v_items cross join (values (-1e0), (0e0), (15e-1)) g(th)")
def category_probabilities(t: Tables) -> DataFrame:
    rows = t.v_items.withColumn("theta", F.explode(F.array(F.lit(-1.0), F.lit(0.0), F.lit(1.5))))
    p = ItemModel().probabilities("theta")
    return rounded(rows.select("item_key", "theta", p[0].alias("p0"), p[1].alias("p1"), p[2].alias("p2")), 9)


@query("g2_expected_score", f"select item_key, round({S.expected('5e-1')}, 9) as expected_score from v_items")
def expected_score(t: Tables) -> DataFrame:
    return t.v_items.select("item_key", F.round(ItemModel().expected_score(0.5), 9).alias("expected_score"))


@query("g3_test_information", f"select calibration, g, round(sum({S.information('(-3e0 + g * 5e-1)')}), 6) as information from v_items cross join range(0, 13) t(g) group by 1, 2")
def test_information(t: Tables) -> DataFrame:
    rows = T.with_grid(t.v_items, -3.0, 3.0, 0.5)
    return rounded(rows.groupBy("calibration", F.col("_g").alias("g")).agg(F.sum(ItemModel().information("theta")).alias("information")))


@query(
    "g4_log_probability_grid",
    f"""select calibration, score, g, round(sum(ln(greatest(case score when 0 then {S.probability('(-6e0 + g * 1e-2)', 0)} when 1 then {S.probability('(-6e0 + g * 1e-2)', 1)} else {S.probability('(-6e0 + g * 1e-2)', 2)} end, 1e-300))), 5) as total,
        count(*) as items from v_items cross join range(0, 1201) t(g) join (values (0), (1), (2)) k(score) on score <= scaled_points group by 1, 2, 3""",
)
def log_probability_grid(t: Tables) -> DataFrame:
    """The grid of ln P summed over the items of each calibration, at all 1,201 abilities."""
    return rounded(log_probability_totals(t.v_items, ["calibration"]).select("calibration", "score", "g", "total", "items"), 5)


@query("g7_person_fit", f"""select respondent, calibration, count(*) as items, round((sum(lo) - sum(mean)) / sqrt(sum(square - mean * mean)), 5) as l_z from (
    select respondent, calibration, ln(greatest(po, 1e-300)) as lo, p0 * ln(greatest(p0, 1e-300)) + p1 * ln(greatest(p1, 1e-300)) + p2 * ln(greatest(p2, 1e-300)) as mean,
    p0 * pow(ln(greatest(p0, 1e-300)), 2) + p1 * pow(ln(greatest(p1, 1e-300)), 2) + p2 * pow(ln(greatest(p2, 1e-300)), 2) as square from (
    select r.respondent, r.calibration, {S.observed('theta_eap', 'r.')} as po, {S.probability('theta_eap', 0, 'r.')} as p0, {S.probability('theta_eap', 1, 'r.')} as p1, coalesce({S.probability('theta_eap', 2, 'r.')}, 0e0) as p2
    from v_responses r join o_eap e on r.respondent = e.respondent and r.calibration = e.calibration) x) y group by 1, 2""", S.THETA)
def person_fit(t: Tables) -> DataFrame:
    responses = written(t.v_responses, "responses")
    return rounded(T.person_fit(responses, estimates(t, responses=responses), KEYS), 5)


@query("g8_percentile", f"select respondent, calibration, round(1e2 * ({S.normal_cdf('theta_eap')}), 4) as percentile from o_eap", S.THETA)
def percentile(t: Tables) -> DataFrame:
    return estimates(t).select(*KEYS, F.round(100 * normal_cdf(F.col("theta_eap")), 4).alias("percentile"))


NUMERIC_SQL = " + ".join(
    f"coalesce(pow(({S.probability('(th + 1e-5)', k)} - {S.probability('(th - 1e-5)', k)}) / 2e-5, 2) / {S.probability('th', k)}, 0e0)" for k in range(3)
)


@query(
    "g9_model_checks",
    f"""select item_key, round(sum({S.information('th')}), 4) as information, round(sum({NUMERIC_SQL}), 4) as numeric_information,
        max(abs({S.information('th')} - ({NUMERIC_SQL}))) < 1e-4 as passes from v_items cross join (select -4e0 + g * 1e-1 as th from range(0, 81) r(g)) t group by 1""",
)
def model_checks(t: Tables) -> DataFrame:
    """Every item against the definition of its model at 81 abilities."""
    return rounded(T.model_checks(t.v_items).select("item_key", "information", "numeric_information", "passes"), 4)


PERCENT_SQL = "select i.*, case when p_size % 9 <> 0 then round(p_retailprice / 1e1 - 5e1 + p_size, 4) end as percent_correct from v_items i join part on pk = p_partkey"


@query(
    "e31_implied_percent_correct",
    f"""select calibration, count(*) as items, round({S.guarded_corr('implied', 'percent_correct')}, 6) as correlation, round(avg(implied), 5) as mean_implied, round(avg(percent_correct), 5) as mean_observed,
        coalesce({S.guarded_corr('implied', 'percent_correct')} >= 8e-1, false) as agrees from (
        select item_key, calibration, percent_correct, 1e2 * sum({S.correct('(-6e0 + g * 1e-2)')} * exp(-pow(-6e0 + g * 1e-2, 2) / 2e0)) / sum(exp(-pow(-6e0 + g * 1e-2, 2) / 2e0)) as implied
        from o_percent cross join range(0, 1201) t(g) where irt_model <> 'GPCM' and percent_correct is not null group by 1, 2, 3) x group by 1""",
    {"o_percent": PERCENT_SQL},
)
def implied_percent_correct(t: Tables) -> DataFrame:
    table = T.implied_percent_correct(t.sql(PERCENT_SQL), ["calibration"])
    return table.select("calibration", "items", F.round("correlation", 6).alias("correlation"), F.round("mean_implied", 5).alias("mean_implied"), F.round("mean_observed", 5).alias("mean_observed"), "agrees")


SCALES_SQL = """
select concat(p_brand, '/', p_type) as scale, cast(floor(p_size / 5e0) as int) as position, max(case when p_name like 'green%' and p_size > 40 then concat('low (', p_name, ')') when p_size % 7 = 6 then cast(-p_size as varchar(9)) else concat(cast(p_size / 1e1 as varchar(9)), ' (', p_name, ')') end) as criterion
from part group by 1, 2"""


@query(
    "g12_value_scale_checks",
    """select scale, case when n < 2 or n > 10 then 'needs 2 to 10 criteria' when bad > 0 then 'a criterion does not start with its value' when falling > 0 then 'values do not increase' end as rule from (
       select scale, count(*) as n, sum(case when v is null then 1 else 0 end) as bad, sum(case when v <= before then 1 else 0 end) as falling from (
       select *, lag(v) over (partition by scale order by position) as before from (select *, try_cast(split_part(criterion, ' ', 1) as double) as v from o_scales) x) y group by scale) z
       where n < 2 or n > 10 or bad > 0 or falling > 0""",
    {"o_scales": SCALES_SQL},
)
def value_scale_checks(t: Tables) -> DataFrame:
    from thetaloom.operators.validation import scale_violations

    return scale_violations(t.sql(SCALES_SQL))


@query(
    "g13_scale_constants_algebra",
    """select s.calibration, plausible_value, round(k, 6) as k, round(m, 6) as m, round(a + b * m, 5) as linked_a, round(b * k, 6) as linked_b, abs(target_mean - (a + b * theta_mean)) <= 1e-2 as row_fits from (
       select calibration, plausible_value, target_mean, theta_mean, target_mean - target_sd / theta_sd * theta_mean as a, target_sd / theta_sd as b from v_constants where not use_for_scoring) s join (
       select calibration, stddev_samp(location * 9e-1 + slope / 1e1) / stddev_samp(location) as k, avg(location * 9e-1 + slope / 1e1) - stddev_samp(location * 9e-1 + slope / 1e1) / stddev_samp(location) * avg(location) as m
       from v_items group by calibration) l on s.calibration = l.calibration""",
)
def scale_constants_algebra(t: Tables) -> DataFrame:
    """Constants of the bridge rows carried over a mean-sigma link of common items."""
    common = t.v_items.withColumn("new", F.col("location") * 0.9 + F.col("slope") / 10)
    link = T.linked_constants(common, ["calibration"], "location", "new")
    b = F.col("target_sd") / F.col("theta_sd")
    a = F.col("target_mean") - b * F.col("theta_mean")
    rows = t.v_constants.filter("not use_for_scoring").join(link, "calibration")
    return rows.select(
        "calibration", "plausible_value", F.round("k", 6).alias("k"), F.round("m", 6).alias("m"), F.round(a + b * F.col("m"), 5).alias("linked_a"),
        F.round(b * F.col("k"), 6).alias("linked_b"), (F.abs(F.col("target_mean") - (a + b * F.col("theta_mean"))) <= 0.01).alias("row_fits"),
    )


# --- scores on the scale --------------------------------------------------------------------------------------------


@query(
    "c10_item_scores_on_scale",
    f"""select r.respondent, r.item_key, r.score, round(a + b * r.location, 5) as location_scale, round({S.observed('theta_eap', 'r.')}, 6) as probability_of_score,
        round({S.expected('theta_eap', 'r.')}, 6) as expected_score, round(r.score - {S.expected('theta_eap', 'r.')}, 6) as residual
        from v_responses r join o_eap e on r.respondent = e.respondent and r.calibration = e.calibration join v_scale s on r.calibration = s.calibration""",
    S.THETA,
)
def item_scores_on_scale(t: Tables) -> DataFrame:
    responses = written(t.v_responses, "responses")
    table = T.items_on_scale(responses, overall(t, responses=responses), KEYS)
    return table.select(
        "respondent", "item_key", "score", F.round("location_scale", 5).alias("location_scale"), F.round("probability_of_score", 6).alias("probability_of_score"),
        F.round("expected_score", 6).alias("expected_score"), F.round("residual", 6).alias("residual"),
    )


OVERALL = {
    **S.THETA,
    "o_overall": "select e.*, a + b * theta_eap as scale_eap from o_eap e join v_scale s on e.calibration = s.calibration",
}
CALIBRATIONS = [f"cal{i}-{j}" for i in range(3) for j in range(2)]


@query(
    "e16_condition_summary",
    """select respondent, cast(sum(items) as bigint) as items, cast(sum(points) as bigint) as points, cast(sum(max_points) as bigint) as max_points, round(1e2 * sum(points) / sum(max_points), 6) as percent_of_points,
       round(min(scale_eap), 5) as lowest_scale_eap, round(max(scale_eap), 5) as highest_scale_eap from o_overall group by respondent""",
    OVERALL,
)
def condition_summary(t: Tables) -> DataFrame:
    table = overall(t).groupBy("respondent").agg(
        *[F.sum(name).alias(name) for name in ("items", "points", "max_points")], T.percent_of_points().alias("percent_of_points"),
        F.min("scale_eap").alias("lowest_scale_eap"), F.max("scale_eap").alias("highest_scale_eap"),
    )
    return table.withColumns({n: F.round(n, d) for n, d in (("percent_of_points", 6), ("lowest_scale_eap", 5), ("highest_scale_eap", 5))})


@query("i5_score_table", f"""select respondent, {', '.join(f'''max(case when calibration = '{c}' then cast(round(theta_eap, 2) as varchar) || ' (' || cast(items as varchar) || ')' end) as "{c}" ''' for c in CALIBRATIONS)} from o_eap group by respondent""", S.THETA)
def score_table(t: Tables) -> DataFrame:
    """Any expression of an overall row, per respondent and calibration."""
    cell = F.concat(F.round("theta_eap", 2).cast("string"), F.lit(" ("), F.col("items").cast("string"), F.lit(")"))
    return D.pivoted(estimates(t), ["respondent"], "calibration", CALIBRATIONS, cell)


@query(
    "e14_calibration_table",
    """select i.calibration, assessments, items, points, round(a, 6) as a, round(b, 6) as b, constants from (
       select calibration, string_agg(distinct assessment, ', ' order by assessment) as assessments, count(*) as items, cast(sum(scaled_points) as bigint) as points from (
       select i.calibration, i.scaled_points, concat('Survey ', p_brand) as assessment from v_items i join part on pk = p_partkey) x group by calibration) i
       join v_scale s on i.calibration = s.calibration join (select calibration, min(split_part(method, ':', 1)) as constants from v_constants group by 1) c on i.calibration = c.calibration""",
)
def calibration_table(t: Tables) -> DataFrame:
    items = t.v_items.join(t.part.select(F.col("p_partkey").alias("pk"), F.concat(F.lit("Survey "), "p_brand").alias("assessment")), "pk")
    table = items.groupBy("calibration").agg(
        F.array_join(F.sort_array(F.collect_set("assessment")), ", ").alias("assessments"), F.count("*").alias("items"), F.sum("scaled_points").alias("points")
    )
    method = t.v_constants.groupBy("calibration").agg(F.min(F.split_part("method", F.lit(":"), F.lit(1))).alias("constants"))
    return rounded(table.join(t.v_scale.select("calibration", "a", "b"), "calibration").join(method, "calibration"))


# --- tables of conditions -------------------------------------------------------------------------------------------


@query(
    "e17_percent_of_points",
    """select condition_id, round(1e2 * sum(points) / sum(max_points), 6) as percent_of_points, round(1e2 * sum(case when grade = 4 then points end) / sum(case when grade = 4 then max_points end), 6) as grade_4,
       round(1e2 * sum(case when grade = 8 then points end) / sum(case when grade = 8 then max_points end), 6) as grade_8, round(1e2 * sum(case when grade = 12 then points end) / sum(case when grade = 12 then max_points end), 6) as grade_12
       from v_item_level group by 1""",
)
def percent_of_points(t: Tables) -> DataFrame:
    by_grade = [T.percent_of_points(F.col("grade") == g).alias(f"grade_{g}") for g in (4, 8, 12)]
    return rounded(t.v_item_level.groupBy("condition_id").agg(T.percent_of_points().alias("percent_of_points"), *by_grade))


ALL_ROWS = "select condition_id, item_key, points, max_points from v_item_level"
TAKER_ROWS = f"{ALL_ROWS} where role = 'test_taker'"


@query("f5_bootstrap_interval", "select condition_id, round(ci_low, 6) as ci_low, round(ci_high, 6) as ci_high from b_ci", S.bootstrap(ALL_ROWS, ["condition_id"]))
def bootstrap(t: Tables) -> DataFrame:
    return rounded(bootstrap_interval(t.v_item_level, ["condition_id"], "item_key", "points", "max_points"))


def _share(condition: str) -> str:
    return f"round(1e2 * sum(case when {condition} then points end) / sum(case when {condition} then max_points end), 6)"


LEVEL_LIKELIHOOD = f"""
select condition_id, calibration, g, -6e0 + g * 1e-2 as theta, sum({S.log_observed('(-6e0 + g * 1e-2)')}) as ll
from (select l.condition_id, l.calibration, l.points as score, i.irt_model, i.slope, i.location, i.guessing, i.step1, i.step2 from v_item_level l join v_items i on l.item_key = i.item_key where role = 'test_taker') r
cross join range(0, 1201) t(g) group by 1, 2, 3"""
USAGE = {
    "o_req": "select c_custkey as request_id, c_nationkey % 10 as condition from customer",
    "o_rec": """select user_id as request_id, case when user_id % 3 = 0 then concat('b', cast(user_id % 7 as varchar(3))) end as batch_id, count(*) * 10 as prompt_tokens, count(*) * 3 as completion_tokens,
        round(sum(value), 4) as cost_usd, max(case when event_type = 'view' then value end) as seconds from events where event_type in ('view', 'click') group by user_id""",
    "o_bat": "select user_id % 10 as condition, user_id % 7 as batch, round(sum(value), 4) as cost_usd from events where event_type = 'purchase' group by 1, 2",
    "o_open": "select distinct user_id as request_id from events where event_type = 'error' and value > 5e1",
    "o_cond": "select condition_id as condition, provider, model, role, provider = 'router' as reports_cost, false as local from v_conditions",
    "o_price": "select distinct provider, model, 1e-1 as input_price, 5e-1 as output_price from v_conditions where model not like '%3'",
}


def usage(t: Tables) -> DataFrame:
    return condition_usage(*[t.sql(USAGE[name]) for name in ("o_req", "o_rec", "o_bat", "o_open", "o_cond", "o_price")])


LEADERBOARD = {
    **S.bootstrap(TAKER_ROWS, ["condition_id"]),
    "o_lev": LEVEL_LIKELIHOOD,
    "o_range": """select condition_id, min(a + b * eap) as lowest, max(a + b * eap) as highest from (select condition_id, calibration, sum(w * theta) / sum(w) as eap from (
        select *, exp(ll - max(ll) over (partition by condition_id, calibration) - theta * theta / 2e0) as w from o_lev) x group by 1, 2) y join v_scale s on y.calibration = s.calibration group by 1""",
    "o_board": f"""select l.condition_id, l.model, {_share('true')} as percent_of_points, {_share('grade = 4')} as grade_4, {_share('grade = 8')} as grade_8, {_share('grade = 12')} as grade_12,
        {_share("item_type = 'multiple_choice'")} as multiple_choice, {_share("item_type = 'constructed_response'")} as constructed_response, {_share('has_figure')} as with_figure, {_share('not has_figure')} as without_figure
        from v_item_level l where role = 'test_taker' group by 1, 2""",
    **USAGE,
    "o_cost": """select c.condition, s.mean_out as output_tokens_per_unit, case when reports_cost then reported else (tin * input_price + tout * output_price) / 1e6 end + coalesce(batch_cost, 0e0) as cost_usd
        from (select c.*, p.input_price, p.output_price from o_cond c left join o_price p on c.provider = p.provider and c.model = p.model) c join (
        select condition, avg(completion_tokens) as mean_out, sum(case when batch_id is null and prompt_tokens is not null then cost_usd else 0e0 end) as reported,
        sum(case when batch_id is null then coalesce(prompt_tokens, 0) else 0 end) as tin, sum(case when batch_id is null then coalesce(completion_tokens, 0) else 0 end) as tout
        from o_req q left join o_rec r on q.request_id = r.request_id group by condition) s on c.condition = s.condition
        left join (select condition, sum(cost_usd) as batch_cost from o_bat group by condition) b on c.condition = b.condition""",
}


def leaderboard_table(t: Tables) -> DataFrame:
    takers = written(t.v_item_level.filter("role = 'test_taker'"), "takers")
    shares = {
        "percent_of_points": None,
        **{f"grade_{g}": F.col("grade") == g for g in (4, 8, 12)},
        **{kind: F.col("item_type") == kind for kind in ("multiple_choice", "constructed_response")},
        "with_figure": F.col("has_figure"),
        "without_figure": ~F.col("has_figure"),
    }
    board = takers.groupBy("condition_id", "model").agg(*[T.percent_of_points(where).alias(name) for name, where in shares.items()])
    parameters = t.v_items.select("item_key", "slope", "location", "guessing", "step1", "step2", "step3")
    responses = takers.withColumn("score", F.col("points")).join(parameters, "item_key")
    scale = estimate_theta(responses, ["condition_id", "calibration"], max_group_rows=largest_calibration(t.v_items)).join(t.v_scale, "calibration")
    score = F.col("a") + F.col("b") * F.col("theta_eap")
    ranges = scale.groupBy("condition_id").agg(F.min(score).alias("lowest_scale_eap"), F.max(score).alias("highest_scale_eap"))
    intervals = bootstrap_interval(takers, ["condition_id"], "item_key", "points", "max_points")
    spent = usage(t).select(
        F.col("condition").alias("condition_id"), (F.col("direct_cost_usd") + F.col("batch_cost_usd")).alias("cost_usd"),
        F.col("mean_completion_tokens").alias("output_tokens_per_unit"),
    )
    board = board.join(intervals, "condition_id").join(ranges, "condition_id").join(spent, "condition_id", "left")
    return board.orderBy(F.desc("percent_of_points"), "condition_id")


@query(
    "e18_leaderboard",
    """select o.*, round(ci_low, 6) as ci_low, round(ci_high, 6) as ci_high, round(lowest, 5) as lowest_scale_eap, round(highest, 5) as highest_scale_eap,
       round(cost_usd, 4) as cost_usd, round(output_tokens_per_unit, 6) as output_tokens_per_unit
       from o_board o join b_ci c on o.condition_id = c.condition_id join o_range r on o.condition_id = r.condition_id left join o_cost u on o.condition_id = u.condition""",
    LEADERBOARD,
)
def leaderboard(t: Tables) -> DataFrame:
    board = leaderboard_table(t)
    digits = {"lowest_scale_eap": 5, "highest_scale_eap": 5, "cost_usd": 4}
    return rounded(board.withColumns({name: F.round(name, n) for name, n in digits.items()}))


PER_ITEM_SQL = """select item_key, max(percent_correct) as percent_correct, max(case when has_figure then 1e0 else 0e0 end) as figure, cast(sum(full_credit) as bigint) as with_full_credit, count(*) as conditions
    from v_item_level where role = 'test_taker' and percent_correct is not null group by item_key"""


def per_item(t: Tables) -> DataFrame:
    rows = t.v_item_level.filter("role = 'test_taker' and percent_correct is not null")
    return rows.groupBy("item_key").agg(
        F.max("percent_correct").alias("percent_correct"), F.max(F.col("has_figure").cast("double")).alias("figure"),
        F.sum("full_credit").alias("with_full_credit"), F.count("*").alias("conditions"),
    )


@query("e19_per_item_outcome", "select with_full_credit, count(*) as items, round(avg(percent_correct), 6) as percent_correct, round(avg(figure), 6) as share_with_figure from o_item group by 1", {"o_item": PER_ITEM_SQL})
def per_item_outcome(t: Tables) -> DataFrame:
    return rounded(per_item(t).groupBy("with_full_credit").agg(F.count("*").alias("items"), F.avg("percent_correct").alias("percent_correct"), F.avg("figure").alias("share_with_figure")))


@query("e19_easy_but_missed", "select item_key, percent_correct, with_full_credit, conditions from o_item where percent_correct >= 6e1 and with_full_credit <= conditions / 2e0", {"o_item": PER_ITEM_SQL})
def easy_but_missed(t: Tables) -> DataFrame:
    """Items easy for people that at least half of the conditions missed, easiest first."""
    found = per_item(t).filter((F.col("percent_correct") >= 60) & (F.col("with_full_credit") <= F.col("conditions") / 2))
    return found.select("item_key", "percent_correct", "with_full_credit", "conditions").orderBy(F.desc("percent_correct"), "item_key")


@query("e19_rank_correlation", f"select count(*) as pairs, round({S.guarded_corr('a', 'b')}, 6) as spearman from (select {S.average_rank('with_full_credit', '1')} as a, {S.average_rank('percent_correct', '1')} as b from o_item) x", {"o_item": PER_ITEM_SQL})
def rank_correlation(t: Tables) -> DataFrame:
    table = per_item(t).withColumns({"all": F.lit("all"), "with_full_credit": F.col("with_full_credit").cast("double")})
    return rounded(correlations(table, ["all"], "with_full_credit", "percent_correct").select("pairs", "spearman"))


@query(
    "e20_grade_table",
    """select 'people' as source, round(avg(case when grade = 4 then p end), 7) as grade_4, round(avg(case when grade = 8 then p end), 7) as grade_8, round(avg(case when grade = 12 then p end), 7) as grade_12
       from (select item_key, grade, max(percent_correct) as p from v_item_level where role = 'student' and percent_correct is not null group by 1, 2) x
       union all select cast(condition_id as varchar), round(1e2 * avg(case when grade = 4 then full_credit end), 7), round(1e2 * avg(case when grade = 8 then full_credit end), 7), round(1e2 * avg(case when grade = 12 then full_credit end), 7)
       from v_item_level where role = 'student' and percent_correct is not null group by condition_id""",
)
def grade_table(t: Tables) -> DataFrame:
    rows = t.v_item_level.filter("role = 'student' and percent_correct is not null")
    people = rows.groupBy("item_key", "grade").agg(F.max("percent_correct").alias("p")).groupBy(F.lit("people").alias("source"))
    human = people.agg(*[F.avg(F.when(F.col("grade") == g, F.col("p"))).alias(f"grade_{g}") for g in (4, 8, 12)])
    credit = rows.groupBy(F.col("condition_id").cast("string").alias("source")).agg(
        *[(100 * F.avg(F.when(F.col("grade") == g, F.col("full_credit")))).alias(f"grade_{g}") for g in (4, 8, 12)]
    )
    return rounded(human.unionByName(credit), 7)


ROLE_ROWS = """select a.model, a.grade, a.item_key, b.points - a.points as points, b.max_points, a.points as taker, b.points as student from v_item_level a join v_item_level b
    on a.item_key = b.item_key and a.model = b.model and a.role = 'test_taker' and b.role = 'student'"""


@query(
    "e21_role_effect",
    """select r.model, r.grade, items, test_taker, student, difference, round(ci_low, 6) as ci_low, round(ci_high, 6) as ci_high from (
       select model, grade, count(*) as items, round(1e2 * sum(taker) / sum(max_points), 6) as test_taker, round(1e2 * sum(student) / sum(max_points), 6) as student, round(1e2 * sum(points) / sum(max_points), 6) as difference
       from o_role group by 1, 2) r join b_ci c on r.model = c.model and r.grade = c.grade""",
    {"o_role": ROLE_ROWS, **S.bootstrap("select * from o_role", ["model", "grade"])},
)
def role_effect(t: Tables) -> DataFrame:
    """Both roles of a model on the items with both, paired: the roles of an item meet in one row."""
    both = t.v_item_level.groupBy("model", "grade", "item_key").agg(
        F.max(F.when(F.col("role") == "test_taker", F.col("points"))).alias("taker"),
        F.max(F.when(F.col("role") == "student", F.col("points"))).alias("student"),
        F.max("max_points").alias("max_points"),
    )
    both = written(both.filter("taker is not null and student is not null").withColumn("points", F.col("student") - F.col("taker")), "roles")
    share = lambda name: F.try_divide(100 * F.sum(name), F.sum("max_points"))
    table = both.groupBy("model", "grade").agg(F.count("*").alias("items"), share("taker").alias("test_taker"), share("student").alias("student"), share("points").alias("difference"))
    return rounded(table.join(bootstrap_interval(both, ["model", "grade"], "item_key", "points", "max_points"), ["model", "grade"]))


@query(
    "e22_alignment",
    f"""select model, max(case when role = 'test_taker' then s end) as test_taker, max(case when role = 'student' then s end) as student from (
        select model, role, round({S.guarded_corr('a', 'b')}, 6) as s from (select model, role, {S.average_rank('full_credit', 'model, role')} as a, {S.average_rank('percent_correct', 'model, role')} as b
        from v_item_level where percent_correct is not null) x group by 1, 2) y group by model""",
)
def alignment(t: Tables) -> DataFrame:
    rows = t.v_item_level.withColumn("full_credit", F.col("full_credit").cast("double"))
    table = correlations(rows, ["model", "role"], "full_credit", "percent_correct")
    return rounded(D.pivoted(table, ["model"], "role", ["test_taker", "student"], F.col("spearman")))


BIN_EDGES = "select " + ", ".join(f"quantile_cont(p, {i}e-1) as q{i}" for i in range(11)) + " from (select item_key, max(percent_correct) as p from v_item_level where percent_correct is not null group by 1) x"


@query(
    "e23_quantile_bins",
    f"""select cast(greatest(1, {' + '.join(f'case when q{i} < p and (q{i} > q{i - 1}) then 1 else 0 end' if i else 'case when q0 < p then 1 else 0 end' for i in range(11))}) as int) as bin, condition_id, count(*) as n,
        round(avg(full_credit), 6) as mean_outcome, round(avg(p), 6) as mean_value from (select condition_id, full_credit, percent_correct as p from v_item_level where percent_correct is not null) l cross join o_edges group by 1, 2""",
    {"o_edges": BIN_EDGES},
)
def quantile_bins(t: Tables) -> DataFrame:
    rows = item_level(t)
    items = rows.filter("percent_correct is not null").groupBy("item_key").agg(F.max("percent_correct").alias("percent_correct"))
    return rounded(T.quantile_bins(items, rows, "percent_correct", 10, "condition_id", "full_credit"))


@query("e32_credit_classes", "select condition_id, case when points = scaled_points then 'full credit' when points = 0 then 'no credit' else 'partial credit' end as credit, count(*) as n from v_item_level group by 1, 2")
def credit_classes(t: Tables) -> DataFrame:
    return t.v_item_level.groupBy("condition_id", T.credit_class("points", "scaled_points").alias("credit")).agg(F.count("*").alias("n"))


@query(
    "c17_same_text_two_grades",
    """select a.item_key as first_key, b.item_key as second_key, max(a.grade) as first_grade, max(b.grade) as second_grade, """
    + ", ".join(
        f"""concat(coalesce(cast(max(case when x.condition_id = {c} and x.item_key = a.item_key then full_credit end) as varchar), '-'), ' / ',
       coalesce(cast(max(case when x.condition_id = {c} and x.item_key = b.item_key then full_credit end) as varchar), '-')) as "{c}" """
        for c in STUDENTS
    )
    + """ from v_items a join v_items b on b.pk = a.pk + 1 left join (select * from v_item_level where role = 'student') x on x.item_key in (a.item_key, b.item_key) group by 1, 2""",
)
def same_text_two_grades(t: Tables) -> DataFrame:
    """Pairs of copies (each item and the next stand for them) with both credits of every student condition."""
    students = t.v_item_level.filter("role = 'student'")
    credit = D.pivoted(students, ["item_key"], "condition_id", STUDENTS, F.col("full_credit").cast("string"))
    items = t.v_items.select("item_key", "pk", "grade").join(credit, "item_key", "left")
    second = items.select((F.col("pk") - 1).alias("pk"), *[F.col(f"`{n}`").alias(f"second_{n}") for n in ("item_key", "grade", *map(str, STUDENTS))])
    shown = [
        F.concat(F.coalesce(F.col(f"`{c}`"), F.lit("-")), F.lit(" / "), F.coalesce(F.col(f"second_{c}"), F.lit("-"))).alias(str(c)) for c in STUDENTS
    ]
    return items.join(second, "pk").select(F.col("item_key").alias("first_key"), F.col("second_item_key").alias("second_key"), F.col("grade").alias("first_grade"), "second_grade", *shown)


REPEATED_SQL = "select item_key, grade, concat(p_brand, ' ', p_type) as text, case when p_size % 9 <> 0 then round(p_retailprice / 1e1 - 5e1 + p_size, 4) end as percent_correct from v_items join part on pk = p_partkey"
CREDIT = {
    "o_text": REPEATED_SQL,
    "o_grade": f"""select text, grade, count(*) as items, round(avg(percent_correct), 12) as human, {', '.join(f'sum(s{c}) / nullif(sum(n{c}), 0) as c{c}' for c in STUDENTS)} from o_text t left join (
        select item_key, {', '.join(f'sum(case when condition_id = {c} then full_credit * 1e0 end) as s{c}, count(case when condition_id = {c} then 1 end) as n{c}' for c in STUDENTS)} from v_item_level where role = 'student' group by 1) x
        on t.item_key = x.item_key group by 1, 2""",
}


@query(
    "c17_repeated_texts",
    f"""select sha256(a.text) as text_sha256, a.grade as first_grade, b.grade as second_grade, a.items as first_items, b.items as second_items, round(a.human, 6) as first_percent_correct, round(b.human, 6) as second_percent_correct,
        {', '.join(f'round(a.c{c}, 6) as first_{c}, round(b.c{c}, 6) as second_{c}' for c in STUDENTS)} from o_grade a join o_grade b on a.text = b.text and a.grade < b.grade""",
    CREDIT,
)
def repeated_texts(t: Tables) -> DataFrame:
    """Texts that items of several grades share, with the human percent and each student condition's share of full credit at
    either grade. Items with the same text are parts of one brand and type."""
    credit = t.v_item_level.filter("role = 'student'").groupBy("item_key").agg(
        *[f(F.when(F.col("condition_id") == c, F.col("full_credit"))).alias(f"{n}{c}") for c in STUDENTS for n, f in (("s", F.sum), ("n", F.count))]
    )
    items = t.sql(REPEATED_SQL).join(credit, "item_key", "left")
    # To 12 digits first, so that the order of summation does not decide how a mean in the middle is rounded.
    measures = {"percent_correct": F.round(F.avg("percent_correct"), 12), **{str(c): F.sum(f"s{c}") / F.nullif(F.sum(f"n{c}"), F.lit(0)) for c in STUDENTS}}
    return rounded(T.texts_at_two_grades(items, "text", measures))


BOARD_SQL = f"select condition_id, model, {_share('true')} as s from v_item_level where role = 'test_taker' group by 1, 2"


@query(
    "h8_leaderboard_pairs",
    """select distinct first, second from (select condition_id as first, lead(condition_id) over (order by s desc, condition_id) as second from o_board
       union all select a.condition_id, b.condition_id from o_board a join o_board b on a.model = b.model and (a.s > b.s or (a.s = b.s and a.condition_id < b.condition_id))) x where second is not null""",
    {"o_board": BOARD_SQL.replace("condition_id, model,", "condition_id, substr(model, 1, 7) as model,")},
)
def leaderboard_pairs(t: Tables) -> DataFrame:
    board = t.v_item_level.filter("role = 'test_taker'").groupBy("condition_id", F.substring("model", 1, 7).alias("model")).agg(F.round(T.percent_of_points(), 6).alias("s"))
    return T.adjacent_pairs(board, "condition_id", "s", "model")


PAIRS = {
    "o_board": BOARD_SQL.replace("condition_id, model,", "condition_id, substr(model, 1, 7) as model,"),
    "o_pairs": """select distinct first, second from (select condition_id as first, lead(condition_id) over (order by s desc, condition_id) as second from o_board
        union all select a.condition_id, b.condition_id from o_board a join o_board b on a.model = b.model and (a.s > b.s or (a.s = b.s and a.condition_id < b.condition_id))) x where second is not null""",
    "o_pair": """select first, second, a.item_key, a.points - b.points as points, a.max_points, a.full_credit as fa, b.full_credit as fb from o_pairs
        join v_item_level a on a.condition_id = first join v_item_level b on b.condition_id = second and a.item_key = b.item_key""",
}


@query(
    "c16_paired_conditions",
    """select x.first, x.second, items, difference, round(ci_low, 6) as ci_low, round(ci_high, 6) as ci_high, only_first, only_second from (
       select first, second, count(*) as items, round(1e2 * sum(points) / sum(max_points), 6) as difference,
       count(case when fa = 1 and fb = 0 then 1 end) as only_first, count(case when fa = 0 and fb = 1 then 1 end) as only_second from o_pair group by 1, 2) x
       join b_ci c on x.first = c.first and x.second = c.second""",
    {**PAIRS, **S.bootstrap("select * from o_pair", ["first", "second"])},
)
def paired_conditions(t: Tables) -> DataFrame:
    """Every pair that the leaderboard compares, on the items that both have: one table, one aggregation, one bootstrap."""
    pairs = written(T.paired_rows(t.v_item_level, leaderboard_pairs(t), "condition_id"), "pairs")
    pairs = pairs.withColumn("points", F.col("points_a") - F.col("points_b"))
    table = pairs.groupBy("first", "second").agg(
        F.count("*").alias("items"), F.try_divide(100 * F.sum("points"), F.sum("max_points")).alias("difference"),
        F.count_if(F.expr("full_credit_a = 1 and full_credit_b = 0")).alias("only_first"), F.count_if(F.expr("full_credit_a = 0 and full_credit_b = 1")).alias("only_second"),
    )
    return rounded(table.join(bootstrap_interval(pairs, ["first", "second"], "item_key", "points", "max_points"), ["first", "second"]))


@query(
    "i4_item_scores_wide",
    "select i.calibration, i.item_key, i.location, " + ", ".join(f'max(case when condition_id = {c} then points end) as "{c}"' for c in range(10)) + " from v_items i join v_item_level l on i.item_key = l.item_key group by 1, 2, 3",
)
def item_scores_wide(t: Tables) -> DataFrame:
    """Every answered item with each condition's score, by location within its calibration."""
    scores = D.pivoted(t.v_item_level, ["item_key"], "condition_id", list(range(10)), F.col("points"))
    return t.v_items.select("calibration", "item_key", "location").join(scores, "item_key").orderBy("calibration", "location", "item_key")


@query("i6_response_matrix", "select i.item_key, " + ", ".join(f'max(case when condition_id = {c} then points end) as "{c}"' for c in STUDENTS) + " from v_items i left join v_item_level l on i.item_key = l.item_key group by 1")
def response_matrix(t: Tables) -> DataFrame:
    """The synthetic response matrix with the students as columns: the items may be any number of rows."""
    scores = D.pivoted(t.v_item_level.filter("role = 'student'"), ["item_key"], "condition_id", STUDENTS, F.col("points"))
    return t.v_items.select("item_key").join(scores, "item_key", "left")


@query(
    "e12_usage_by_condition",
    """select c.condition, provider, model, role, units, answered_units, answered_in_batches, in_open_batches, round(mean_prompt_tokens, 6) as mean_prompt_tokens, round(mean_seconds, 6) as mean_seconds,
       round(case when reports_cost then reported else (tin * input_price + tout * output_price) / 1e6 end, 6) as direct_cost_usd, round(coalesce(batch_cost, 0e0), 4) as batch_cost_usd from (
       select c.*, p.input_price, p.output_price from o_cond c left join o_price p on c.provider = p.provider and c.model = p.model) c join (
       select condition, count(*) as units, count(prompt_tokens) as answered_units, count(batch_id) as answered_in_batches, count(o.request_id) as in_open_batches, avg(prompt_tokens) as mean_prompt_tokens, avg(seconds) as mean_seconds,
       sum(case when batch_id is null and prompt_tokens is not null then cost_usd else 0e0 end) as reported, sum(case when batch_id is null then coalesce(prompt_tokens, 0) else 0 end) as tin, sum(case when batch_id is null then coalesce(completion_tokens, 0) else 0 end) as tout
       from o_req q left join o_rec r on q.request_id = r.request_id left join o_open o on q.request_id = o.request_id group by condition) s on c.condition = s.condition
       left join (select condition, sum(cost_usd) as batch_cost from o_bat group by condition) b on c.condition = b.condition""",
    USAGE,
)
def usage_by_condition(t: Tables) -> DataFrame:
    table = usage(t)
    names = ["condition", "provider", "model", "role", "units", "answered_units", "answered_in_batches", "in_open_batches"]
    return table.select(
        *names, F.round("mean_prompt_tokens", 6).alias("mean_prompt_tokens"), F.round("mean_seconds", 6).alias("mean_seconds"),
        F.round("direct_cost_usd", 6).alias("direct_cost_usd"), F.round("batch_cost_usd", 4).alias("batch_cost_usd"),
    )
