"""Prediction errors of runs, their baselines, comparison, effects and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thetaloom.functions.posterior import posterior
from thetaloom.operators import comparison as C
from thetaloom.operators import errors as E
from thetaloom.operators import records as D
from thetaloom.operators.retrieval import references
from thetaloom.plans import sqltext as S
from thetaloom.plans.registry import query
from thetaloom.plans.retrieval import REFERENCES, bank
from thetaloom.session import written
from thetaloom.sources.tables import Tables

PARAMETERS = ["slope", "location", "guessing", "step1"]
RUNS = ["F-low", "F-high", "O-low", "O-high"]
FACTORS = {"status_level": ["F", "O"], "discount_level": ["low", "high"]}
IDS = ["run", "status_level", "discount_level", "item_key", "pk", "grade", "irt_model", "scaled_points", "part_group"]
COMPARED = ["run", "item_key", "grade", "parameter", "predicted", "calibrated", *C.BASELINES]
# The scale of each parameter.
SCALES = {
    "slope": [0.4, 0.6, 0.8, 1.0, 1.2, 1.4, 1.6, 1.8, 2.0],
    "location": [-2.0, -1.0, -0.5, 0.0, 0.2, 0.5, 0.8, 1.0, 1.5, 2.0],
    "guessing": [0.0, 0.1, 0.15, 0.2, 0.25, 0.4],
    "step1": [-3.0, -2.0, -1.5, -1.0, -0.5, 0.0, 1.0, 2.0],
}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double column rounded, so that the order of summation does not show."""
    return df.select(*[F.round(f"`{n}`", digits).alias(n) if kind == "double" else F.col(f"`{n}`") for n, kind in df.dtypes])


def errors(t: Tables) -> DataFrame:
    means = E.leave_one_out(t.v_items, PARAMETERS)
    found = E.reference_means(t.v_references, t.v_items, PARAMETERS).withColumnRenamed("target_key", "item_key")
    means = means.select("item_key", *[f"{p}_mean" for p in PARAMETERS]).hint("shuffle_hash")
    predictions = t.v_predictions.join(means, "item_key").join(found.hint("shuffle_hash"), "item_key", "left")
    return E.error_table(predictions, PARAMETERS, IDS)


def stacked(t: Tables) -> DataFrame:
    """The central fact table, written once: every comparison is one or two aggregations over it."""
    return written(C.stacked(written(errors(t).select(*COMPARED), "errors"), RUNS, reference_run=RUNS[0]), "stacked")


LONG = "select item_key, grade, irt_model, scaled_points, part_group, '{0}' as parameter, {0} as value from v_items where {0} is not null"
LOO = {
    "o_long": " union all ".join(LONG.format(p) for p in PARAMETERS),
    "o_loo": """select l.item_key, l.parameter, round((g.s - p.s) / nullif(g.n - p.n, 0), 12) as calibration_mean from o_long l
        join (select grade, irt_model, scaled_points, parameter, sum(value) as s, count(*) as n from o_long group by 1, 2, 3, 4) g
          on l.grade = g.grade and l.irt_model = g.irt_model and l.scaled_points = g.scaled_points and l.parameter = g.parameter
        join (select grade, irt_model, scaled_points, part_group, parameter, sum(value) as s, count(*) as n from o_long group by 1, 2, 3, 4, 5) p
          on l.grade = p.grade and l.irt_model = p.irt_model and l.scaled_points = p.scaled_points and l.part_group = p.part_group and l.parameter = p.parameter""",
    "o_ref": """select a.item_key, a.parameter, round(avg(b.value), 12) as reference_mean from v_references r join o_long a on a.item_key = r.target_key
        join o_long b on b.item_key = r.item_key and a.parameter = b.parameter and a.irt_model = b.irt_model and a.scaled_points = b.scaled_points group by 1, 2""",
}
ERRORS = {
    **LOO,
    "o_err": """select e.*, calibration_mean, reference_mean, predicted - calibrated as error from v_errors e
        join o_loo l on e.item_key = l.item_key and e.parameter = l.parameter left join o_ref r on e.item_key = r.item_key and e.parameter = r.parameter""",
}
STACKED = {
    **ERRORS,
    "o_common": "select item_key from v_errors group by item_key having count(distinct run) = 4",
    "o_stack": """select run, item_key, grade, parameter, predicted, calibrated, calibration_mean, reference_mean from o_err where item_key in (select item_key from o_common)
        union all select 'calibration_mean', item_key, grade, parameter, calibration_mean, calibrated, calibration_mean, reference_mean from o_err where run = 'F-low' and item_key in (select item_key from o_common)
        union all select 'reference_mean', item_key, grade, parameter, reference_mean, calibrated, calibration_mean, reference_mean from o_err where run = 'F-low' and item_key in (select item_key from o_common)""",
}


@query(
    "e1_error_table",
    """select run, item_key, grade, irt_model, parameter, round(predicted, 6) as predicted, round(calibrated, 6) as calibrated, round(error, 6) as error,
       round(calibration_mean, 6) as calibration_mean, round(reference_mean, 6) as reference_mean from o_err""",
    ERRORS,
)
def error_table(t: Tables) -> DataFrame:
    return rounded(errors(t).select("run", "item_key", "grade", "irt_model", "parameter", "predicted", "calibrated", "error", "calibration_mean", "reference_mean"))


@query("e2_leave_one_out_mean", "select item_key, parameter, round(calibration_mean, 6) as calibration_mean from o_loo where calibration_mean is not null", LOO)
def leave_one_out(t: Tables) -> DataFrame:
    means = E.leave_one_out(t.v_items, PARAMETERS)
    entries = [F.struct(F.lit(p).alias("parameter"), F.when(F.col(p).isNotNull(), F.col(f"{p}_mean")).alias("calibration_mean")) for p in PARAMETERS]
    return rounded(means.select("item_key", F.inline(F.array(*entries))).filter("calibration_mean is not null"))


@query("e3_reference_mean", "select item_key, round(avg(case when parameter = 'slope' then reference_mean end), 6) as slope_reference, round(avg(case when parameter = 'location' then reference_mean end), 6) as location_reference from o_ref group by item_key", LOO)
def reference_mean(t: Tables) -> DataFrame:
    found = E.reference_means(t.v_references, t.v_items, ["slope", "location"])
    return rounded(found.select(F.col("target_key").alias("item_key"), "slope_reference", "location_reference"))


@query(
    "e3_reference_mean_retrieved",
    """select target_key, round(avg(b.location), 6) as location_reference, count(*) as references_alike from o_refs r join v_bank a on r.target_key = a.item_key
       join v_bank b on r.item_key = b.item_key and a.irt_model = b.irt_model and a.scaled_points = b.scaled_points group by target_key""",
    REFERENCES,
)
def reference_mean_retrieved(t: Tables) -> DataFrame:
    """The reference mean over the items that hybrid search found."""
    found = E.reference_means(references(bank(t)), t.v_bank, ["location"])
    return rounded(found.withColumnRenamed("references", "references_alike"))


def _row_sql(p: str) -> str:
    return f"""round({p}_predicted, 6) as {p}_predicted, {p}_calibrated, round({p}_predicted - {p}_calibrated, 6) as {p}_error, round(abs({p}_predicted - {p}_calibrated), 6) as {p}_abs_error"""


@query(
    "e4_prediction_row",
    f"""select run, p.item_key, grade, irt_model, {', '.join(_row_sql(p) for p in PARAMETERS)}, n_similar_items, similar_item_ids
        from v_predictions p left join (select target_key, count(*) as n_similar_items, string_agg(item_key, ', ' order by first_place, item_key) as similar_item_ids
        from v_references group by target_key) r on p.item_key = r.target_key""",
)
def prediction_row(t: Tables) -> DataFrame:
    similar = t.v_references.groupBy(F.col("target_key").alias("item_key")).agg(
        F.count("*").alias("n_similar_items"), F.expr("listagg(item_key, ', ') within group (order by first_place, item_key)").alias("similar_item_ids")
    )
    columns = []
    for p in PARAMETERS:
        error = F.col(f"{p}_predicted") - F.col(f"{p}_calibrated")
        columns += [F.round(f"{p}_predicted", 6).alias(f"{p}_predicted"), F.col(f"{p}_calibrated"), F.round(error, 6).alias(f"{p}_error"), F.round(F.abs(error), 6).alias(f"{p}_abs_error")]
    return t.v_predictions.join(similar, "item_key", "left").select("run", "item_key", "grade", "irt_model", *columns, "n_similar_items", "similar_item_ids")


def _summary_sql(groups: str, source: str, baselines: tuple[str, ...] = ()) -> str:
    extra = "".join(f", round(avg(abs({b} - calibrated)), 6) as mae_{b}" for b in baselines)
    return f"""select {groups}, count(*) as items, round(avg(predicted - calibrated), 6) as mean_error, round(stddev_samp(predicted - calibrated), 6) as sd_error,
        round(avg(abs(predicted - calibrated)), 6) as mae, round(sqrt(avg((predicted - calibrated) * (predicted - calibrated))), 6) as rmse,
        round({S.guarded_corr('predicted', 'calibrated')}, 6) as pearson, round({S.guarded_corr('rp', 'rc')}, 6) as spearman{extra}
        from (select *, {S.average_rank('predicted', groups)} as rp, {S.average_rank('calibrated', groups)} as rc from ({source}) s where predicted is not null) r group by {groups}"""


TWICE = "select cast(grade as varchar(5)) as grade, parameter, predicted, calibrated, calibration_mean, reference_mean, run from {0} union all select 'all', parameter, predicted, calibrated, calibration_mean, reference_mean, run from {0}"


@query("e5_correlation", f"select run, parameter, pairs, round(pearson, 6) as pearson, round(spearman, 6) as spearman from (select run, parameter, count(*) as pairs, {S.guarded_corr('predicted', 'calibrated')} as pearson, {S.guarded_corr('rp', 'rc')} as spearman from (select *, {S.average_rank('predicted', 'run, parameter')} as rp, {S.average_rank('calibrated', 'run, parameter')} as rc from v_errors) r group by run, parameter) x")
def correlation(t: Tables) -> DataFrame:
    return rounded(E.correlations(t.v_errors, ["run", "parameter"], "predicted", "calibrated"))


@query("e6_error_summary", _summary_sql("grade, parameter", TWICE.format("o_err") + " ", C.BASELINES), ERRORS)
def error_summary(t: Tables) -> DataFrame:
    """By grade and parameter, and over all grades, of every run's predictions together."""
    return rounded(E.summarize(E.with_all(errors(t), "grade"), ["grade", "parameter"], C.BASELINES))


@query("e7_run_summary", _summary_sql("run, parameter", "select * from o_stack"), STACKED)
def run_summary(t: Tables) -> DataFrame:
    return rounded(E.summarize(stacked(t), ["run", "parameter"]))


ALL_RUNS = [*RUNS, *C.BASELINES]


def _mae_sql(groups: str, source: str) -> str:
    columns = ", ".join(f"""round(avg(case when run = '{r}' then abs(predicted - calibrated) end), 6) as "{r}" """ for r in ALL_RUNS)
    return f"select {groups}, cast(sum(case when run = 'F-low' then 1 else 0 end) as bigint) as items, {columns} from ({source}) s group by {groups}"


@query("e8_mae_table", _mae_sql("parameter", "select * from o_stack"), STACKED)
def mae_table(t: Tables) -> DataFrame:
    return rounded(E.mae_table(stacked(t), ["parameter"], ALL_RUNS))


@query("e8_mae_by_grade", _mae_sql("grade, parameter", TWICE.format("o_stack")), STACKED)
def mae_by_grade(t: Tables) -> DataFrame:
    return rounded(E.mae_table(E.with_all(stacked(t), "grade"), ["grade", "parameter"], ALL_RUNS))


@query(
    "e9_coverage",
    """select run, (select count(*) from v_items) as items, count(distinct item_key) as predicted, (select count(*) from v_items) - count(distinct item_key) as missing,
       (select count(*) from (select item_key from v_errors group by item_key having count(distinct run) = 4) c) as in_every_run from v_errors group by run""",
)
def coverage(t: Tables) -> DataFrame:
    """Items to predict, predicted, missing, and predicted by every run."""
    seen = t.v_errors.groupBy("run", "item_key").agg(F.lit(1).alias("one"))
    shared = C.common_items(t.v_errors, len(RUNS)).withColumn("shared", F.lit(1))
    items = t.v_items.count()
    counts = seen.join(shared, "item_key", "left").groupBy("run").agg(F.count("*").alias("predicted"), F.count("shared").alias("in_every_run"))
    return counts.select("run", F.lit(items).cast("bigint").alias("items"), "predicted", (items - F.col("predicted")).alias("missing"), "in_every_run")


@query(
    "e10_parameter_distribution",
    """select grade, irt_model, scaled_points, count(*) as items, round(avg(location), 3) as mean, round(stddev_samp(location), 3) as sd, round(min(location), 3) as min,
       round(quantile_cont(location, 1e-1), 3) as p10, round(quantile_cont(location, 5e-1), 3) as p50, round(quantile_cont(location, 9e-1), 3) as p90, round(max(location), 3) as max
       from v_items group by 1, 2, 3""",
)
def parameter_distribution(t: Tables) -> DataFrame:
    return E.distribution(t.v_items, E.SCORING, "location")


@query(
    "e10_distribution_left_out",
    """select a.item_key, count(*) as peers, round(avg(b.location), 3) as mean, round(stddev_samp(b.location), 3) as sd, round(min(b.location), 3) as min, round(quantile_cont(b.location, 1e-1), 3) as p10,
       round(quantile_cont(b.location, 5e-1), 3) as p50, round(quantile_cont(b.location, 9e-1), 3) as p90, round(max(b.location), 3) as max
       from v_items a join v_items b on a.grade = b.grade and a.irt_model = b.irt_model and a.scaled_points = b.scaled_points and a.part_group <> b.part_group group by 1""",
)
def distribution_left_out(t: Tables) -> DataFrame:
    """The summary each item's prediction is compared with, its part group left out."""
    return E.distribution_left_out(t.v_items, "location")


@query("c8_common_items", "select item_key from v_errors group by item_key having count(distinct run) = 4")
def common_items(t: Tables) -> DataFrame:
    return C.common_items(t.v_errors, len(RUNS))


@query("c18_runs_agree", "select item_key, parameter from v_errors group by 1, 2 having max(calibrated) - min(calibrated) > 1e-9 union all select item_key, parameter from v_errors where run = 'O-low' and pk % 7 = 0")
def runs_agree(t: Tables) -> DataFrame:
    """Disagreements, with a planted shift of some calibrated values of one run."""
    shifted = t.v_errors.withColumn("calibrated", F.expr("case when run = 'O-low' and pk % 7 = 0 then calibrated + 1e-2 else calibrated end"))
    alone = shifted.groupBy("item_key").agg(F.count_distinct("run").alias("n")).filter("n > 1")
    return C.disagreements(shifted.join(alone, "item_key", "left_semi")).select("item_key", "parameter")


@query("i1_stacked_runs", "select run, item_key, parameter, round(predicted, 6) as predicted, round(predicted - calibrated, 6) as error, round(abs(predicted - calibrated), 6) as abs_error from o_stack", STACKED)
def stacked_runs(t: Tables) -> DataFrame:
    return rounded(stacked(t).select("run", "item_key", "parameter", "predicted", "error", "abs_error"))


@query(
    "i2_stacked_conditions",
    """select status_level, discount_level, concat(status_level, ', ', discount_level) as condition, item_key, parameter, round(abs(predicted - calibrated), 6) as abs_error,
       item_key in (select item_key from v_errors group by item_key having count(distinct run) = 4) as in_all_conditions from v_errors""",
)
def stacked_conditions(t: Tables) -> DataFrame:
    rows = D.with_factors(t.v_errors.drop("run"), FACTORS, 4)
    return rounded(rows.select("status_level", "discount_level", "condition", "item_key", "parameter", "abs_error", "in_all_conditions"))


@query(
    "i3_wide_by_run",
    f"""select item_key, grade, parameter, round(calibrated, 6) as calibrated, {', '.join(f"round(max(case when run = '{RUNS[0]}' then {name} end), 6) as {name}" for name in C.BASELINES)},
        {', '.join(f'''round(max(case when run = '{r}' then predicted end), 6) as "predicted ({r})", round(max(case when run = '{r}' then predicted - calibrated end), 6) as "error ({r})" ''' for r in RUNS)}
        from o_err where item_key in (select item_key from o_common) group by item_key, grade, parameter, o_err.calibrated""",
    STACKED,
)
def wide_by_run(t: Tables) -> DataFrame:
    """The common items with the calibrated value, the baselines as the first run has them, and each run's value and error."""
    rows = written(errors(t).select(*COMPARED, "error"), "errors")
    common = rows.join(C.common_items(rows, len(RUNS)), "item_key", "left_semi")
    return rounded(C.wide(common, ["item_key", "grade", "parameter", "calibrated"], RUNS, first=tuple(C.BASELINES)))


@query("i7_stacked_predictions", "select run, item_key, grade, irt_model, round(slope_predicted, 6) as slope_predicted, round(location_predicted, 6) as location_predicted, prompt_tokens, cost_usd from v_predictions")
def stacked_predictions(t: Tables) -> DataFrame:
    """The runs' wide rows without the long text columns they may carry."""
    predictions = t.v_predictions.withColumn("user_prompt", F.lit("long")).drop("system_prompt", "user_prompt", "state", "questions", "similar_items")
    return rounded(predictions.select("run", "item_key", "grade", "irt_model", "slope_predicted", "location_predicted", "prompt_tokens", "cost_usd"))


SETTINGS_SQL = """
select condition_id, 'llm.model' as setting, concat('"', model, '"') as value from v_conditions
union all select condition_id, 'llm.effort', coalesce('"' || effort || '"', 'null') from v_conditions
union all select condition_id, 'evaluation.role', concat('"', role, '"') from v_conditions
union all select condition_id, 'evaluation.order', cast(condition_id as varchar) from v_conditions"""


def settings(t: Tables) -> DataFrame:
    nested = t.v_conditions.select(
        "condition_id", F.struct("model", "effort").alias("llm"), F.struct("role", F.col("condition_id").alias("order")).alias("evaluation")
    )
    return D.setting_rows(nested, "condition_id")


@query("b16_flat_settings", f"select * from ({SETTINGS_SQL}) s")
def flat_settings(t: Tables) -> DataFrame:
    return settings(t)


@query("i8_settings_matrix", f"""select setting, {', '.join(f'max(case when condition_id = {i} then value end) as "{i}"' for i in range(10))} from ({SETTINGS_SQL}) s group by setting""")
def settings_matrix(t: Tables) -> DataFrame:
    return D.settings_matrix(settings(t), "condition_id", list(range(10)))


@query("i10_set_operations", "select item_key, 'missing' as side from v_items where item_key not in (select target_key from v_references) union all select distinct item_key, 'unknown' from v_references where item_key not in (select item_key from v_items) union all select distinct item_key, 'both' from v_references where item_key in (select item_key from v_items)")
def set_operations(t: Tables) -> DataFrame:
    items, targets, linked = t.v_items.select("item_key"), t.v_references.select(F.col("target_key").alias("item_key")), t.v_references.select("item_key")
    missing = items.join(targets, "item_key", "left_anti").withColumn("side", F.lit("missing"))
    unknown = linked.distinct().join(items, "item_key", "left_anti").withColumn("side", F.lit("unknown"))
    return missing.unionByName(unknown).unionByName(linked.intersect(items).withColumn("side", F.lit("both")))


@query("h2_domain_order", "select run, parameter, cast(position as bigint) as position from (select distinct run, parameter, case parameter when 'slope' then 1 when 'location' then 2 when 'guessing' then 3 else 4 end + 4 * (case run when 'F-low' then 1 when 'F-high' then 2 when 'O-low' then 3 else 4 end - 1) as position from v_errors) x")
def domain_order(t: Tables) -> DataFrame:
    """The rank of each run and parameter in the fixed order of categories."""
    place = (D.ordinal("run", RUNS) - 1) * len(PARAMETERS) + D.ordinal("parameter", PARAMETERS)
    return t.v_errors.select("run", "parameter").distinct().select("run", "parameter", place.alias("position")).orderBy("position")


# --- tests and effects ----------------------------------------------------------------------------------------------


def _test_sql(groups: str, value: str, source: str) -> str:
    return f"""select {groups}, items, round(estimate, 6) as estimate, round(se, 6) as se, round(t, 5) as t, df, round({S.t_tail('t', 'df')}, 6) as p_value,
        round(estimate - {S.t_quantile('df')} * se, 6) as ci_low, round(estimate + {S.t_quantile('df')} * se, 6) as ci_high from (
        select {groups}, count(*) as items, avg({value}) as estimate, case when count(*) >= 2 then stddev_samp({value}) / sqrt(count(*)) end as se,
        case when stddev_samp({value}) > 0 then avg({value}) / (stddev_samp({value}) / sqrt(count(*))) end as t, case when count(*) >= 2 then count(*) - 1 end as df
        from ({source}) s where {value} is not null group by {groups}) x"""


def _rounded_test(df: DataFrame) -> DataFrame:
    return rounded(df.withColumn("t", F.round("t", 5)))


ONE_PAIR = "select a.parameter, abs(a.predicted - a.calibrated) - abs(b.predicted - b.calibrated) as d from v_errors a join v_errors b on a.item_key = b.item_key and a.parameter = b.parameter and a.run = 'F-low' and b.run = 'O-high'"


@query("f1_paired_t_test", _test_sql("parameter", "d", ONE_PAIR))
def paired_t_test(t: Tables) -> DataFrame:
    table = C.wide(t.v_errors.withColumn("abs_error", F.abs(F.col("predicted") - F.col("calibrated"))), C.PAIR, ["F-low", "O-high"], ("abs_error",))
    difference = F.col("`abs_error (F-low)`") - F.col("`abs_error (O-high)`")
    return _rounded_test(C.t_test(table.withColumn("d", difference), ["parameter"], "d"))


PAIRS = C.comparisons(RUNS, C.BASELINES)
PAIRED = {
    **STACKED,
    "o_pairs": " union all ".join(f"select '{a}' as a, '{b}' as b" for a, b in PAIRS),
    "o_diff": """select x.parameter, concat(a, ' − ', b) as comparison, abs(x.predicted - x.calibrated) - abs(y.predicted - y.calibrated) as d
        from o_pairs join o_stack x on x.run = a join o_stack y on y.run = b and x.item_key = y.item_key and x.parameter = y.parameter""",
    "o_test": _test_sql("parameter, comparison", "d", "select * from o_diff"),
}
HOLM_SQL = """select *, case when p_value is not null then round(least(1e0, max(p_value * k) over (partition by parameter order by p_value, comparison rows unbounded preceding)), 5) end as p_holm
    from (select *, count(p_value) over (partition by parameter) - row_number() over (partition by parameter order by p_value nulls last, comparison) + 1 as k from o_test) x"""


@query("f2_paired_comparisons", "select * from o_test", PAIRED)
def paired_comparisons(t: Tables) -> DataFrame:
    return _rounded_test(C.paired(stacked(t), PAIRS).drop("p_holm"))


@query("f3_holm_adjustment", f"select parameter, comparison, p_value, p_holm from ({HOLM_SQL}) x", PAIRED)
def holm_adjustment(t: Tables) -> DataFrame:
    tests = _rounded_test(C.paired(stacked(t), PAIRS).drop("p_holm"))
    return C.holm(tests, ["parameter"]).select("parameter", "comparison", "p_value", F.round("p_holm", 5).alias("p_holm"))


EFFECTS = {
    "o_contrast": """
        select parameter, item_key, effect, comparison, sum(weight * abs(predicted - calibrated)) as d from v_errors e join (values
        ('status_level', 'O − F', 'F-low', -5e-1), ('status_level', 'O − F', 'F-high', -5e-1), ('status_level', 'O − F', 'O-low', 5e-1), ('status_level', 'O − F', 'O-high', 5e-1),
        ('discount_level', 'high − low', 'F-low', -5e-1), ('discount_level', 'high − low', 'F-high', 5e-1), ('discount_level', 'high − low', 'O-low', -5e-1), ('discount_level', 'high − low', 'O-high', 5e-1),
        ('status_level × discount_level', 'discount_level effect with O − discount_level effect with F', 'F-low', 1e0), ('status_level × discount_level', 'discount_level effect with O − discount_level effect with F', 'F-high', -1e0),
        ('status_level × discount_level', 'discount_level effect with O − discount_level effect with F', 'O-low', -1e0), ('status_level × discount_level', 'discount_level effect with O − discount_level effect with F', 'O-high', 1e0)
        ) w(effect, comparison, condition, weight) on e.run = w.condition where item_key in (select item_key from v_errors group by item_key having count(distinct run) = 4) group by 1, 2, 3, 4"""
}


@query("f4_factorial_effects", _test_sql("parameter, effect, comparison", "d", "select * from o_contrast"), EFFECTS)
def factorial_effects(t: Tables) -> DataFrame:
    return _rounded_test(C.factorial_effects(t.v_errors, FACTORS))


# --- agreement on value scales --------------------------------------------------------------------------------------

SCALE_ROWS = ", ".join(f"('{p}', {i}, {v!r}e0)" for p, values in SCALES.items() for i, v in enumerate(values, 1))
CHOICES = {
    "o_scale": f"select * from (values {SCALE_ROWS}) s(parameter, position, value)",
    "o_pick": """select e.run, e.item_key, e.grade, e.parameter, arg_min(s.position, struct_pack(d := abs(s.value - predicted), p := s.position)) as category,
        arg_min(s.position, struct_pack(d := abs(s.value - calibrated), p := s.position)) as calibrated_category
        from v_errors e join o_scale s on e.parameter = s.parameter
        where e.item_key in (select item_key from v_errors group by item_key having count(distinct run) = 4) group by 1, 2, 3, 4""",
}


def choices(t: Tables) -> DataFrame:
    """The choices on the items that every run predicted, so that runs are compared on the same items."""
    return C.scale_choices(t.v_errors.join(C.common_items(t.v_errors, len(RUNS)), "item_key", "left_semi"), SCALES)


@query(
    "f8_scale_choices",
    "select run, item_key, p.parameter, category, calibrated_category, a.value as value, b.value as calibrated_value from o_pick p join o_scale a on p.parameter = a.parameter and p.category = a.position join o_scale b on p.parameter = b.parameter and p.calibrated_category = b.position",
    CHOICES,
)
def scale_choices(t: Tables) -> DataFrame:
    return choices(t).select("run", "item_key", "parameter", "category", "calibrated_category", "value", "calibrated_value")


def _agreement_sql(groups: str, a: str, b: str, source: str) -> str:
    return f"""select {groups}, count(*) as items, round(avg(case when {a} = {b} then 1e0 else 0e0 end), 6) as exact, round(avg(case when abs({a} - {b}) <= 1 then 1e0 else 0e0 end), 6) as within_one,
        round(case when least(min({a}), min({b})) < greatest(max({a}), max({b})) then 1e0 - sum(({a} - {b}) * ({a} - {b})) / max(expected) end, 6) as weighted_kappa from (
        select s.*, e.expected from ({source}) s join (
            select {', '.join('f.' + g.strip() for g in groups.split(','))}, sum(f.n * g.n * (f.c - g.c) * (f.c - g.c)) * 1e0 / max(f.total) as expected from
            (select {groups}, {a} as c, count(*) as n, sum(count(*)) over (partition by {groups}) as total from ({source}) y group by {groups}, {a}) f join
            (select {groups}, {b} as c, count(*) as n from ({source}) z group by {groups}, {b}) g on {' and '.join(f'f.{k.strip()} = g.{k.strip()}' for k in groups.split(','))}
            group by {', '.join('f.' + g.strip() for g in groups.split(','))}) e on {' and '.join(f's.{k.strip()} = e.{k.strip()}' for k in groups.split(','))}) x group by {groups}"""


RATINGS = "select lang, quality + 1 as first, toxic + 1 as second from labels join documents on labels.doc_id = documents.doc_id"


@query("f6_weighted_kappa", f"select lang, weighted_kappa from ({_agreement_sql('lang', 'first', 'second', RATINGS)}) k")
def weighted_kappa(t: Tables) -> DataFrame:
    ratings = t.sql(RATINGS)
    return rounded(C.agreement(ratings, ["lang"], "first", "second").select("lang", "weighted_kappa"))


@query("f7_category_agreement", _agreement_sql("lang", "first", "second", RATINGS))
def category_agreement(t: Tables) -> DataFrame:
    return rounded(C.agreement(t.sql(RATINGS), ["lang"], "first", "second"))


@query("f9_scale_agreement", _agreement_sql("parameter, run", "calibrated_category", "category", "select * from o_pick"), CHOICES)
def scale_agreement(t: Tables) -> DataFrame:
    return rounded(C.agreement(choices(t), ["parameter", "run"]))


@query("f9_scale_agreement_by_grade", _agreement_sql("parameter, run, grade", "calibrated_category", "category", "select * from o_pick"), CHOICES)
def scale_agreement_by_grade(t: Tables) -> DataFrame:
    return rounded(C.agreement(choices(t), ["parameter", "run", "grade"]))


@query(
    "f9_best_constant",
    """select parameter, max(exact) as baseline_exact, max(near) as baseline_within_one from (
       select p.parameter, s.position, round(avg(case when calibrated_category = s.position then 1e0 else 0e0 end), 6) as exact, round(avg(case when abs(calibrated_category - s.position) <= 1 then 1e0 else 0e0 end), 6) as near
       from o_pick p join o_scale s on p.parameter = s.parameter where run = 'F-low' group by 1, 2) x group by parameter""",
    CHOICES,
)
def best_constant(t: Tables) -> DataFrame:
    return rounded(C.best_constant(choices(t).filter("run = 'F-low'"), ["parameter"], 10))


@query(
    "e24_value_spread",
    f"""select s.parameter, s.value, cast(coalesce(max(t.n), 0) as bigint) as calibrated, {', '.join(f'''cast(coalesce(max(case when c.run = '{r}' then c.n end), 0) as bigint) as "{r}" ''' for r in RUNS)}
        from o_scale s left join (select parameter, category, run, count(*) as n from o_pick group by 1, 2, 3) c on c.parameter = s.parameter and c.category = s.position
        left join (select parameter, calibrated_category, count(*) as n from o_pick where run = 'F-low' group by 1, 2) t on t.parameter = s.parameter and t.calibrated_category = s.position group by 1, 2""",
    CHOICES,
)
def value_spread(t: Tables) -> DataFrame:
    return C.value_spread(choices(t), SCALES, RUNS)


@query("e25_confusion", "select run, parameter, calibrated_category, category, n, round(n * 1e0 / sum(n) over (partition by run, parameter, calibrated_category), 6) as share from (select run, parameter, calibrated_category, category, count(*) as n from o_pick group by 1, 2, 3, 4) x", CHOICES)
def confusion(t: Tables) -> DataFrame:
    return rounded(C.confusion(choices(t), ["run", "parameter"]))


# --- distributions and figures' numbers -----------------------------------------------------------------------------


@query(
    "e26_error_distribution",
    """select e.run, e.parameter, round(max(q1), 6) as q1, round(max(median), 6) as median, round(max(q3), 6) as q3, round(min(error), 6) as low, round(max(error), 6) as high, count(*) as inside
       from (select *, predicted - calibrated as error from v_errors) e join (select run, parameter, quantile_cont(predicted - calibrated, 25e-2) as q1, quantile_cont(predicted - calibrated, 5e-1) as median, quantile_cont(predicted - calibrated, 75e-2) as q3
       from v_errors group by 1, 2) b on e.run = b.run and e.parameter = b.parameter where error between q1 - 15e-1 * (q3 - q1) and q3 + 15e-1 * (q3 - q1) group by 1, 2""",
)
def error_distribution(t: Tables) -> DataFrame:
    return rounded(E.box_stats(t.v_errors.withColumn("error", F.col("predicted") - F.col("calibrated")), ["run", "parameter"], "error"))


@query(
    "e27_mean_with_interval",
    f"select grade, parameter, n, round(mean, 6) as mean, round({S.t_quantile('(n - 1)')} * sd / sqrt(n), 6) as half_width from (select grade, parameter, count(*) as n, avg(predicted - calibrated) as mean, stddev_samp(predicted - calibrated) as sd from ({TWICE.format('o_err')}) s group by 1, 2) x",
    ERRORS,
)
def mean_with_interval(t: Tables) -> DataFrame:
    return rounded(E.mean_with_interval(E.with_all(errors(t), "grade"), ["grade", "parameter"], F.col("predicted") - F.col("calibrated")))


@query(
    "e28_mae_vs_baselines",
    f"select grade, parameter, round(avg(abs(predicted - calibrated)), 6) as prediction, round(avg(abs(calibration_mean - calibrated)), 6) as calibration_mean, round(avg(abs(reference_mean - calibrated)), 6) as reference_mean from ({TWICE.format('o_err')}) s group by 1, 2",
    ERRORS,
)
def mae_vs_baselines(t: Tables) -> DataFrame:
    rows = E.with_all(errors(t), "grade")
    columns = [F.avg(F.abs(F.col(source) - F.col("calibrated"))).alias(name) for source, name in [("predicted", "prediction"), *[(b, b) for b in C.BASELINES]]]
    return rounded(rows.groupBy("grade", "parameter").agg(*columns))


@query(
    "e29_scatter_stats",
    f"""select run, parameter, n, round(mae, 6) as mae, round(r, 6) as r, round(low - 5e-2 * (high - low), 6) as axis_low, round(high + 5e-2 * (high - low), 6) as axis_high from (
        select run, parameter, count(*) as n, avg(abs(predicted - calibrated)) as mae, {S.guarded_corr('predicted', 'calibrated')} as r, least(min(predicted), min(calibrated)) as low, greatest(max(predicted), max(calibrated)) as high from v_errors group by 1, 2) x""",
)
def scatter_stats(t: Tables) -> DataFrame:
    from thetaloom.functions.stats import guarded_corr

    low, high = F.least(F.min("predicted"), F.min("calibrated")), F.greatest(F.max("predicted"), F.max("calibrated"))
    pad = 0.05 * (high - low)
    return rounded(
        t.v_errors.groupBy("run", "parameter").agg(
            F.count("*").alias("n"), F.avg(F.abs(F.col("predicted") - F.col("calibrated"))).alias("mae"),
            guarded_corr(F.col("predicted"), F.col("calibrated")).alias("r"), (low - pad).alias("axis_low"), (high + pad).alias("axis_high"),
        )
    )


# --- posterior answers ----------------------------------------------------------------------------------------------

POSTERIOR = {
    "o_p": """select run, item_key, position, value, probability / sum(probability) over (partition by run, item_key) as p,
        sum(probability) over (partition by run, item_key order by position) / sum(probability) over (partition by run, item_key) as c
        from (select k.run, k.item_key, n.position, n.position / 2e0 - 2e0 as value, coalesce(v.probability, 0e0) as probability from (select distinct run, item_key from v_probabilities) k
              cross join (values (1), (2), (3), (4), (5), (6), (7)) n(position) left join v_probabilities v on k.run = v.run and k.item_key = v.item_key and n.position = v.position) x""",
    "o_post": """select e.run, e.item_key, m.map, m.map_probability, e.eap, sqrt(e.sq) as sd, case when d.c <= 5e-1 + 1e-9 and d.next_value is not null then (d.value + d.next_value) / 2e0 else d.value end as median
        from (select run, item_key, sum(p * value) as eap, sum(p * (value - mean) * (value - mean)) as sq from (select *, sum(p * value) over (partition by run, item_key) as mean from o_p) y group by 1, 2) e
        join (select run, item_key, arg_max(value, struct_pack(p := p, v := -value)) as map, max(p) as map_probability from o_p group by 1, 2) m on e.run = m.run and e.item_key = m.item_key
        join (select * from (select *, lead(value) over (partition by run, item_key order by position) as next_value, sum(case when c >= 5e-1 - 1e-9 then 1 else 0 end) over (partition by run, item_key order by position) as hit,
              case when c >= 5e-1 - 1e-9 then 1 else 0 end as now from o_p) z where hit = 1 and now = 1) d on e.run = d.run and e.item_key = d.item_key""",
}


def posteriors(t: Tables, probabilities: bool = False) -> DataFrame:
    """The posterior of each run's answer, and on request the probabilities, scaled to sum to 1, with the confidence."""
    counts = [F.coalesce(F.sum(F.when(F.col("position") == i, F.col("probability"))), F.lit(0.0)) for i in range(1, 8)]
    values = F.array(*[F.lit(i / 2 - 2) for i in range(1, 8)])
    answers = t.v_probabilities.groupBy("run", "item_key").agg(F.array(*counts).alias("_said"), F.sum("probability").alias("_sum"))
    beside = [F.transform("_said", lambda p: p / F.col("_sum")).alias("probabilities"), (F.col("_sum") / (F.col("_sum") + 1)).alias("confidence")]
    rows = answers.select("run", "item_key", posterior(F.col("_said"), values).alias("_p"), *beside)
    return rows.select("run", "item_key", "_p.*", *(["probabilities", "confidence"] if probabilities else []))


@query("g10_posterior", "select run, item_key, map, round(map_probability, 6) as map_probability, round(eap, 6) as eap, median, round(sd, 6) as sd from o_post", POSTERIOR)
def posterior_of_answers(t: Tables) -> DataFrame:
    return rounded(posteriors(t))


PLACES = range(1, 8)
# The answers' posteriors beside the runs that give one number: a run's choice is its most likely value where it has one.
ANSWERED = {
    **POSTERIOR,
    "o_said": """select concat('answers ', run) as run, item_key, eap as predicted, map from o_post
        union all select run, item_key, predicted, null from v_errors where parameter = 'location'""",
    "o_place": f"select * from (values {', '.join(f'({i}, {i / 2 - 2})' for i in PLACES)}) s(place, value)",
    "o_chosen": """select run, s.item_key, arg_min(p.place, struct_pack(d := abs(p.value - coalesce(map, predicted)), p := p.place)) as category,
        arg_min(p.place, struct_pack(d := abs(p.value - i.location), p := p.place)) as calibrated_category
        from o_said s join v_items i on s.item_key = i.item_key cross join o_place p group by 1, 2""",
}


@query(
    "f8_scale_choices_of_answers",
    """select run, item_key, category, calibrated_category, a.value, b.value as calibrated_value from o_chosen c
       join o_place a on c.category = a.place join o_place b on c.calibrated_category = b.place""",
    ANSWERED,
)
def scale_choices_of_answers(t: Tables) -> DataFrame:
    """Choices of runs that answer with probabilities, whose most likely value counts, and of runs that give one number. An
    answer whose most likely value is off the scale raises."""
    answers = posteriors(t).select(F.concat(F.lit("answers "), "run").alias("run"), "item_key", F.col("eap").alias("predicted"), "map")
    numbers = t.v_errors.filter("parameter = 'location'").select("run", "item_key", "predicted")
    said = answers.unionByName(numbers, allowMissingColumns=True).withColumn("parameter", F.lit("location"))
    calibrated = t.v_items.select("item_key", F.col("location").alias("calibrated"))
    chosen = C.scale_choices(said.join(calibrated, "item_key"), {"location": [i / 2 - 2 for i in PLACES]}, mode="map")
    C.require_on_scale(chosen)
    return chosen.select("run", "item_key", "category", "calibrated_category", "value", "calibrated_value")


@query(
    "i9_posterior_rows",
    f"""select p.run, p.item_key, i.grade, p.map, round(p.map_probability, 6) as map_probability, round(p.eap, 6) as eap, p.median, round(p.sd, 6) as sd, round(c.confidence, 6) as confidence, {', '.join(f'round(c.p{i}, 6) as p{i}' for i in PLACES)},
        round(i.location, 6) as calibrated from o_post p join v_items i on p.item_key = i.item_key join (
        select run, item_key, {', '.join(f'max(case when position = {i} then p end) as p{i}' for i in PLACES)}, max(confidence) as confidence from o_p join (select run as r, item_key as k, sum(probability) / (sum(probability) + 1e0) as confidence from v_probabilities group by 1, 2) s on run = r and item_key = k group by 1, 2) c
        on p.run = c.run and p.item_key = c.item_key where p.map is not null""",
    POSTERIOR,
)
def posterior_rows(t: Tables) -> DataFrame:
    """The items with a posterior: every estimator's value, the spread, the confidence that came with the answer, and the
    probabilities of the scale's values, beside the calibrated value. Items without an answer have no row."""
    items = t.v_items.select("item_key", "grade", F.col("location").alias("calibrated"))
    rows = items.join(posteriors(t, probabilities=True), "item_key").filter("map is not null")
    shares = [F.element_at("probabilities", i).alias(f"p{i}") for i in PLACES]
    return rounded(rows.select("run", "item_key", "grade", "map", "map_probability", "eap", "median", "sd", "confidence", *shares, "calibrated"))


ESTIMATORS = ["eap", "median", "map"]


@query(
    "e30_estimators",
    f"""select run, items, {', '.join(f'round({e}_mae, 6) as {e}_mae, round({e}_bias, 6) as {e}_bias' for e in ESTIMATORS)}, round(mean_sd, 6) as mean_sd, round(spearman, 6) as spearman_sd_abs_error from (
        select run, count(*) as items, {', '.join(f'avg(abs({e} - location)) as {e}_mae, avg({e} - location) as {e}_bias' for e in ESTIMATORS)}, avg(sd) as mean_sd, {S.guarded_corr('rs', 're')} as spearman from (
        select *, {S.average_rank('sd', 'run')} as rs, {S.average_rank('ae', 'run')} as re from (select run, map, eap, median, round(sd, 9) as sd, location, round(abs(eap - location), 9) as ae from o_post p join v_items i on p.item_key = i.item_key) a) b group by run) c""",
    POSTERIOR,
)
def estimators(t: Tables) -> DataFrame:
    """Error of each point estimate of an answer, and whether the spread of the answer goes with the error."""
    rows = posteriors(t).join(t.v_items.select("item_key", "location"), "item_key")
    rows = rows.withColumns({"sd": F.round("sd", 9), "ae": F.round(F.abs(F.col("eap") - F.col("location")), 9)})
    columns = [F.count("*").alias("items")]
    for name in ESTIMATORS:
        error = F.col(name) - F.col("location")
        columns += [F.avg(F.abs(error)).alias(f"{name}_mae"), F.avg(error).alias(f"{name}_bias")]
    means = rows.groupBy("run").agg(*columns, F.avg("sd").alias("mean_sd"))
    ranks = E.correlations(rows, ["run"], "sd", "ae").select("run", F.col("spearman").alias("spearman_sd_abs_error"))
    return rounded(means.join(ranks, "run"))


# --- costs and records ----------------------------------------------------------------------------------------------


@query(
    "e11_run_cost",
    """select run, count(*) as items, cast(sum(prompt_tokens) as bigint) as input_tokens, cast(sum(completion_tokens) as bigint) as output_tokens, round(sum(cost_usd), 4) as cost_usd,
       round(sum(cost_usd) / count(*), 9) as cost_per_item_usd, count(seconds) as requests_timed, round(median(seconds), 6) as median_seconds from v_predictions group by run""",
)
def run_cost(t: Tables) -> DataFrame:
    from thetaloom.operators.usage import run_cost

    cost = run_cost(t.v_predictions, "run", input_tokens=("prompt_tokens", "input_tokens"), output_tokens=("completion_tokens", "output_tokens"))
    return cost.select("run", "items", "input_tokens", "output_tokens", F.round("cost_usd", 4).alias("cost_usd"), F.round("cost_per_item_usd", 9).alias("cost_per_item_usd"), "requests_timed", F.round("median_seconds", 6).alias("median_seconds"))


@query(
    "i11_record_assembly",
    """select i.item_key, i.grade, i.irt_model, c.target_calibration, p.excluded, r.similar from v_items i
       join (select grade, min(calibration) as target_calibration from v_items group by grade) c on i.grade = c.grade
       join (select a.grade, a.part_group, string_agg(item_key, '+' order by item_key) as excluded from v_items a group by 1, 2) p on i.grade = p.grade and i.part_group = p.part_group
       left join (select target_key, string_agg(concat(cast(rank as varchar), ':', item_key, ':', 'linked'), '|' order by rank) as similar from (
           select target_key, item_key, row_number() over (partition by target_key order by first_place, item_key) as rank from v_references) x group by target_key) r on i.item_key = r.target_key""",
)
def record_assembly(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("target_key").orderBy("first_place", "item_key")
    linked = t.v_references.select("target_key", "item_key", F.lit("linked").alias("found_by"), F.row_number().over(order).alias("rank"))
    keys = t.v_items.select("item_key", "grade", "part_group")
    parts = keys.groupBy("grade", "part_group").agg(F.array_sort(F.collect_list("item_key")).alias("members"))
    pairs = keys.join(parts, ["grade", "part_group"]).select(F.col("item_key").alias("target_key"), F.explode("members").alias("part_key"))
    targets = t.v_items.groupBy("grade").agg(F.min("calibration").alias("target_calibration"))
    records = D.record_assembly(t.v_items.select("item_key", "grade", "irt_model"), targets, pairs, linked)
    return records.select("item_key", "grade", "irt_model", "target_calibration", F.array_join("excluded_item_keys", "+").alias("excluded"), F.array_join("similar_items", "|").alias("similar"))
