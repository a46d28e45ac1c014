"""Abilities of respondents per calibration and everything scored on the ability scale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thetaloom.operators.ability import estimate_theta
from thetaloom.operators.reporting import calibration_items, largest_calibration, overall_scores
from thetaloom.plans import sqltext as S
from thetaloom.plans.registry import query
from thetaloom.sources.tables import Tables

KEYS = ["respondent", "calibration"]


def r6(name: str):
    return F.round(name, 6).alias(name)


def estimates(t: Tables, step: float = 0.01, responses: DataFrame | None = None) -> DataFrame:
    """Abilities of ``responses``, by default all of the folder's."""
    rows = t.v_responses if responses is None else responses
    return estimate_theta(rows, KEYS, step, max_group_rows=largest_calibration(t.v_items))


def overall(t: Tables, step: float = 0.01, responses: DataFrame | None = None) -> DataFrame:
    calibrations = calibration_items(t.v_items).join(t.v_scale, "calibration")
    return overall_scores(estimates(t, step, responses), calibrations)


@query(
    "g5_theta_eap",
    "select respondent, calibration, round(theta_eap, 6) as theta_eap, round(theta_eap_se, 6) as theta_eap_se from o_eap",
    S.THETA,
)
def theta_eap(t: Tables) -> DataFrame:
    return estimates(t).select(*KEYS, r6("theta_eap"), r6("theta_eap_se"))


@query(
    "g6_theta_mle",
    """select respondent, calibration, mle_note, case when mle_note is null then round(mle, 5) end as theta_mle,
       case when mle_note is null then round(1e0 / sqrt(information), 5) end as theta_mle_se from o_mle""",
    S.THETA_MLE,
)
def theta_mle(t: Tables) -> DataFrame:
    finite = F.col("mle_note").isNull()
    return estimates(t).select(
        *KEYS, "mle_note", F.when(finite, F.round("theta_mle", 5)).alias("theta_mle"), F.round("theta_mle_se", 5).alias("theta_mle_se")
    )


@query(
    "e15_overall_scores",
    f"""select respondent, m.calibration, grade, items, calibration_items, cast(points as bigint) as points, cast(max_points as bigint) as max_points,
        round(1e2 * points / max_points, 6) as percent_of_points, round(theta_eap, 6) as theta_eap, mle_note,
        round(a + b * theta_eap, 5) as scale_eap, round(b * theta_eap_se, 5) as scale_eap_se,
        case when mle_note is null then round(a + b * mle, 3) end as scale_mle,
        case when mle_note is null then round(b / sqrt(information), 3) end as scale_mle_se,
        {S.benchmark('a + b * theta_eap', 'grade')} as scale_benchmark
        from o_mle m join v_scale s on m.calibration = s.calibration
        join (select calibration, min(grade) as grade, count(*) as calibration_items from v_items group by calibration) c on m.calibration = c.calibration""",
    S.THETA_MLE,
)
def overall_table(t: Tables) -> DataFrame:
    finite = F.col("mle_note").isNull()
    return overall(t).select(
        *KEYS, "grade", "items", "calibration_items", "points", "max_points", r6("percent_of_points"), r6("theta_eap"), "mle_note",
        F.round("scale_eap", 5).alias("scale_eap"), F.round("scale_eap_se", 5).alias("scale_eap_se"),
        F.when(finite, F.round("scale_mle", 3)).alias("scale_mle"), F.round("scale_mle_se", 3).alias("scale_mle_se"), "scale_benchmark",
    )
