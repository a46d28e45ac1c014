"""Fragments of ANSI SQL that several checks share: item models, grid likelihoods, tests and ranks."""

from __future__ import annotations

import math


def logistic(theta: str, p: str = "") -> str:
    return f"(1e0 / (1e0 + exp(-17e-1 * {p}slope * ({theta} - {p}location))))"


def correct(theta: str, p: str = "") -> str:
    return f"(coalesce({p}guessing, 0e0) + (1e0 - coalesce({p}guessing, 0e0)) * {logistic(theta, p)})"


def gpcm(theta: str, k: int, p: str = "") -> str:
    z1 = f"(17e-1 * {p}slope * ({theta} - {p}location + {p}step1))"
    z2 = f"({z1} + 17e-1 * {p}slope * ({theta} - {p}location + {p}step2))"
    top = f"greatest(0e0, {z1}, {z2})"
    weight = [f"exp(-{top})", f"exp({z1} - {top})", f"exp({z2} - {top})"]
    return f"({weight[k]} / ({' + '.join(weight)}))"


def probability(theta: str, k: int, p: str = "") -> str:
    """P(score = k); NULL for scores above the item's points."""
    other = [f"1e0 - {correct(theta, p)}", correct(theta, p), "null"][k]
    return f"(case when {p}irt_model = 'GPCM' then {gpcm(theta, k, p)} else {other} end)"


def observed(theta: str, p: str = "") -> str:
    return f"(case {p}score when 0 then {probability(theta, 0, p)} when 1 then {probability(theta, 1, p)} else {probability(theta, 2, p)} end)"


def log_observed(theta: str, p: str = "") -> str:
    return f"ln(greatest({observed(theta, p)}, 1e-300))"


def expected(theta: str, p: str = "", power: int = 1) -> str:
    return f"({probability(theta, 1, p)} + {2**power} * coalesce({probability(theta, 2, p)}, 0e0))"


def information(theta: str, p: str = "") -> str:
    m1 = f"({gpcm(theta, 1, p)} + 2 * {gpcm(theta, 2, p)})"
    m2 = f"({gpcm(theta, 1, p)} + 4 * {gpcm(theta, 2, p)})"
    lg = logistic(theta, p)
    scale = f"(17e-1 * {p}slope) * (17e-1 * {p}slope)"
    return (
        f"({scale} * case when {p}irt_model = 'GPCM' then {m2} - {m1} * {m1} "
        f"else (1e0 - coalesce({p}guessing, 0e0)) * {lg} * {lg} * (1e0 - {lg}) / {correct(theta, p)} end)"
    )


# Responses x the 1,201 points of the ability grid, and the estimates from the sums.
GRID_LIKELIHOOD = f"""
select respondent, calibration, g, -6e0 + g * 1e-2 as theta, sum({log_observed('(-6e0 + g * 1e-2)')}) as ll,
       count(*) as items, sum(score) as points, sum(scaled_points) as max_points
from v_responses cross join range(0, 1201) t(g) group by respondent, calibration, g"""

EAP = """
select respondent, calibration, max(items) as items, max(points) as points, max(max_points) as max_points,
       sum(w * theta) / sum(w) as theta_eap, sqrt(sum(w * theta * theta) / sum(w) - (sum(w * theta) / sum(w)) * (sum(w * theta) / sum(w))) as theta_eap_se
from (select *, exp(ll - max(ll) over (partition by respondent, calibration) - theta * theta / 2e0) as w from o_ll) x
group by respondent, calibration"""

COARSE = """
select respondent, calibration, min(theta) as coarse from (
    select *, rank() over (partition by respondent, calibration order by ll desc) as r from o_ll) x
where r = 1 group by respondent, calibration"""

FINE = f"""
select r.respondent, r.calibration, f, coarse, sum({log_observed('(coarse + f * 1e-4)')}) as ll
from v_responses r join o_coarse c on r.respondent = c.respondent and r.calibration = c.calibration cross join range(-200, 201) t(f)
group by r.respondent, r.calibration, f, coarse"""

VERTEX = """
select respondent, calibration, coarse + f * 1e-4 + coalesce(1e-4 * (before - after) / nullif(2e0 * (before - 2e0 * ll + after), 0e0), 0e0) as mle
from (select *, lag(ll) over w as before, lead(ll) over w as after,
             row_number() over (partition by respondent, calibration order by case when abs(f) < 200 then 0 else 1 end, ll desc, f) as r
      from o_fine window w as (partition by respondent, calibration order by f)) x where r = 1"""

MLE = f"""
select e.respondent, e.calibration, e.items, e.points, e.max_points, e.theta_eap, e.theta_eap_se,
       case when e.points = 0 then 'zero score' when e.points = e.max_points then 'perfect score' when abs(c.coarse) > 5995e-3 then 'beyond ±6' end as mle_note,
       v.mle, i.information, c.coarse
from o_eap e join o_coarse c on e.respondent = c.respondent and e.calibration = c.calibration
join o_vertex v on e.respondent = v.respondent and e.calibration = v.calibration
join (select r.respondent, r.calibration, sum({information('mle', 'r.')}) as information
      from v_responses r join o_vertex v on r.respondent = v.respondent and r.calibration = v.calibration group by 1, 2) i
  on e.respondent = i.respondent and e.calibration = i.calibration"""

THETA = {"o_ll": GRID_LIKELIHOOD, "o_eap": EAP}
THETA_MLE = {**THETA, "o_coarse": COARSE, "o_fine": FINE, "o_vertex": VERTEX, "o_mle": MLE}


def benchmark(score: str, grade: str) -> str:
    return (
        f"case when {score} >= 625 then 'Advanced (625)' when {score} >= 550 then 'High (550)' when {score} >= 475 then 'Intermediate (475)' "
        f"when {score} >= 400 and {grade} <> 12 then 'Low (400)' else 'below the lowest benchmark' end"
    )


def t_tail(t: str, df: str) -> str:
    """Two-sided tail of Student's t for integer df: the finite series with gamma-function coefficients."""
    angle = f"atan(abs({t}) / sqrt({df}))"
    cos2 = f"pow(cos({angle}), 2)"
    odd = (
        f"1e0 - 2e0 / pi() * ({angle} + case when {df} > 1 then sin({angle}) * cos({angle}) * list_sum(list_transform(range(0, cast(({df} - 1) / 2 as bigint)), "
        f"lambda j: sqrt(pi()) / 2e0 * exp(lgamma(j + 1e0) - lgamma(j + 15e-1)) * pow({cos2}, j))) else 0e0 end)"
    )
    even = (
        f"1e0 - sin({angle}) * list_sum(list_transform(range(0, cast({df} / 2 as bigint)), "
        f"lambda j: exp(lgamma(j + 5e-1) - lgamma(j + 1e0)) / sqrt(pi()) * pow({cos2}, j)))"
    )
    return f"greatest(0e0, case when {df} % 2 = 1 then {odd} else {even} end)"


def t_quantile(df: str) -> str:
    """The 97.5% quantile of Student's t by its expansion, exact to 1e-9 from 60 degrees of freedom."""
    z = 1.959963984540054
    terms = [
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]
    return "(" + " + ".join([repr(z)] + [f"{value!r} / pow({df} * 1e0, {i})" for i, value in enumerate(terms, 1)]) + ")"


def average_rank(value: str, partition: str) -> str:
    return f"(rank() over (partition by {partition} order by {value}) + (count(*) over (partition by {partition}, {value}) - 1) / 2e0)"


def guarded_corr(x: str, y: str) -> str:
    return f"case when count(*) >= 3 and min({x}) < max({x}) and min({y}) < max({y}) then corr({x}, {y}) end"


def normal_cdf(x: str) -> str:
    """Standard normal distribution function, Hart's approximation."""
    top = "(((((3.52624965998911e-2 * z + 7.00383064443688e-1) * z + 6.37396220353165e0) * z + 3.3912866078383e1) * z + 1.12079291497871e2) * z + 2.21213596169931e2) * z + 2.20206867912376e2"
    bottom = "((((((8.83883476483184e-2 * z + 1.75566716318264e0) * z + 1.6064177579207e1) * z + 8.67807322029461e1) * z + 2.96564248779674e2) * z + 6.37333633378831e2) * z + 7.93826512519948e2) * z + 4.40413735824752e2"
    near = f"exp(-(z) * (z) / 2e0) * ({top}) / ({bottom})".replace("z", f"abs({x})")
    return f"case when {x} > 0 then 1e0 - {near} else {near} end"


def bootstrap(rows: str, groups: list[str], replicates: int = 2000) -> dict[str, str]:
    """Resampling by Poisson weights: an item's weight in replicate r is how many steps of the Poisson(1) distribution lie
    at or below hash(item * 65537 + r)."""
    p = 2147483647
    keys = ", ".join(groups)
    steps, term, total = [], math.exp(-1.0), math.exp(-1.0)
    for k in range(1, 12):
        steps.append(total)
        term /= k
        total += term
    weight = " + ".join(f"case when u >= {step!r}::double then 1 else 0 end" for step in steps)
    return {
        "b_items": f"select {keys}, points, max_points, cast('0x' || substr(md5(item_key), 1, 7) as bigint) as h from ({rows}) b_rows",
        "b_k": f"select {keys}, points, max_points, r, ((h * 65537 + r) % {p} * 48271 + 11) % {p} as h from b_items cross join range(0, {replicates}) t(r)",
        "b_1": f"select {keys}, points, max_points, r, ((h * h % {p}) * (h * h % {p}) % {p} * h % {p} * 69621 + 13) % {p} as h from b_k",
        "b_u": f"select {keys}, points, max_points, r, ((h * h % {p}) * (h * h % {p}) % {p} * h % {p}) / {p}e0 as u from b_1",
        "b_shares": f"select {keys}, r, 1e2 * sum(points * w) / nullif(sum(max_points * w), 0) as share from (select *, {weight} as w from b_u) x group by {keys}, r",
        "b_ci": f"select {keys}, quantile_cont(share, 25e-3) as ci_low, quantile_cont(share, 975e-3) as ci_high from b_shares group by {keys}",
    }
