"""The input tables of a data folder, and the views of test items, responses, runs and requests derived from them.

Each derived view is one SQL text that Spark and an ANSI SQL engine read alike, so a query and its check start from the
same rows. Literals such as ``5e-1`` are doubles in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    # One calibrated item per part.
    "v_items": """
select concat('P', cast(p_partkey as varchar(20))) as item_key, p_partkey as pk,
       case p_partkey % 3 when 0 then 4 when 1 then 8 else 12 end as grade,
       concat('cal', cast(p_partkey % 3 as varchar(2)), '-', cast(p_size % 2 as varchar(2))) as calibration,
       cast(floor(p_partkey / 6e0) as bigint) as part_group,
       case when p_partkey % 10 < 6 then '3PL' when p_partkey % 10 < 9 then '2PL' else 'GPCM' end as irt_model,
       case when p_partkey % 10 = 9 then 2 else 1 end as scaled_points,
       5e-1 + (p_size % 16) / 1e1 as slope,
       ((p_partkey * 37) % 401 - 200) / 1e2 as location,
       case when p_partkey % 10 < 6 then 1e-1 + (p_partkey % 4) * 5e-2 end as guessing,
       case when p_partkey % 10 = 9 then 3e-1 + (p_partkey % 5) * 1e-1 end as step1,
       case when p_partkey % 10 = 9 then -(3e-1 + (p_partkey % 5) * 1e-1) end as step2, cast(null as double) as step3
from part""",
    # Respondent x item score.
    "v_scores": """
select l_suppkey as respondent, item_key, grade, calibration, irt_model, scaled_points,
       least(max(case l_returnflag when 'R' then 2 when 'A' then 1 else 0 end), scaled_points) as score
from lineitem join v_items on l_partkey = pk
group by l_suppkey, item_key, grade, calibration, irt_model, scaled_points""",
    # The same responses with the parameters that score them.
    "v_responses": """
select s.respondent, s.item_key, s.grade, s.calibration, s.irt_model, s.scaled_points, s.score,
       i.slope, i.location, i.guessing, i.step1, i.step2, i.step3
from v_scores s join v_items i on s.item_key = i.item_key""",
    # Four prediction runs in a 2 x 2 design: one wide row per run and item.
    "v_predictions": """
select run, status_level, discount_level, item_key, pk, grade, irt_model, scaled_points, part_group,
       slope as slope_calibrated, location as location_calibrated, guessing as guessing_calibrated, step1 as step1_calibrated,
       slope + round((avg_quantity - 25e0) / 1e2, 9) as slope_predicted,
       location + round((avg_quantity - 25e0) / 2e1 + avg_discount, 9) as location_predicted,
       guessing + round(avg_tax - 4e-2, 9) as guessing_predicted,
       step1 + round(avg_discount * 4e0 - 2e-1, 9) as step1_predicted,
       prompt_tokens, completion_tokens, cost_usd, seconds
from (
    select concat(l_linestatus, '-', case when l_discount < 5e-2 then 'low' else 'high' end) as run,
           l_linestatus as status_level, case when l_discount < 5e-2 then 'low' else 'high' end as discount_level, l_partkey,
           round(avg(l_quantity), 9) as avg_quantity, round(avg(l_discount), 9) as avg_discount, round(avg(l_tax), 9) as avg_tax,
           cast(sum(l_quantity) as bigint) as prompt_tokens, count(*) as completion_tokens,
           case when l_linestatus = 'O' then round(sum(l_extendedprice) / 1e6, 4) end as cost_usd,
           max(case when l_returnflag <> 'N' then l_tax * 1e2 end) as seconds
    from lineitem group by 1, 2, 3, 4
) r join v_items on l_partkey = pk""",
    # Run x item x predicted parameter.
    "v_errors": """
select run, status_level, discount_level, item_key, pk, grade, irt_model, scaled_points, part_group, parameter, predicted, calibrated
from (
    select *, 'slope' as parameter, slope_predicted as predicted, slope_calibrated as calibrated from v_predictions
    union all select *, 'location', location_predicted, location_calibrated from v_predictions
    union all select *, 'guessing', guessing_predicted, guessing_calibrated from v_predictions
    union all select *, 'step1', step1_predicted, step1_calibrated from v_predictions
) u where calibrated is not null""",
    # Reference items of an item, each with the place of its first mention.
    "v_references": """
select concat('P', cast(l_partkey as varchar(20))) as target_key, concat('P', cast(l_suppkey as varchar(20))) as item_key, min(l_orderkey) as first_place
from lineitem where l_partkey <> l_suppkey group by 1, 2""",
    # How often a probability answer falls on each value of a 7-point scale, per run and item.
    "v_probabilities": """
select l_linestatus as run, concat('P', cast(l_partkey as varchar(20))) as item_key, l_linenumber as position,
       l_linenumber / 2e0 - 2e0 as value, count(*) * 1e0 as probability
from lineitem group by 1, 2, 3, 4""",
    # Condition x item answer with its key and the scorer's verdict; a missing category is a missing verdict.
    "v_answers": """
select l_suppkey % 5 as condition_id, concat('P', cast(l_partkey as varchar(20))) as item_key, l_orderkey, l_linenumber,
       case when l_partkey % 10 < 6 then 'multiple_choice' else 'constructed_response' end as item_type,
       case when l_partkey % 10 < 6 then substr('ABCD', cast(1 + cast(l_quantity as int) % 4 as int), 1)
            when l_quantity < 3e0 then ' ' else concat('work ', cast(cast(l_quantity as int) as varchar(10))) end as answer,
       substr('ABCD', cast(1 + l_partkey % 4 as int), 1) as correct_option,
       case when l_partkey % 10 < 6 or (l_linestatus = 'O' and l_linenumber = 1) then null
            when l_returnflag = 'R' then 'Correct Response' when l_returnflag = 'A' and l_partkey % 10 >= 8 then 'Partial Response'
            else 'Incorrect Response' end as category,
       case when l_partkey % 10 >= 8 then 2 else 1 end as max_points
from lineitem""",
    # One answer per condition and item (the last line of an item counts), scored.
    "v_item_level": """
select c.condition_id, c.role, c.model, a.item_key, i.grade, i.calibration, i.part_group, i.irt_model, i.scaled_points,
       a.item_type, a.max_points, a.points, case when a.points = a.max_points then 1 else 0 end as full_credit,
       case when p.p_size % 2 = 0 then true else false end as has_figure,
       case when p.p_size % 9 <> 0 then round(p.p_retailprice / 1e1 - 5e1 + p.p_size, 4) end as percent_correct
from (
    select l_suppkey % 10 as condition_id, concat('P', cast(l_partkey as varchar(20))) as item_key, l_partkey as pk,
           case when l_partkey % 10 < 6 then 'multiple_choice' else 'constructed_response' end as item_type,
           case when l_partkey % 10 = 9 then 2 else 1 end as max_points,
           least(max(case l_returnflag when 'R' then 2 when 'A' then 1 else 0 end), case when l_partkey % 10 = 9 then 2 else 1 end) as points
    from lineitem group by 1, 2, 3, 4, 5
) a join v_items i on a.item_key = i.item_key join part p on a.pk = p.p_partkey
join v_conditions c on a.condition_id = c.condition_id""",
    # Test-taking conditions: a model in a role.
    "v_conditions": """
select s_suppkey % 10 as condition_id, case when s_suppkey % 10 < 5 then 'test_taker' else 'student' end as role,
       concat('vendor', cast(s_suppkey % 5 % 2 as varchar(2)), '/model-', cast(s_suppkey % 5 as varchar(2))) as model,
       case when s_suppkey % 5 % 2 = 0 then 'router' else 'direct' end as provider,
       case when s_suppkey % 5 = 0 then 'none' when s_suppkey % 5 = 1 then 'high' end as effort
from supplier group by 1, 2, 3, 4, 5""",
    # Five plausible values of transformation constants per calibration, and a bridge step that is not used for scoring.
    "v_constants": """
select calibration, t.use_for_scoring, 1 + pk % 5 as plausible_value,
       case when calibration like '%-0' then 'derived: common items' else 'published: exhibit 13' end as method,
       5e2 + avg(p_size) as target_mean, 9e1 + avg(p_size) / 2e0 as target_sd,
       round(avg(location), 6) + t.shift as theta_mean, 9e-1 + round(avg(slope), 6) / 1e1 as theta_sd
from v_items join part on pk = p_partkey
cross join (select true as use_for_scoring, 0e0 as shift union all select false, 5e-2) t
group by calibration, t.use_for_scoring, t.shift, 1 + pk % 5""",
    "v_scale": """
select calibration, count(*) as plausible_values, avg(target_mean - target_sd / theta_sd * theta_mean) as a,
       avg(target_sd / theta_sd) as b
from v_constants where use_for_scoring group by calibration""",
    # Items with a text: the retrieval collection. Not every item has a vector.
    "v_bank": """
select item_key, pk, i.grade, i.calibration, i.part_group, i.irt_model, i.scaled_points, i.slope, i.location, i.guessing,
       i.step1, i.step2, d.text, d.lang, e.embedding
from v_items i join documents d on i.pk = d.doc_id left join embeddings e on i.pk = e.vec_id""",
    # Released items: every document is an item.
    "v_released": """
select doc_id, concat('M', lpad(cast(doc_id as varchar(10)), 6, '0'), case when doc_id % 4 = 1 then 'A' when doc_id % 4 = 2 then 'B' else '' end) as item_id,
       concat('Survey ', cast(1995 + 4 * (doc_id % 3) as varchar(4))) as assessment,
       case lang when 'en' then 4 when 'de' then 8 else 12 end as grade, 'Mathematics' as subject, source as content_domain,
       case when doc_id % 10 < 6 then 'multiple_choice' else 'constructed_response' end as item_type,
       case when doc_id % 10 = 9 then 2 else 1 end as max_points, text as stem,
       case when doc_id % 10 < 6 then split_part(text, ' ', 1) end as option_a,
       case when doc_id % 10 < 6 then split_part(text, ' ', 2) end as option_b,
       case when doc_id % 10 < 6 then split_part(text, ' ', 3) end as option_c,
       case when doc_id % 10 < 6 then substr('ABCE', cast(1 + doc_id % 4 as int), 1) end as correct_option
from documents""",
    # Work ledger: one request per customer, and arriving outcomes.
    "v_requests": """
select c_custkey as request_id, c_mktsegment as schema_key, concat('k', cast(c_custkey as varchar(20))) as item_key,
       c_nationkey as run_id from customer""",
    "v_results": """
select event_id, ts, user_id as request_id,
       case event_type when 'error' then 'error' when 'signup' then 'unusable' else 'saved' end as outcome, value as cost_usd
from events""",
}

# Of the largest views, a form with the same rows that costs Spark less: rows are combined by their numbers, and take
# texts and parameters after that, so that neither goes through the aggregation of the line items.
_CODES = "select l_suppkey as respondent, l_partkey, max(case l_returnflag when 'R' then 2 when 'A' then 1 else 0 end) as code from lineitem group by 1, 2"
_SCORED = "select distinct item_key, pk, grade, calibration, irt_model, scaled_points from v_items"
FORMS: dict[str, str] = {
    "v_scores": f"""
select respondent, item_key, grade, calibration, irt_model, scaled_points, least(code, scaled_points) as score
from ({_CODES}) a join ({_SCORED}) d on l_partkey = pk""",
    "v_responses": f"""
select respondent, item_key, grade, calibration, irt_model, scaled_points, least(code, scaled_points) as score,
       slope, location, guessing, step1, step2, step3
from ({_CODES}) a join (
    select d.*, i.slope, i.location, i.guessing, i.step1, i.step2, i.step3 from ({_SCORED}) d join v_items i on d.item_key = i.item_key
) x on l_partkey = pk""",
    "v_references": """
select concat('P', cast(l_partkey as varchar(20))) as target_key, concat('P', cast(l_suppkey as varchar(20))) as item_key, first_place
from (select l_partkey, l_suppkey, min(l_orderkey) as first_place from lineitem where l_partkey <> l_suppkey group by 1, 2) r""",
}

# The same for the view that reads the conditions: they come first, so that rows of conditions that a query leaves out go early.
CONDITION_FORMS: dict[str, str] = {
    "v_item_level": """
select c.condition_id, c.role, c.model, i.item_key, i.grade, i.calibration, i.part_group, i.irt_model, i.scaled_points,
       case when a.pk % 10 < 6 then 'multiple_choice' else 'constructed_response' end as item_type,
       case when a.pk % 10 = 9 then 2 else 1 end as max_points, least(a.code, case when a.pk % 10 = 9 then 2 else 1 end) as points,
       case when case when a.pk % 10 = 9 then 2 else 1 end = least(a.code, case when a.pk % 10 = 9 then 2 else 1 end) then 1 else 0 end as full_credit,
       case when p.p_size % 2 = 0 then true else false end as has_figure,
       case when p.p_size % 9 <> 0 then round(p.p_retailprice / 1e1 - 5e1 + p.p_size, 4) end as percent_correct
from (
    select l_suppkey % 10 as condition_id, l_partkey as pk, max(case l_returnflag when 'R' then 2 when 'A' then 1 else 0 end) as code
    from lineitem group by 1, 2
) a join v_conditions c on a.condition_id = c.condition_id join v_items i on a.pk = i.pk join part p on a.pk = p.p_partkey""",
}

DEPENDS: dict[str, list[str]] = {}


def _dependencies(name: str) -> list[str]:
    """The views ``name`` reads, itself last, in an order that defines each before its use."""
    if name not in DEPENDS:
        text, found = VIEWS[name], []
        for other in VIEWS:
            if other != name and _mentions(text, other):
                found += [view for view in _dependencies(other) if view not in found]
        DEPENDS[name] = [*found, name]
    return DEPENDS[name]


def _mentions(text: str, name: str) -> bool:
    return any(word.strip("(),;") == name for word in text.replace(".", " ").split())


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """``sql`` prefixed with the definitions of the derived views it reads, as common table expressions."""
    extra = extra or {}
    names: list[str] = []
    for text in [*extra.values(), sql]:
        for view in VIEWS:
            if _mentions(text, view):
                names += [name for name in _dependencies(view) if name not in names]
    parts = [f"{name} as ({VIEWS[name]})" for name in names] + [f"{name} as ({text})" for name, text in extra.items()]
    return f"with {', '.join(parts)} {sql}" if parts else sql


class Tables:
    """The tables of a data folder as DataFrames, and the derived views on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES and name not in VIEWS:
            raise AttributeError(name)
        if name not in self._frames:
            if name in TABLES:
                self._frames[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                self._frames[name] = self.sql((FORMS | CONDITION_FORMS).get(name, VIEWS[name]))
        return self._frames[name]

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """A Spark SQL query over the tables and derived views it mentions, and over ``frames``."""
        known = {name: getattr(self, name) for name in [*TABLES, *VIEWS] if _mentions(text, name) and name not in frames}
        for name, frame in {**known, **frames}.items():
            frame.createOrReplaceTempView(name)
        return self.spark.sql(text)
