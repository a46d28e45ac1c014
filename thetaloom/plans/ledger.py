"""Requests, prompts, batches, results, and the layout of pages and sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

from thetaloom.operators import layout as L
from thetaloom.operators import prompts as P
from thetaloom.operators import records as D
from thetaloom.operators import validation as V
from thetaloom.operators import work as W
from thetaloom.operators.integrity import guide_categories, part_groups
from thetaloom.plans.items import GUIDES_SQL, PARTS_SQL, options_of, tasks
from thetaloom.plans.prediction import SCALES, rounded
from thetaloom.plans.registry import query
from thetaloom.session import new_path
from thetaloom.sources.files import Bundle, level_place
from thetaloom.sources.tables import Tables
from thetaloom.streaming.collect import collect_stream, outcomes

SAVED = "select request_id from v_results where outcome = 'saved'"
OPEN = "select distinct user_id as request_id from events where event_type = 'error' and value > 2e1"
LEDGER = {"o_saved": SAVED, "o_open": OPEN}


def ledger(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    return t.v_requests, t.sql(SAVED), t.sql(OPEN)


@query("c11_pending_work", "select request_id, item_key, schema_key from v_requests where request_id not in (select request_id from o_saved) and request_id not in (select request_id from o_open)", LEDGER)
def pending_work(t: Tables) -> DataFrame:
    return W.pending(*ledger(t)).select("request_id", "item_key", "schema_key")


@query(
    "c12_work_status",
    """select request_id, case when request_id in (select request_id from o_saved) then 'saved' when request_id in (select request_id from o_open) then 'in a submitted batch'
       when item_key in (select concat('k', cast(user_id + 100 as varchar)) from events) then 'saved for other inputs or settings' else 'not predicted yet' end as status from v_requests""",
    LEDGER,
)
def work_status(t: Tables) -> DataFrame:
    requests, saved, opened = ledger(t)
    other = t.events.select(F.concat(F.lit("k"), F.col("user_id") + 100).alias("item_key"))
    return W.work_status(requests, saved, opened, other).select("request_id", "status")


@query("h1_ranking", "select target_key, item_key, row_number() over (partition by target_key order by case when first_place < 5000 then 0 else 1 end, item_key) as rank from v_references")
def ranking(t: Tables) -> DataFrame:
    """1-based ranks over two ordered lists one after the other."""
    from pyspark.sql import Window

    source = F.when(F.col("first_place") < 5000, 0).otherwise(1)
    order = Window.partitionBy("target_key").orderBy(source, "item_key")
    return t.v_references.select("target_key", "item_key", F.row_number().over(order).alias("rank"))


@query(
    "h3_fixed_shuffle",
    """select request_id from v_requests where request_id not in (select request_id from o_saved) and request_id not in (select request_id from o_open)
       order by sha256(concat('0:', cast(request_id as varchar))), request_id limit 50""",
    LEDGER,
)
def fixed_shuffle(t: Tables) -> DataFrame:
    """A capped run in the fixed pseudo-random order."""
    return W.pending(*ledger(t), cap=50).select("request_id")


@query(
    "h4_request_chunks",
    """select schema_key, request_id, cast(floor((row_number() over (partition by schema_key order by request_id) - 1) / 2e2) as bigint) as chunk
       from v_requests where request_id not in (select request_id from o_saved) and request_id not in (select request_id from o_open)""",
    LEDGER,
)
def request_chunks(t: Tables) -> DataFrame:
    return W.chunked(W.pending(*ledger(t)), "schema_key", "request_id", 200).select("schema_key", "request_id", "chunk")


UNITS_SQL = "select l_suppkey as schema_key, l_orderkey as unit_id, count(*) as n from lineitem group by 1, 2"


@query(
    "h5_next_fit_batches",
    """select schema_key, unit_id, n, batch from (with recursive o as (select schema_key, unit_id, n, row_number() over (partition by schema_key order by unit_id) as i from o_units),
       f(schema_key, i, unit_id, n, fill, batch) as (select schema_key, i, unit_id, n, n, cast(0 as bigint) from o where i = 1
       union all select o.schema_key, o.i, o.unit_id, o.n, case when f.fill + o.n <= 40 then f.fill + o.n else o.n end, f.batch + case when f.fill + o.n <= 40 then 0 else 1 end from f join o on o.schema_key = f.schema_key and o.i = f.i + 1)
       select * from f) x""",
    {"o_units": UNITS_SQL},
)
def next_fit_batches(t: Tables) -> DataFrame:
    units = W.next_fit(t.sql(UNITS_SQL), "schema_key", "unit_id", "n", 40)
    return units.select("schema_key", F.col("unit_id").cast("bigint").alias("unit_id"), "n", "batch")


WORDS_SQL = "select l_orderkey as page, l_linenumber as seq, l_quantity - 1e0 as y0, l_quantity + 1e0 as y1, l_extendedprice / 1e2 as x0, concat('w', cast(l_partkey as varchar(20))) as word, l_suppkey as tie from lineitem"


LINES_SQL = """select page, center, line from (with recursive c as (select page, center, row_number() over (partition by page order by center) as i from (select distinct page, (y0 + y1) / 2 as center from o_words) d),
       f(page, i, center, anchor, line) as (select page, i, center, center, cast(0 as bigint) from c where i = 1
       union all select c.page, c.i, c.center, case when c.center - f.anchor < 4e0 then f.anchor else c.center end, f.line + case when c.center - f.anchor < 4e0 then 0 else 1 end from f join c on c.page = f.page and c.i = f.i + 1)
       select * from f) x"""


@query(
    "h6_anchored_lines",
    LINES_SQL,
    {"o_words": WORDS_SQL},
)
def anchored_lines(t: Tables) -> DataFrame:
    words = t.sql(WORDS_SQL).withColumn("center", L.center("y0", "y1"))
    return L.lines(words, "page", "center").select("page", "center", "line").distinct()


@query(
    "h6_line_text",
    f"select w.page, f.line, string_agg(w.word, ' ' order by w.x0, w.tie, w.word) as text from o_words w join ({LINES_SQL}) f on w.page = f.page and (w.y0 + w.y1) / 2 = f.center group by w.page, f.line",
    {"o_words": WORDS_SQL},
)
def line_text(t: Tables) -> DataFrame:
    words = t.sql(WORDS_SQL).withColumn("center", L.center("y0", "y1"))
    return L.line_text(L.lines(words, "page", "center"), "page", "x0", "word", "tie")


BLOCKS_SQL = "select l_partkey as page, l_orderkey * 10 + l_linenumber as y, max(case l_returnflag when 'R' then ' Main Topic ' when 'A' then 'Key' else concat('value  ', cast(l_suppkey as varchar(20))) end) as text from lineitem group by 1, 2"


@query(
    "h7_labelled_values",
    r"""select page, label, value from (select page, trim(text) as label, trim(regexp_replace(lead(text) over (partition by page order by y), '\s+', ' ', 'g')) as value from o_blocks) x where label in ('Main Topic', 'Key') and value is not null""",
    {"o_blocks": BLOCKS_SQL},
)
def labelled_values(t: Tables) -> DataFrame:
    return L.labelled_values(t.sql(BLOCKS_SQL), "page", "y", "text", ["Content Domain", "Main Topic", "Cognitive Domain", "Key"])


PLACES_SQL = "select l_suppkey as page, l_quantity / 1e1 as x0, l_discount * 2e1 as y0, l_returnflag as word, min(l_orderkey * 10 + l_linenumber) as seq from lineitem group by 1, 2, 3, 4"


@query("h9_first_at_place", "select page, word, min(seq) as seq from o_places group by page, word, round_even(x0, 0), round_even(y0, 0)", {"o_places": PLACES_SQL})
def first_at_place(t: Tables) -> DataFrame:
    return L.first_at_place(t.sql(PLACES_SQL), "page", "x0", "y0", "word", "seq").select("page", "word", "seq")


CELLS_SQL = """
select concat('S', cast(o_custkey as varchar(20))) as sheet, l_orderkey * 10 + k.row_kind as sheet_row, l_linenumber as col,
       max(case k.row_kind when 0 then concat('Number (M', lpad(cast(l_partkey as varchar(9)), 6, '0'), ')') when 3 then null when 5 then null
           else case when l_returnflag = 'N' and k.row_kind = 2 then 'N/A' when l_returnflag = 'A' and k.row_kind = 4 then ' — ' else cast(cast(l_quantity + k.row_kind as int) as varchar(9)) end end) as value
from lineitem join orders on l_orderkey = o_orderkey cross join (select 0 as row_kind union all select 1 union all select 2 union all select 3 union all select 4 union all select 5) k group by 1, 2, 3
union all
select concat('S', cast(o_custkey as varchar(20))), o_orderkey * 10 + k.row_kind, 0,
       case k.row_kind when 0 then 'Item classification (and item number)' when 1 then ' International average' when 2 then 'United States' when 3 then 'Benchmarking participants ' when 4 then 'Province' else 'Average score not compared' end
from orders cross join (select 0 as row_kind union all select 1 union all select 2 union all select 3 union all select 4 union all select 5) k"""


# The same cells with a line item once in the aggregation, by its numbers, and not once for each kind of row.
CELLS_FORM = f"""
select concat('S', cast(o_custkey as varchar(20))) as sheet, l_orderkey * 10 + row_kind as sheet_row, l_linenumber as col, value
from (select o_custkey, l_orderkey, l_linenumber, max(concat('Number (M', lpad(cast(l_partkey as varchar(9)), 6, '0'), ')')) as v0,
             max(cast(cast(l_quantity + 1 as int) as varchar(9))) as v1,
             max(case when l_returnflag = 'N' then 'N/A' else cast(cast(l_quantity + 2 as int) as varchar(9)) end) as v2,
             max(case when l_returnflag = 'A' then ' — ' else cast(cast(l_quantity + 4 as int) as varchar(9)) end) as v4
      from lineitem join orders on l_orderkey = o_orderkey group by 1, 2, 3) x
lateral view stack(6, 0, v0, 1, v1, 2, v2, 3, null, 4, v4, 5, null) k as row_kind, value
{CELLS_SQL[CELLS_SQL.index("union all" + chr(10)):]}"""


@query(
    "a8_block_melt",
    """select sheet, i.item_id, max(case when kind = 1 then v end) as pct_correct_intl_avg, max(case when kind = 2 then v end) as pct_correct_home, count(case when kind in (2, 4) then 1 end) as education_systems,
       count(case when kind = 4 then 1 end) as benchmarking_participants from (select sheet, sheet_row // 10 as block, sheet_row % 10 as kind, col,
       case when trim(value) not in ('N/A', '—', '.') then try_cast(trim(value) as double) end as v from o_cells where col > 0) c
       join (select sheet as s, sheet_row // 10 as b, col as k, substr(value, 9, 7) as item_id from o_cells where col > 0 and sheet_row % 10 = 0) i on c.sheet = i.s and c.block = i.b and c.col = i.k
       where kind in (1, 2, 4) group by sheet, i.item_id""",
    {"o_cells": CELLS_SQL},
)
def block_melt(t: Tables) -> DataFrame:
    return L.item_averages(L.block_percent_correct(t.sql(CELLS_FORM)))


@query("a9_harmonized_topics", """select concat('I', cast(p_partkey as varchar(20))) as item_id, p_type as domain, p_brand as spelling, upper(p_brand) as topic from part where p_size % 5 <> 0""")
def harmonized_topics(t: Tables) -> DataFrame:
    info = t.part.select(
        F.concat(F.lit(" I"), "p_partkey", F.lit(" ")).alias("Item  ID"), F.expr("case when p_size % 5 = 0 then 'S ' else ' M' end").alias("Subject"),
        F.concat(F.lit(" "), "p_type").alias("Content Domain"), F.expr("concat(p_brand, case when p_size % 2 = 0 then '  ' else '' end)").alias("Topic  Area"),
    )
    names = t.part.select(F.col("p_type").alias("domain"), F.col("p_brand").alias("spelling"), F.upper("p_brand").alias("topic")).distinct()
    rows, _, _ = L.harmonized(info, names)
    return rows.select("item_id", "domain", "spelling", "topic")


@query(
    "j1_word_coverage",
    r"""select page_id, round(1e0 - len(missing) * 1e0 / len(words), 6) as coverage, array_to_string(missing, ' ') as missing_words from (
        select page_id, words, list_filter(words, lambda w: not contains(target, w)) as missing from (
        select page_id, regexp_replace(lower(text), '[^0-9a-z]', '', 'g') as target, list_filter(list_transform(string_split_regex(trim(regexp_replace(html, '\s+', ' ', 'g')), '\s+'), lambda w: regexp_replace(lower(w), '[^0-9a-z]', '', 'g')), lambda w: length(w) >= 3) as words
        from pages join documents on page_id = doc_id) x) y where len(missing) > 0""",
)
def word_coverage(t: Tables) -> DataFrame:
    """Words of each web page that the document of the same number lacks."""
    pairs = t.pages.join(t.documents.select(F.col("doc_id").alias("page_id"), "text"), "page_id")
    return rounded(L.coverage(pairs, "page_id", "html", "text"))


@query("c14_crossing", "select item_key, condition_id, role, cast(row_number() over (partition by item_key order by role desc, condition_id) - 1 as int) as condition_order from v_items cross join v_conditions")
def crossing(t: Tables) -> DataFrame:
    """Every item in every condition, the test takers first."""
    conditions = t.v_conditions.select("condition_id", "role", F.when(F.col("role") == "student", 1).otherwise(0).alias("o"))
    return D.crossed(t.v_items.select("item_key"), conditions, ["o", "condition_id"]).select("item_key", "condition_id", "role", "condition_order")


@query("c19_condition_clashes", "select 'test_taker' as role, 'vendor0/model-3' as model, 'missing' as side union all select 'student', 'vendor0/model-3', 'missing' union all select distinct role, model, 'not a condition' from v_conditions where model = 'vendor1/model-3'")
def condition_clashes(t: Tables) -> DataFrame:
    models = ["vendor0/model-0", "vendor1/model-1", "vendor0/model-2", "vendor0/model-3", "vendor0/model-4"]
    return W.missing_conditions({"role": ["test_taker", "student"], "model": models}, t.v_conditions)


@query("c19_duplicate_labels", "select model as label from v_conditions group by model having count(*) > 1")
def duplicate_labels(t: Tables) -> DataFrame:
    return W.duplicate_labels(t.v_conditions.withColumnRenamed("model", "label"), "label")


def unit_items(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    position = F.row_number().over(Window.partitionBy("grade", "part_group").orderBy("pk"))
    keyed = t.v_items.select("item_key", "pk", F.concat_ws("/", "grade", "part_group").alias("unit_key"), position.alias("position"))
    return W.answer_fields(keyed, ["unit_key"], "position")


UNIT_SQL = """select item_key, pk, concat(cast(grade as varchar(5)), '/', cast(part_group as varchar(20))) as unit_key, row_number() over (partition by grade, part_group order by pk) as position,
    case when count(*) over (partition by grade, part_group) = 1 then 'answer' else concat('answer_', cast(row_number() over (partition by grade, part_group order by pk) as varchar(5))) end as field from v_items"""


@query("b26_answer_fields", "select unit_key, item_key, field from o_unit", {"o_unit": UNIT_SQL})
def answer_fields(t: Tables) -> DataFrame:
    return unit_items(t).select("unit_key", "item_key", "field")


@query("c15_unit_answers", "select unit_key, item_key, field, substr('ABCD', cast(1 + pk % 4 as int), 1) as answer from o_unit", {"o_unit": UNIT_SQL})
def unit_answers(t: Tables) -> DataFrame:
    """Stored outputs per unit, one JSON object each, opened into one answer per item."""
    units = unit_items(t)
    letters = F.map_from_entries(F.collect_list(F.struct("field", F.expr("substr('ABCD', cast(1 + pk % 4 as int), 1)"))))
    outputs = units.groupBy("unit_key").agg(F.to_json(letters).alias("output"))
    return W.unit_answers(outputs, units.select("unit_key", "item_key", "field")).select("unit_key", "item_key", "field", "answer")


OUTPUTS_SQL = """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_partkey % 10 < 6 then '3PL' when l_partkey % 10 < 9 then '2PL' else 'GPCM' end as irt_model, case when l_tax > 7e-2 then 'length' else 'stop' end as finish_reason,
       case l_linenumber when 3 then '{"slope": 1.5, "loc' when 4 then '  ' else concat('{"reasoning": "why", "slope": ', cast(cast(l_quantity as int) - 3 as varchar(9)), '.5',
            case when l_linenumber = 2 then '' else ', "location": 0.25' end, ', "guessing": ', case when l_discount > 9e-2 then '1.2' else '0.2' end, case when l_linenumber = 5 then '' else ', "step1": 0.5' end, '}') end as output
from lineitem"""
REASON_SQL = """case when finish_reason = 'length' then 'cut off' when trim(output) = '' then 'no output' when not json_valid(output) then 'not the expected JSON'
    when json_extract(output, '$.location') is null or (irt_model = 'GPCM' and json_extract(output, '$.step1') is null) then 'a parameter is missing'
    when cast(json_extract(output, '$.slope') as double) < 0 then 'slope below 0' when irt_model = '3PL' and cast(json_extract(output, '$.guessing') as double) > 1 then 'guessing outside 0 to 1' end"""


@query("b27_output_validation", f"select irt_model, reason, n from (select irt_model, coalesce({REASON_SQL}, 'usable') as reason, count(*) as n from o_out group by 1, 2) x", {"o_out": OUTPUTS_SQL})
def output_validation(t: Tables) -> DataFrame:
    _, reason = V.prediction_status("output", "irt_model", "finish_reason")
    return t.sql(OUTPUTS_SQL).groupBy("irt_model", F.coalesce(reason, F.lit("usable")).alias("reason")).agg(F.count("*").alias("n"))


@query("c20_recheck_stored", f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, reason from (select *, {REASON_SQL} as reason from o_out) x where reason is not null", {"o_out": OUTPUTS_SQL})
def recheck_stored(t: Tables) -> DataFrame:
    """Stored outputs checked again: those that fail are pending again."""
    _, reason = V.prediction_status("output", "irt_model", "finish_reason")
    return W.recheck(t.sql(OUTPUTS_SQL), reason).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "reason")


ALLOWED = {
    "o_items": "select distinct item_key, item_type, max_points from v_answers",
    "o_allowed": """select item_key, 'answer' as field, letter as value from o_items join (select 'A' as letter union all select 'B' union all select 'C') l on item_type = 'multiple_choice'
        union all select item_key, 'answer', null from o_items where item_type <> 'multiple_choice'
        union all select item_key, 'category', category from o_items join (select 'Correct Response' as category union all select 'Incorrect Response') c on item_type <> 'multiple_choice'
        union all select item_key, 'category', 'Partial Response' from o_items where item_type <> 'multiple_choice' and item_key like '%9'""",
    "o_given": """select condition_id, l_orderkey, l_linenumber, item_key, 'answer' as field, answer as value from v_answers
        union all select condition_id, l_orderkey, l_linenumber, item_key, 'category', category from v_answers where item_type <> 'multiple_choice' or l_linenumber = 7""",
}


@query(
    "b27_answer_validation",
    """select * from (select g.condition_id, g.l_orderkey, g.l_linenumber, g.item_key, g.field, g.value, case when not exists (select 1 from o_allowed a where a.item_key = g.item_key and a.field = g.field) then 'unexpected field'
       when value is null or trim(value) = '' then 'no output' when not exists (select 1 from o_allowed a where a.item_key = g.item_key and a.field = g.field and (a.value is null or a.value = g.value)) then 'not an allowed value' end as reason from o_given g) x
       where reason is not null""",
    ALLOWED,
)
def answer_validation(t: Tables) -> DataFrame:
    """Option letters beside the item's options, empty answers, and scorers' categories that the guide does not have."""
    items = t.sql(ALLOWED["o_items"])
    return V.answer_problems(t.sql(ALLOWED["o_given"]), t.sql(ALLOWED["o_allowed"], o_items=items))


QUESTIONS_SQL = "select item_key, parameter, case when irt_model = '3PL' then 7 else 6 end as criteria from v_items join (select 'slope' as parameter union all select 'location') p on true"
PROBS_SQL = """select concat('P', cast(l_partkey as varchar(20))) as item_key, case when l_returnflag = 'R' then 'slope' when l_returnflag = 'A' then 'location' else 'guessing' end as parameter, l_linenumber - 1 as position,
    round(sum(l_tax), 4) as probability from lineitem group by 1, 2, 3"""


@query(
    "b28_probability_answers",
    """select coalesce(q.item_key, a.item_key) as item_key, coalesce(q.parameter, a.parameter) as parameter, case when n is null then concat('no answer to ', q.parameter) when criteria is null then concat('unexpected answer ', a.parameter)
       when not (n = criteria and low = 0 and high = criteria - 1) then concat(q.parameter, ' has probabilities off the rubric') else concat(q.parameter, '''s probabilities do not sum to 1') end as problem
       from o_questions q full outer join (select item_key, parameter, count(distinct position) as n, min(position) as low, max(position) as high, sum(probability) as s from o_probs group by 1, 2) a on q.item_key = a.item_key and q.parameter = a.parameter
       where n is null or criteria is null or not (n = criteria and low = 0 and high = criteria - 1) or abs(s - 1) > 5e-2""",
    {"o_questions": QUESTIONS_SQL, "o_probs": PROBS_SQL},
)
def probability_answers(t: Tables) -> DataFrame:
    return V.probability_answer_problems(t.sql(QUESTIONS_SQL), t.sql(PROBS_SQL), ["item_key"])


BODIES_SQL = """select event_id, case event_type when 'error' then '{"id": "x", "choi' else concat('{"id": "', cast(event_id as varchar(20)), '", "choices": [{"finish_reason": "', case event_type when 'view' then 'length' else 'stop' end,
    '", "message": {"content": ', case event_type when 'signup' then 'null' else '"text"' end, ', "reasoning": "because"}}], "usage": {"prompt_tokens": ', cast(user_id as varchar(20)), ', "completion_tokens": 7, "completion_tokens_details": {"reasoning_tokens": 2}}}') end as body from events"""


@query(
    "b31_flat_responses",
    """select e.event_id, case when event_type in ('error', 'signup') then null else 'text' end as content, case event_type when 'error' then null when 'view' then 'length' else 'stop' end as finish_reason,
       case when event_type <> 'error' then user_id end as prompt_tokens, cast(case when event_type <> 'error' then 2 end as bigint) as reasoning_tokens,
       case when event_type = 'error' then 'no response' when user_id + 7 >= 1200 then 'context window is full' when event_type = 'view' then 'cut off' when event_type = 'signup' then 'no content' end as unusable from events e""",
)
def flat_responses(t: Tables) -> DataFrame:
    fields = V.flat_response("body", context_window=1200)
    names = ["content", "finish_reason", "prompt_tokens", "reasoning_tokens", "unusable"]
    return t.sql(BODIES_SQL).select("event_id", *[fields[name].alias(name) for name in names])


SETTINGS_SQL = """select c_custkey, concat('[{"model": "m', cast(c_nationkey as varchar(5)), '", "reasoning_effort": "high"', case when c_custkey % 4 = 0 then ', "roles": ["student"]' else '' end, '}, {',
    case when c_custkey % 5 = 0 then '"temperature": "1", "model": "x"' when c_custkey % 7 = 0 then '"reasoning_effort": "low"' else '"model": "y"' end, '}]') as settings from customer"""


@query(
    "c21_conditions_from_settings",
    """select c_custkey, 0 as position, concat('m', cast(c_nationkey as varchar(5))) as model, 'high' as reasoning_effort, role from customer join (select 'test_taker' as role union all select 'student') r on role = 'student' or c_custkey % 4 <> 0
       union all select c_custkey, 1, 'y', null, role from customer cross join (select 'test_taker' as role union all select 'student') r where c_custkey % 5 <> 0 and c_custkey % 7 <> 0""",
)
def conditions_from_settings(t: Tables) -> DataFrame:
    good, _ = W.conditions_from_settings(t.sql(SETTINGS_SQL), "settings", ["model", "reasoning_effort"], ["test_taker", "student"])
    return good


@query("c21_settings_violations", "select c_custkey, 1 as position, case when c_custkey % 5 = 0 then 'unknown settings temperature' else 'no model' end as rule from customer where c_custkey % 5 = 0 or c_custkey % 7 = 0")
def settings_violations(t: Tables) -> DataFrame:
    _, bad = W.conditions_from_settings(t.sql(SETTINGS_SQL), "settings", ["model", "reasoning_effort"], ["test_taker", "student"])
    return bad


# --- prompts --------------------------------------------------------------------------------------------------------

def released_questions(t: Tables) -> DataFrame:
    rows = t.v_released.withColumns({"options": options_of(), "figure": F.lit(None).cast("string")})
    return rows.withColumn("question", P.question_text("stem", "figure", F.col("options")))


@query(
    "b23_test_prompts",
    """select part_group, count(*) as questions, sha256(case when count(*) = 1 then min(q) else concat('Work through all ', cast(count(*) as varchar), ' questions below in order.', chr(10), chr(10),
       string_agg(concat('### ', cast(i as varchar), ' of ', cast(n as varchar), chr(10), chr(10), q), concat(chr(10), chr(10)) order by i), chr(10), chr(10), 'Give ', cast(count(*) as varchar), ' answers, one for each question.') end) as prompt_hash from (
       select part_group, row_number() over (partition by part_group order by doc_id) as i, count(*) over (partition by part_group) as n, concat(stem, case when item_type = 'multiple_choice' then concat(chr(10), chr(10), 'A. ', option_a, chr(10), 'B. ', option_b, chr(10), 'C. ', option_c) else '' end) as q
       from o_parts) x group by part_group""",
    {"o_parts": PARTS_SQL},
)
def test_prompts(t: Tables) -> DataFrame:
    prompts = P.unit_prompts(part_groups(released_questions(t), tasks(t)), "part_group", "doc_id", "question")
    return prompts.select("part_group", "questions", F.sha2("user_prompt", 256).alias("prompt_hash"))


@query("b23_prompt_leaks", "select doc_id, 'item_id' as field from v_released where contains(stem, item_id) or max_points = 2")
def prompt_leaks(t: Tables) -> DataFrame:
    """Prompts that show the ID of their item: here a planted fault of the items worth 2 points."""
    items = released_questions(t).withColumn("question", F.expr("case when max_points = 2 then concat(question, ' ', item_id) else question end"))
    prompts = P.unit_prompts(items, "doc_id", "doc_id", "question")
    return P.leaks(prompts, items, "doc_id", ["item_id"])


REFERENCE_ITEMS = 5
PREDICTED_FROM = {
    "o_spread": """select grade, irt_model, scaled_points, round(avg(location), 3) as mean, round(stddev_samp(location), 3) as sd, round(min(location), 3) as low, round(max(location), 3) as high from v_items group by 1, 2, 3""",
    "o_linked": """select target_key, r.item_key, row_number() over (partition by target_key order by first_place, r.item_key) as rank, concat('Reference item ', r.item_key, ': slope (a) = ', printf('%.3f', slope), ', location (b) = ', printf('%.3f', location),
        case irt_model when '3PL' then concat(', guessing (c) = ', printf('%.3f', guessing)) when 'GPCM' then concat(', step 1 (d_1) = ', printf('%.3f', step1), ', step 2 (d_2) = ', printf('%.3f', step2)) else '' end) as block
        from v_references r join v_items i on r.item_key = i.item_key""",
    "o_blocks": f"select target_key, string_agg(block, concat(chr(10), chr(10)) order by rank) as reference_text from o_linked where rank <= {REFERENCE_ITEMS} group by 1",
}


@query(
    "b22_prediction_prompts",
    """select i.item_key, concat('You predict the parameters of mathematics items for grade ', i.grade, '.') as system_prompt,
       concat('Locations: mean ', mean, ', sd ', coalesce(cast(sd as varchar), ''), ', from ', low, ' to ', high, '.', chr(10), chr(10), coalesce(reference_text, ''), chr(10), chr(10), 'New item, scored with ', i.irt_model, ', on the scale of ', calibration, '.') as user_prompt
       from v_items i join o_spread s on i.grade = s.grade and i.irt_model = s.irt_model and i.scaled_points = s.scaled_points left join o_blocks b on i.item_key = b.target_key""",
    PREDICTED_FROM,
)
def prediction_prompts(t: Tables) -> DataFrame:
    """System and user prompt of each item: the summary of its scoring group, its reference items in order, the item."""
    from thetaloom.functions.scoring import model_parameters
    from thetaloom.operators.errors import SCORING, distribution

    summary = distribution(t.v_items, SCORING, "location")
    linked = t.v_references.join(t.v_items, "item_key")
    values = {name: name for name in ("slope", "location", "guessing", "step1", "step2")}
    block = F.concat(F.lit("Reference item "), "item_key", F.lit(": "), P.parameters_text(model_parameters("irt_model", "scaled_points"), values))
    blocks = P.reference_blocks(linked, block, REFERENCE_ITEMS, ("first_place", "item_key")).withColumnRenamed("target_key", "item_key")
    items = t.v_items.select("item_key", *SCORING, "calibration").join(summary.drop("items"), SCORING).join(blocks, "item_key", "left")
    system = P.by_value("grade", {g: "You predict the parameters of mathematics items for grade {grade}." for g in (4, 8, 12)})
    user = P.filled("Locations: mean {mean}, sd {sd}, from {min} to {max}.\n\n{reference_text}\n\nNew item, scored with {irt_model}, on the scale of {calibration}.")
    return items.select("item_key", system.alias("system_prompt"), user.alias("user_prompt"))


@query(
    "b24_scorer_prompts",
    r"""select r.item_key, r.answer, concat('# Scoring guide', chr(10), chr(10), guide, chr(10), chr(10), '# Response', chr(10), chr(10), r.answer) as user_prompt from (
        select distinct item_key, answer from v_answers where item_type = 'constructed_response' and trim(answer) <> '') r join (
        select item_key, coalesce(string_agg(concat('- ', category, ' (', cast(points as varchar), case when points = 1 then ' point)' else ' points)' end), chr(10) order by position) filter (where points is not null), '') as guide from (
        select item_key, position, category, case when lower(name) like 'incorrect%' then 0 when lower(name) like 'partial%' and top >= 2 then top - 1 when lower(name) like 'correct%' then top end as points from (
        select *, case when regexp_matches(category, '^M\d{6}[A-Z] ') then regexp_extract(category, '^(M\d{6}[A-Z]) (.+)$', 2) else category end as name,
        case when regexp_matches(category, '^M\d{6}[A-Z] ') then 1 else max_points end as top from o_guides) x) y group by 1) g on r.item_key = g.item_key""",
    {"o_guides": GUIDES_SQL},
)
def scorer_prompts(t: Tables) -> DataFrame:
    """The guide of each item with the points of its categories, and each distinct response to it."""
    guides = P.guide_text(guide_categories(t.sql(GUIDES_SQL)))
    responses = t.v_answers.filter("item_type = 'constructed_response' and trim(answer) <> ''").select("item_key", "answer").distinct()
    return responses.join(guides, "item_key").select("item_key", "answer", P.filled("# Scoring guide\n\n{guide}\n\n# Response\n\n{answer}").alias("user_prompt"))


@query(
    "b25_scale_questions",
    """select item_key, parameter, concat('Which value is closest to the ', parameter, '?') as question, case parameter when 'slope' then 9 when 'location' then 10 when 'guessing' then 6 else 8 end as n_criteria,
       concat('{"grade":', cast(grade as varchar), ',"irt_model":"', irt_model, '","calibration":"', calibration, '"}') as state from v_items
       join (select 'slope' as parameter union all select 'location' union all select 'guessing' union all select 'step1') p on parameter in ('slope', 'location') or (parameter = 'guessing' and irt_model = '3PL') or (parameter = 'step1' and irt_model = 'GPCM')""",
)
def scale_questions(t: Tables) -> DataFrame:
    criteria = {name: [str(v) for v in values] for name, values in SCALES.items()}
    questions = {name: f"Which value is closest to the {name}?" for name in SCALES}
    items = t.v_items.withColumn("note", F.lit(None).cast("string"))
    rows = P.scale_questions(items, criteria, questions, ["grade", "irt_model", "calibration", "note"])
    return rows.select("item_key", "parameter", "question", F.size("criteria").alias("n_criteria"), "state")


@query(
    "b32_request_bodies",
    """select concat_ws('-', cast(conv_id as varchar), cast(turn as varchar)) as custom_id, 'system,user' as roles, sha256(role) as system_sha256, sha256(text) as user_sha256, concat('model-', cast(turn % 2 as varchar)) as model,
       4096 as max_tokens, concat('answer-', cast(turn % 3 as varchar)) as output_schema from conversations""",
)
def request_bodies(t: Tables) -> DataFrame:
    """Request lines written as JSON text and read back: the messages, the model, the cap and the schema of the output."""
    prompts = t.conversations.select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"), F.col("role").alias("system_prompt"), F.col("text").alias("user_prompt"),
        F.concat(F.lit("model-"), F.col("turn") % 2).alias("model"),
        F.struct(F.lit("json_schema").alias("type"), F.concat(F.lit("answer-"), F.col("turn") % 3).alias("name")).alias("schema"),
    )
    path = new_path(t.spark, "bodies")
    P.write_request_bodies(P.request_bodies(prompts, "request_id", "model", 4096, "schema"), path)
    body = "messages: array<struct<role: string, content: string>>, model: string, max_tokens: int, response_format: struct<type: string, name: string>"
    lines = t.spark.read.schema(f"custom_id string, body struct<{body}>").json(path)
    content = lambda at: F.sha2(F.col("body.messages")[at].content, 256)
    return lines.select(
        "custom_id", F.array_join("body.messages.role", ",").alias("roles"), content(0).alias("system_sha256"), content(1).alias("user_sha256"),
        "body.model", "body.max_tokens", F.col("body.response_format.name").alias("output_schema"),
    )


# --- results --------------------------------------------------------------------------------------------------------

SUBMITTED_SQL = """select c_custkey + 20 as request_id, c_nationkey as run_id, concat('b', cast(c_nationkey as varchar(5))) as batch_id, case when c_nationkey % 6 = 5 then 'in_progress' when c_nationkey % 6 = 4 then 'expired' else 'completed' end as batch_status from customer"""
ARRIVED_SQL = """select request_id, event_id, case outcome when 'error' then 500 else 200 end as status_code, cast(null as varchar(9)) as error, case outcome when 'unusable' then 'no content' end as unusable, round(cost_usd, 2) as cost_usd from v_results"""
COLLECT = {"o_sub": SUBMITTED_SQL, "o_arr": ARRIVED_SQL, "o_first": "select * from (select *, row_number() over (partition by request_id order by event_id) as k from o_arr) x where k = 1"}
OUTCOME_SQL = """select s.request_id, s.run_id, batch_id, case when q.request_id is null then 'not saved: the request has changed since it was submitted' when r.status_code is null then concat('no result: the batch ', batch_status)
    when r.status_code <> 200 then 'failed' when unusable is not null then 'unusable' else 'saved' end as outcome, r.cost_usd
    from o_sub s left join v_requests q on s.request_id = q.request_id left join o_first r on s.request_id = r.request_id where batch_status <> 'in_progress'"""
ARRIVED = K.StructType([K.StructField(n, k) for n, k in [("request_id", K.LongType()), ("event_id", K.LongType()), ("status_code", K.IntegerType()), ("error", K.StringType()), ("unusable", K.StringType()), ("cost_usd", K.DoubleType())]])
OUTCOME = ["request_id", "run_id", "batch_id", "outcome", "cost_usd"]


def arrived(t: Tables) -> DataFrame:
    rows = t.sql(ARRIVED_SQL)
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ARRIVED])


def batch_outcomes(t: Tables) -> DataFrame:
    return W.collected(t.sql(SUBMITTED_SQL), t.v_requests, W.first_results(arrived(t), "event_id"))


@query("k1_collected_results", OUTCOME_SQL, COLLECT)
def collected_results(t: Tables) -> DataFrame:
    return batch_outcomes(t).select(*OUTCOME)


@query("k1_collected_stream", OUTCOME_SQL, COLLECT)
def collected_stream(t: Tables) -> DataFrame:
    """The same from a file stream that works through the arriving files a few at a time."""
    source, out, checkpoint = (new_path(t.spark, name) for name in ("arriving", "collected", "stream"))
    arrived(t).repartitionByRange(6, "event_id").write.json(source)
    collect_stream(t.spark, source, ARRIVED, out, checkpoint, files_per_trigger=2).awaitTermination()
    return outcomes(t.spark, out, ARRIVED, "event_id", t.sql(SUBMITTED_SQL), t.v_requests).select(*OUTCOME)


SUBMISSIONS_SQL = """select event_id as submission_id, event_type as model, user_id % 40 as n_requests, ts as submitted_at from events where value > 9e1"""
CANDIDATES_SQL = """select concat('b', cast(event_id as varchar(20))) as batch_id, event_type as model, user_id % 40 as n_requests, ts as created_at from events where value < 3e1"""
KNOWN_SQL = "select concat('b', cast(event_id as varchar(20))) as batch_id from events where value < 2e1"


@query(
    "k2_reconciled_submissions",
    """select submission_id, case when n > 1 then 'conflict' when n = 1 then 'adopt' else 'drop' end as action, case when n = 1 then batch end as batch_id from (
       select s.submission_id, count(c.batch_id) as n, min(c.batch_id) as batch from o_subm s left join (select * from o_cand where batch_id not in (select batch_id from o_known)) c
       on s.model = c.model and s.n_requests = c.n_requests and c.created_at >= s.submitted_at - interval 60 second group by 1) x""",
    {"o_subm": SUBMISSIONS_SQL, "o_cand": CANDIDATES_SQL, "o_known": KNOWN_SQL},
)
def reconciled_submissions(t: Tables) -> DataFrame:
    return W.reconcile(t.sql(SUBMISSIONS_SQL), t.sql(CANDIDATES_SQL), t.sql(KNOWN_SQL)).select("submission_id", "action", "batch_id")


REPORTED_SQL = f"""select run_id, outcome, cost_usd from ({OUTCOME_SQL}) o
    union all select run_id, 'in a batch', null from o_sub where batch_status = 'in_progress'
    union all select run_id, 'missing', null from v_requests where request_id not in (select request_id from ({OUTCOME_SQL}) o where outcome = 'saved')
        and request_id not in (select request_id from o_sub where batch_status = 'in_progress')"""


@query(
    "k3_run_report",
    """select run_id, count(case when outcome not in ('in a batch', 'missing') then 1 end) as requested, count(case when outcome = 'saved' then 1 end) as saved, count(case when outcome = 'failed' or outcome like 'no result%' then 1 end) as failed,
        count(case when outcome = 'unusable' then 1 end) as unusable, count(case when outcome like 'not saved%' then 1 end) as changed, count(case when outcome = 'in a batch' then 1 end) as in_batches, count(case when outcome = 'missing' then 1 end) as missing,
        round(sum(cost_usd), 4) as cost_usd, count(case when outcome = 'saved' and cost_usd is null then 1 end) as uncosted from o_reported group by run_id""",
    {**COLLECT, "o_reported": REPORTED_SQL},
)
def run_report(t: Tables) -> DataFrame:
    return rounded(W.run_report(batch_outcomes(t), "run_id", t.sql(SUBMITTED_SQL), t.v_requests), 4)


@query("k4_open_request_ids", "select batch_id, cast(request_id as varchar) as request_id from o_sub where batch_status = 'in_progress'", COLLECT)
def open_request_ids(t: Tables) -> DataFrame:
    """The requests of batches that are not collected yet are open."""
    done = F.when(F.col("batch_status") != "in_progress", "collected")
    batches = t.sql(SUBMITTED_SQL).select("batch_id", F.col("request_id").cast("string").alias("request_id"), done.alias("collected_at"))
    return W.open_request_ids(batches)


EFFORTS = ["none", "low", "medium", "high"]
MODELS = ["2PL", "3PL", "GPCM"]
BUNDLE = {
    "o_conditions": "select condition_id, role, model, provider, effort from v_conditions",
    "o_requests": "select request_id, schema_key, item_key, run_id from v_requests",
    "o_items": "select item_key, irt_model, scaled_points, slope, location, guessing, step1, step2 from v_items",
    "o_estimates": """select respondent, calibration, sum(score) as points, case when sum(score) = 0 then cast('-Infinity' as double) when sum(score) = sum(scaled_points) then cast('Infinity' as double)
        else ln(sum(score) * 1e0 / (sum(scaled_points) - sum(score))) end as estimate from v_scores group by 1, 2""",
    "o_constants": "select calibration, plausible_values, a, b from v_scale",
}


@query(
    "a7_result_bundle",
    """select 'conditions' as name, cast(condition_id as varchar) as row_key, concat(role, ' of ', model, ' by ', provider) as text, case effort when 'none' then 1 when 'high' then 4 end as place, cast(null as double) as number, cast(null as varchar) as infinite from o_conditions
       union all select 'requests', cast(request_id as varchar), concat(schema_key, ' ', item_key), null, run_id, null from o_requests
       union all select 'items', item_key, irt_model, case irt_model when '2PL' then 1 when '3PL' then 2 else 3 end, round(slope + location + coalesce(guessing, 10) + coalesce(step1 * step2, 20), 6), null from o_items
       union all select 'estimates', concat(cast(respondent as varchar), ' ', calibration), cast(points as varchar), null, case when not isinf(estimate) then round(estimate, 6) end, case when estimate = cast('Infinity' as double) then 'above' when isinf(estimate) then 'below' end from o_estimates
       union all select 'constants', calibration, cast(plausible_values as varchar), null, round(a + b, 6), null from o_constants""",
    BUNDLE,
)
def result_bundle(t: Tables) -> DataFrame:
    """Result tables through a text format: their rows, the places of ordered categories, infinite estimates, missing values."""
    bundle = Bundle(t.spark, new_path(t.spark, "bundle"))
    names = [name.removeprefix("o_") for name in BUNDLE]
    bundle.write(
        {name: t.sql(BUNDLE[f"o_{name}"]) for name in names},
        {"conditions": {"effort": EFFORTS, "role": ["student", "test_taker"]}, "items": {"irt_model": MODELS}},
    )
    place = lambda name, column: level_place(F.col(column), bundle.levels(name)[column])
    infinite = F.abs("estimate") == float("inf")
    number = F.col("slope") + F.col("location") + F.coalesce("guessing", F.lit(10)) + F.coalesce(F.col("step1") * F.col("step2"), F.lit(20))
    # Per table: row_key, text, place, number, infinite.
    rows = {
        "conditions": ("condition_id", F.concat("role", F.lit(" of "), "model", F.lit(" by "), "provider"), place("conditions", "effort"), None, None),
        "requests": ("request_id", F.concat_ws(" ", "schema_key", "item_key"), None, F.col("run_id"), None),
        "items": ("item_key", F.col("irt_model"), place("items", "irt_model"), number, None),
        "estimates": (
            F.concat_ws(" ", "respondent", "calibration"), F.col("points"), None, F.when(~infinite, F.col("estimate")),
            F.when(infinite, F.when(F.col("estimate") > 0, "above").otherwise("below")),
        ),
        "constants": ("calibration", F.col("plausible_values"), None, F.col("a") + F.col("b"), None),
    }
    columns = {"row_key": "string", "text": "string", "place": "int", "number": "double", "infinite": "string"}
    long = None
    for name, values in rows.items():
        cells = [(F.col(v) if isinstance(v, str) else F.lit(v)).cast(kind).alias(column) for v, (column, kind) in zip(values, columns.items(), strict=True)]
        table = bundle.read(name).select(F.lit(name).alias("name"), *cells)
        long = table if long is None else long.unionAll(table)
    return rounded(long)
