"""Items, their keys and texts, their parameters, groups and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thetaloom import schemas
from thetaloom.functions import keys as K
from thetaloom.functions import scoring as P
from thetaloom.functions import text as X
from thetaloom.functions.posterior import nearest_position
from thetaloom.operators import integrity as I
from thetaloom.operators import work as W
from thetaloom.operators.reporting import benchmark, scale_constants, scale_score
from thetaloom.plans.registry import query
from thetaloom.session import new_path, written
from thetaloom.sources import files
from thetaloom.sources.tables import Tables
from thetaloom.sources.vectors import VectorStore, hashed


def options_of():
    """The options of a released item as an array of structs, NULL for a constructed response."""
    pairs = [F.struct(F.lit(label).alias("label"), F.col(f"option_{label.lower()}").alias("text")) for label in "ABC"]
    return F.when(F.col("item_type") == "multiple_choice", F.array(*pairs))


def released_records(t: Tables) -> DataFrame:
    """Released items in the declared record form."""
    released = t.v_released.withColumns({"options": options_of(), "item_label": F.col("item_id")})
    known = {"grade": F.col("grade").cast("int"), "max_points": F.col("max_points").cast("int")}
    columns = [
        (known.get(f.name, F.col(f.name)) if f.name in released.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schemas.ITEM
    ]
    return released.select(*columns)


KEY_SQL = "concat(assessment, '/grade ', cast(grade as varchar(5)), '/', subject, '/', item_id)"
TEXT_SQL = """concat(stem, case when item_type = 'multiple_choice' then concat(chr(10), chr(10), 'A. ', option_a, chr(10), 'B. ', option_b, chr(10), 'C. ', option_c) else '' end)"""


@query(
    "a1_items_jsonl",
    f"""select {KEY_SQL} as item_key, grade, item_type, cast(max_points as int) as max_points, length(stem) as stem_length,
        case when item_type = 'multiple_choice' then 3 end as n_options, correct_option from v_released""",
)
def items_jsonl(t: Tables) -> DataFrame:
    """Items written as JSON lines, then read with the declared schema and unique keys."""
    path = new_path(t.spark, "items")
    files.write_items(released_records(t), path)
    items = files.read_items(t.spark, path)
    return items.select(
        "item_key", "grade", "item_type", "max_points", F.length("stem").alias("stem_length"),
        F.when(F.size("options") > 0, F.size("options")).alias("n_options"), "correct_option",
    )


@query(
    "a2_parameters_csv",
    """select item_key, irt_model, scaled_points, slope, location, guessing, step1, step2, calibration from v_items
       where pk in (select doc_id from documents)""",
)
def parameters_csv(t: Tables) -> DataFrame:
    path = new_path(t.spark, "parameters")
    items = t.v_items.withColumns(
        {"assessment": F.lit("Survey"), "subject": F.lit("Mathematics"), "item_id": F.col("item_key"), "item_type": F.lit(None).cast("string")}
    )
    columns = [(F.col(f.name) if f.name in items.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.PARAMETERS]
    items.select(*columns).write.option("header", True).csv(path)
    wanted = items.join(t.documents.select(F.col("doc_id").alias("pk")), "pk", "left_semi")
    keys = wanted.select(K.item_key("assessment", "grade", "subject", "item_id").alias("item_key"))
    table = files.read_parameters(t.spark, path, keys)
    return table.select(F.col("item_id").alias("item_key"), "irt_model", "scaled_points", "slope", "location", "guessing", "step1", "step2", "calibration")


@query(
    "a3_scale_constants",
    """select calibration, round(avg(target_mean - target_sd / theta_sd * theta_mean), 6) as a, round(avg(target_sd / theta_sd), 6) as b,
       count(*) as plausible_values, min(split_part(method, ':', 1)) as constants
       from v_constants where use_for_scoring group by calibration having count(*) = 5""",
)
def constants(t: Tables) -> DataFrame:
    """The constants as they come from a file."""
    path = new_path(t.spark, "constants")
    b = F.col("target_sd") / F.col("theta_sd")
    rows = t.v_constants.withColumns({"b": b, "a": F.col("target_mean") - b * F.col("theta_mean")})
    columns = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.CONSTANTS]
    rows.select(*columns).write.option("header", True).csv(path)
    kept, _ = scale_constants(files.read_constants(t.spark, path))
    return kept.select("calibration", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), "plausible_values", "constants")


@query("a4_saved_outputs", "select cast(event_id as varchar) as request_id, concat('k', request_id) as item_key, cost_usd, true as has_file from v_results where outcome = 'saved'")
def saved_outputs(t: Tables) -> DataFrame:
    """Saved outputs in a folder of JSON files, read with the name of the file each came from."""
    path = new_path(t.spark, "saved")
    rows = t.v_results.filter("outcome = 'saved'").select(
        F.col("event_id").cast("string").alias("request_id"), F.concat(F.lit("k"), "request_id").alias("item_key"),
        F.lit("{}").alias("output"), F.col("cost_usd"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("requested_at"),
    )
    rows.write.json(path)
    saved = files.read_saved_outputs(t.spark, path, one_per_file=False)
    return saved.select("request_id", "item_key", "cost_usd", F.endswith("file_name", F.lit(".json")).alias("has_file"))


STORED_SQL = "select text, vec_id, embedding from documents join embeddings on doc_id = vec_id where text is not null"
IDENTITY = {"model": "model-a", "dimensions": 64}


@query(
    "a5_embedding_store",
    """select sha256(text) as text_sha256, len(arg_min(embedding, vec_id)) as dimensions, round(cast(arg_min(embedding, vec_id)[1] as double), 6) as first_value, round(cast(arg_min(embedding, vec_id)[64] as double), 6) as last_value
       from o_stored where text in (select text from documents where lang <> 'fr') group by text""",
    {"o_stored": STORED_SQL},
)
def embedding_store(t: Tables) -> DataFrame:
    """Vectors by text hash of one model. Some texts are stored with an outdated vector, which the second write replaces;
    the third changes none; texts of one language are stale then and go. The rest is read by a store opened anew."""
    path = new_path(t.spark, "vectors")
    # Hashes meet the vectors, not texts; written once, since each of the store's writes reads it several times.
    texts = hashed(t.documents).select("doc_id", "text_sha256")
    stored = texts.join(t.embeddings, F.col("doc_id") == F.col("vec_id"))
    current = written(stored.groupBy("text_sha256").agg(F.min_by("embedding", "vec_id").alias("embedding")), "current")
    outdated = current.withColumn("embedding", F.reverse("embedding"))
    store = VectorStore(t.spark, path, IDENTITY)
    store.add(outdated.filter("text_sha256 < '8'"))
    store.add(current, replace=True)
    store.add(outdated)
    store.compact(t.documents.filter("lang <> 'fr'"))
    ends = {"first_value": 1, "last_value": -1}
    values = [F.round(F.element_at("embedding", place).cast("double"), 6).alias(name) for name, place in ends.items()]
    return VectorStore(t.spark, path, IDENTITY).read().select("text_sha256", F.size("embedding").alias("dimensions"), *values)


@query(
    "a6_items_writer",
    f"""select item_id, '{",".join(schemas.ITEM.fieldNames())}' as fields, cast(grade as int) as grade, content_domain, cast(max_points as int) as max_points, sha256(stem) as stem_sha256,
        case when item_type = 'multiple_choice' then concat_ws('|', 'A', option_a, 'B', option_b, 'C', option_c) end as options, correct_option from v_released""",
)
def items_writer(t: Tables) -> DataFrame:
    """The written lines: their fields in the order of the file, absent ones too, and their content."""
    path = new_path(t.spark, "records")
    files.write_items(released_records(t), path)
    lines = t.spark.read.text(path).select(F.array_join(F.json_object_keys("value"), ",").alias("fields"), F.from_json("value", schemas.ITEM).alias("r"))
    pairs = F.flatten(F.transform("r.options", lambda o: F.array(o["label"], o["text"])))
    return lines.select(
        "r.item_id", "fields", "r.grade", "r.content_domain", "r.max_points", F.sha2("r.stem", 256).alias("stem_sha256"),
        F.array_join(pairs, "|").alias("options"), "r.correct_option",
    )


@query(
    "a10_items_with_parameters",
    """select r.item_id, r.grade as grade_item, i.grade as grade_parameters, i.irt_model, i.slope, i.location
       from v_released r join v_items i on r.doc_id = i.pk""",
)
def items_with_parameters(t: Tables) -> DataFrame:
    items = t.v_released.select(F.col("doc_id").alias("pk"), "item_id", F.col("grade").alias("grade_item"))
    parameters = t.v_items.select("pk", F.col("grade").alias("grade_parameters"), "irt_model", "slope", "location")
    return items.join(parameters, "pk").drop("pk")


@query("b1_item_key", f"select doc_id, {KEY_SQL} as item_key from v_released")
def item_key(t: Tables) -> DataFrame:
    return t.v_released.select("doc_id", K.item_key("assessment", "grade", "subject", "item_id").alias("item_key"))


@query("b2_item_text", f"select doc_id, length({TEXT_SQL}) as n_chars, sha256({TEXT_SQL}) as text_hash from v_released")
def item_text(t: Tables) -> DataFrame:
    text = X.item_text("stem", options_of())
    return t.v_released.select("doc_id", F.length(text).alias("n_chars"), K.text_hash(text).alias("text_hash"))


@query("b3_base_item_id", r"select doc_id, item_id, regexp_replace(item_id, '(\d)[A-Z]$', '\1') as base_id from v_released")
def base_item_id(t: Tables) -> DataFrame:
    return t.v_released.select("doc_id", "item_id", K.base_item_id("item_id").alias("base_id"))


@query(
    "b4_model_parameters",
    """select item_key, case irt_model when '3PL' then 'slope,location,guessing' when '2PL' then 'slope,location'
       else 'slope,location,step1,step2' end as all_parameters, case irt_model when '3PL' then 'slope,location,guessing'
       when '2PL' then 'slope,location' else 'slope,location,step1' end as predicted_parameters from v_items""",
)
def parameters_of_model(t: Tables) -> DataFrame:
    return t.v_items.select(
        "item_key",
        F.array_join(P.model_parameters("irt_model", "scaled_points"), ",").alias("all_parameters"),
        F.array_join(P.predicted_parameters("irt_model", "scaled_points"), ",").alias("predicted_parameters"),
    )


@query(
    "b5_points_and_model",
    """select r.doc_id, coalesce(i.scaled_points, r.max_points) as points,
       case when r.item_type = 'multiple_choice' then '3PL' when coalesce(i.scaled_points, r.max_points) = 1 then '2PL' else 'GPCM' end as irt_model
       from v_released r left join (select pk, scaled_points from v_items where irt_model = 'GPCM') i on r.doc_id = i.pk""",
)
def points_and_model(t: Tables) -> DataFrame:
    scaled = t.v_items.filter("irt_model = 'GPCM'").select(F.col("pk").alias("doc_id"), "scaled_points")
    points = F.coalesce("scaled_points", "max_points")
    return t.v_released.join(scaled, "doc_id", "left").select("doc_id", points.alias("points"), P.irt_model("item_type", points).alias("irt_model"))


@query(
    "b6_format_check",
    """select doc_id, case when item_type = 'multiple_choice' then correct_option in ('A', 'B', 'C') and max_points = 1 else true end as valid
       from v_released""",
)
def format_check(t: Tables) -> DataFrame:
    labels = F.transform(options_of(), lambda option: option["label"])
    return t.v_released.select("doc_id", P.valid_format("item_type", labels, "correct_option", F.col("max_points")).alias("valid"))


@query(
    "b7_tidy_normalized",
    """select page_id, length(regexp_replace(html, '_{2,}', '____', 'g')) as tidy_length,
       sha256(regexp_replace(lower(html), '[^0-9a-z]', '', 'g')) as normalized_hash from pages""",
)
def tidy_normalized(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.length(X.tidy("html")).alias("tidy_length"), F.sha2(X.normalized("html"), 256).alias("normalized_hash"))


@query(
    "b8_slug_and_stem",
    """select page_id, trim(regexp_replace(url, '[^A-Za-z0-9.-]+', '_', 'g'), '_') as slug,
       regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g') as file_stem from pages""",
)
def slug_and_stem(t: Tables) -> DataFrame:
    return t.pages.select("page_id", K.slug("url").alias("slug"), K.item_file_stem("url").alias("file_stem"))


CLEAN_SQL = r"regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')"


@query(
    "b9_cell_safe_text",
    f"""select doc_id, length(safe) as n_chars, sha256(safe) as text_hash from (
        select doc_id, case when length({CLEAN_SQL}) > 32767 then concat(left({CLEAN_SQL}, {32767 - len(K.CELL_NOTE)}), '{K.CELL_NOTE}')
        else {CLEAN_SQL} end as safe from documents) x""",
)
def cell_safe_text(t: Tables) -> DataFrame:
    safe = K.cell_safe("text")
    return t.documents.select("doc_id", F.length(safe).alias("n_chars"), F.sha2(safe, 256).alias("text_hash"))


@query(
    "b10_content_hashes",
    """select conv_id, turn, sha256(text) as text_hash,
       left(sha256(concat('{"effort":null,"model":"', role, '-model","turn":', cast(turn as varchar), ',"user_prompt":', cast(to_json(text) as varchar), '}')), 16) as request_hash
       from conversations""",
)
def content_hashes(t: Tables) -> DataFrame:
    identity = {
        "model": F.concat("role", F.lit("-model")), "effort": F.lit(None).cast("string"), "user_prompt": F.col("text"), "turn": F.col("turn"),
    }
    return t.conversations.select("conv_id", "turn", K.text_hash("text").alias("text_hash"), K.identity_hash(identity).alias("request_hash"))


@query(
    "b11_point_id",
    """select item_key, concat_ws('-', substr(d, 1, 8), substr(d, 9, 4), concat('5', substr(d, 14, 3)),
       concat(substr('89ab', cast(1 + (strpos('0123456789abcdef', substr(d, 17, 1)) - 1) % 4 as int), 1), substr(d, 18, 3)), substr(d, 21, 12)) as point_id
       from (select item_key, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(item_key)) as d from v_items) x""",
)
def point_ids(t: Tables) -> DataFrame:
    return t.v_items.select("item_key", K.point_id("item_key").alias("point_id"))


# RE2 has no lookahead; no text of the tables has a group of three digits followed by a fourth.
TOKENS_SQL = r"regexp_extract_all(lower(text), '\d{1,3}(?:,\d{3})+\b(?:\.\d+)?|\d+(?:\.\d+)?|\pL+')"
STEM_SQL = """case when regexp_matches(w, '^[0-9]') then replace(w, ',', '') when length(w) <= 3 then w
    when w like '%ies' and not w like '%eies' and not w like '%aies' then concat(left(w, length(w) - 3), 'y')
    when w like '%es' and not w like '%aes' and not w like '%ees' and not w like '%oes' then left(w, length(w) - 1)
    when w like '%s' and not w like '%us' and not w like '%ss' then left(w, length(w) - 1) else w end"""


@query("b12_terms", f"select doc_id, term, count(*) as n from (select doc_id, {STEM_SQL} as term from (select doc_id, unnest({TOKENS_SQL}) as w from documents) x) y group by doc_id, term")
def document_terms(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(X.terms("text")).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query("b13_s_stem", f"select w as word, {STEM_SQL} as stem, count(*) as n from (select unnest({TOKENS_SQL}) as w from documents) x group by 1, 2")
def stems(t: Tables) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit(X.TERM), F.lit(0))
    word = F.col("word")
    stem = F.when(word.rlike(r"^\d"), F.replace(word, F.lit(","), F.lit(""))).otherwise(X.s_stem(word))
    return t.documents.select(F.explode(words).alias("word")).select("word", stem.alias("stem")).groupBy("word", "stem").agg(F.count("*").alias("n"))


# The register after a byte: eight steps of the reflected polynomial. Lists stand for loops over bits and bytes.
BYTES_SQL = "list_transform(range(1, length(h), 2), lambda i: (strpos('0123456789ABCDEF', substr(h, i, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(h, i + 1, 1)) - 1)"
BYTE_STEP_SQL = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))"


@query(
    "b14_term_index",
    f"""select term, xor(list_reduce(list_prepend(cast(4294967295 as bigint), {BYTES_SQL}), lambda c, b: {BYTE_STEP_SQL}), cast(4294967295 as bigint)) as term_index
        from (select term, hex(encode(term)) as h from (select distinct {STEM_SQL} as term from (select unnest({TOKENS_SQL}) as w from benchmark) x) y) z""",
)
def term_index(t: Tables) -> DataFrame:
    """32-bit hash of each distinct term."""
    return t.benchmark.select(F.explode(X.terms("text")).alias("term")).distinct().select("term", F.crc32(F.encode("term", "utf-8")).alias("term_index"))


@query(
    "b15_normalized_cosine",
    """select a.vec_id, round(sqrt(list_sum(list_transform(a.embedding, lambda x: cast(x as double) * x))), 6) as norm,
       round(list_inner_product(cast(a.embedding as double[]), cast(b.embedding as double[]))
             / sqrt(list_inner_product(cast(a.embedding as double[]), cast(a.embedding as double[])))
             / sqrt(list_inner_product(cast(b.embedding as double[]), cast(b.embedding as double[]))), 6) as cosine_with_next
       from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""",
)
def normalized_cosine(t: Tables) -> DataFrame:
    from thetaloom.operators.retrieval import dot, l2_norm, l2_normalized

    vectors = t.embeddings.select("vec_id", l2_norm("embedding").alias("norm"), l2_normalized("embedding").alias("unit"))
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("unit").alias("next_unit"))
    return vectors.join(following, "vec_id").select(
        "vec_id", F.round("norm", 6).alias("norm"), F.round(dot("unit", "next_unit"), 6).alias("cosine_with_next")
    )


@query(
    "b17_calibration_label",
    """select o_orderkey, concat(case o_custkey % 3 when 0 then 'Grade 4' when 1 then 'Grade 8' else 'Advanced' end, ', ',
       cast(year(o_orderdate) - 8 as varchar), '-', cast(year(o_orderdate) as varchar)) as label from orders""",
)
def calibration_labels(t: Tables) -> DataFrame:
    year = F.year("o_orderdate")
    named = t.orders.select(
        "o_orderkey", F.expr("case o_custkey % 3 when 0 then 4 when 1 then 8 else 12 end").alias("grade"),
        F.concat(F.lit("Concurrent calibration of "), year - 8, F.lit(", "), year - 4, F.lit(" and "), year, F.lit(" data")).alias("calibration"),
    )
    return named.select("o_orderkey", K.calibration_label("calibration", "grade").alias("label"))


@query(
    "b18_reporting_scale",
    """select c_custkey, calibration, round(a + b * c_acctbal / 4e3, 5) as scale_score,
       case when a + b * c_acctbal / 4e3 >= 625 then 'Advanced (625)' when a + b * c_acctbal / 4e3 >= 550 then 'High (550)'
            when a + b * c_acctbal / 4e3 >= 475 then 'Intermediate (475)' when a + b * c_acctbal / 4e3 >= 400 and c_custkey % 3 <> 2 then 'Low (400)'
            else 'below the lowest benchmark' end as reached
       from customer join v_scale on calibration = concat('cal', cast(c_custkey % 3 as varchar(2)), '-', cast(c_nationkey % 2 as varchar(2)))""",
)
def reporting_scale(t: Tables) -> DataFrame:
    people = t.customer.select(
        "c_custkey", (F.col("c_acctbal") / 4000).alias("theta"), F.expr("case c_custkey % 3 when 0 then 4 when 1 then 8 else 12 end").alias("grade"),
        F.expr("concat('cal', c_custkey % 3, '-', c_nationkey % 2)").alias("calibration"),
    )
    score = scale_score(F.col("theta"), F.col("a"), F.col("b"))
    return people.join(t.v_scale, "calibration").select(
        "c_custkey", "calibration", F.round(score, 5).alias("scale_score"), benchmark(score, F.col("grade")).alias("reached")
    )


@query(
    "b19_condition_label",
    """select condition_id, concat(split_part(model, '/', 2), case when provider = 'router' then '' else concat(' (', provider, ')') end,
       case when effort = 'none' then ', no reasoning' when effort is not null then concat(', ', effort, ' reasoning')
            when provider = 'direct' then ', default thinking' else '' end, case when role = 'student' then ', as a student' else '' end) as label
       from v_conditions""",
)
def condition_labels(t: Tables) -> DataFrame:
    label = K.condition_label("model", "provider", "effort", "role", default_provider="router", thinks_by_default=("direct",))
    return t.v_conditions.select("condition_id", label.alias("label"))


@query(
    "b20_category_points",
    """select category, max_points, n, case when lower(category) like 'incorrect%' or lower(category) like 'nonresponse%' or lower(category) like 'non response%' then 0
       when lower(category) like 'minimal%' and max_points = 3 then 1 when lower(category) like 'partial%' and max_points >= 2 then max_points - 1
       when lower(category) like 'correct%' or lower(category) like 'fully correct%' then max_points end as points
       from (select case l_linenumber when 1 then 'Minimal Response' when 2 then 'Non response' when 3 then 'Fully Correct' when 4 then 'PARTIAL'
                    when 5 then 'Correct, with work' when 6 then 'Incorrect Response' else 'Blank' end as category,
             1 + l_partkey % 3 as max_points, count(*) as n from lineitem group by 1, 2) x""",
)
def points_of_categories(t: Tables) -> DataFrame:
    rows = t.lineitem.selectExpr(
        "case l_linenumber when 1 then 'Minimal Response' when 2 then 'Non response' when 3 then 'Fully Correct' when 4 then 'PARTIAL' "
        "when 5 then 'Correct, with work' when 6 then 'Incorrect Response' else 'Blank' end as category",
        "1 + l_partkey % 3 as max_points",
    )
    counted = rows.groupBy("category", "max_points").agg(F.count("*").alias("n"))
    return counted.withColumn("points", P.category_points("category", F.col("max_points")).cast("bigint"))


GUIDES_SQL = """
select item_key, max_points, position, case when by_part then concat('M', lpad(cast(pk as varchar(10)), 6, '0'), case when position <= 2 then 'A' else 'B' end, ' ',
       case position % 2 when 1 then 'Correct Response' else 'Incorrect Response' end)
       when position = 1 then 'Correct Response' when position = 2 then 'Incorrect Response' when broken then 'Unclear Response' else 'Partial Response' end as category
from (select item_key, pk, case when pk % 10 >= 8 then 2 else 1 end as max_points, pk % 20 = 19 as by_part, pk % 50 = 8 as broken,
             case when pk % 20 = 19 then 4 when pk % 10 >= 8 and pk % 70 <> 9 then 3 else 2 end as categories
      from v_items where irt_model <> '3PL') i join (select 1 as position union all select 2 union all select 3 union all select 4) n on position <= categories"""


@query(
    "b21_guide_by_part",
    r"""select item_key, part, category, case when lower(name) like 'incorrect%' then 0 when lower(name) like 'partial%' and top >= 2 then top - 1
        when lower(name) like 'correct%' then top end as points from (
        select *, nullif(regexp_extract(category, '^(M\d{6}[A-Z]) (.+)$', 1), '') as part,
        case when regexp_matches(category, '^M\d{6}[A-Z] ') then regexp_extract(category, '^(M\d{6}[A-Z]) (.+)$', 2) else category end as name,
        case when regexp_matches(category, '^M\d{6}[A-Z] ') then 1 else max_points end as top from o_guides) x""",
    {"o_guides": GUIDES_SQL},
)
def guide_by_part(t: Tables) -> DataFrame:
    return I.guide_categories(t.sql(GUIDES_SQL)).select("item_key", "part", "category", "points")


@query(
    "b21_guide_violations",
    """select item_key, case when pk % 50 = 8 then 'a category has no points' else 'not every score is given' end as rule
       from v_items where irt_model <> '3PL' and (pk % 50 = 8 and pk % 20 <> 19 or (pk % 10 >= 8 and pk % 70 = 9 and pk % 20 <> 19))""",
)
def guide_violations(t: Tables) -> DataFrame:
    return I.guide_violations(t.sql(GUIDES_SQL))


@query("b29_last_step", "select item_key, -step1 as step2_derived from v_items where irt_model = 'GPCM'")
def derived_last_step(t: Tables) -> DataFrame:
    return t.v_items.filter("irt_model = 'GPCM'").select("item_key", P.last_step("scaled_points", "step1").alias("step2_derived"))


@query(
    "b30_run_identity",
    """select condition_id, concat_ws('__', concat(provider, '-', replace(model, '/', '_'), '-', coalesce(effort, 'None')), role,
       left(sha256(concat(provider, '|', model)), 8)) as run_name, concat_ws('/', provider, replace(model, '/', '_'), coalesce(effort, 'default'), role) as folder
       from v_conditions""",
)
def run_identity(t: Tables) -> DataFrame:
    settings = F.concat_ws("-", "provider", K.slug("model"), F.coalesce("effort", F.lit("None")))
    digest = F.left(F.sha2(F.concat_ws("|", "provider", "model"), 256), F.lit(8))
    folder = F.concat_ws("/", K.slug("provider"), K.slug("model"), F.coalesce("effort", F.lit("default")), "role")
    return t.v_conditions.select("condition_id", F.concat_ws("__", settings, "role", digest).alias("run_name"), folder.alias("folder"))


NAMED = {
    "o_run": """select concat('model ', model) as run, condition_id, provider, replace(model, '/', '_') as model, coalesce(effort, 'None') as effort, role from v_conditions
        union all select concat('role ', role), condition_id, provider, replace(model, '/', '_'), coalesce(effort, 'None'), role from v_conditions
        union all select 'all', condition_id, provider, replace(model, '/', '_'), coalesce(effort, 'None'), role from v_conditions""",
    "o_efforts": "select run, string_agg(effort, '+' order by first) as efforts from (select run, effort, min(condition_id) as first from o_run group by 1, 2) x group by 1",
    "o_roles": "select run, string_agg(role, '+' order by first) as roles from (select run, role, min(condition_id) as first from o_run group by 1, 2) x group by 1",
    "o_settings": """select run, count(distinct concat(provider, '-', model)) as n, min(concat(provider, '-', model)) as llm, left(sha256(string_agg(s, '|' order by s)), 8) as digest
        from (select distinct run, provider, model, concat(provider, '-', model, '-', effort) as s from o_run) x group by 1""",
}


@query(
    "b30_run_names",
    """select s.run, concat(case when n = 1 then concat(llm, '-', efforts) else concat(n, '-models-', digest) end, '__', roles, '__scorer-direct-scorer-none') as run_name
       from o_settings s join o_efforts e on s.run = e.run join o_roles r on s.run = r.run""",
    NAMED,
)
def run_names(t: Tables) -> DataFrame:
    """Names of runs of one model, of one role with several models, and of everything."""
    rows = t.sql(NAMED["o_run"].replace("replace(model, '/', '_')", "model")).withColumn("model", K.slug("model"))
    return W.run_names(rows, "run", "condition_id", "direct-scorer-none")


@query(
    "c1_drop_known_duplicates",
    """select d.doc_id, case when trim(d.text) = '' then 'no text' when r.n > 1 then 'text repeats' end as rule from documents d
       join (select text, count(*) as n, min(doc_id) as first_id from documents group by text) r on d.text = r.text
       where r.n > 2 and d.doc_id not in (select max(doc_id) from documents group by text having count(*) > 1)""",
)
def drop_known_duplicates(t: Tables) -> DataFrame:
    """The last copy of each repeated text is a listed duplicate; what still repeats violates the rule."""
    items = t.documents.select(F.col("doc_id").alias("item_key"), "text")
    copies = items.groupBy(F.sha2("text", 256).alias("h")).agg(
        F.max("item_key").alias("item_key"), F.min("item_key").alias("original_key"), F.count("*").alias("n")
    )
    duplicates = copies.filter("n > 1").select("item_key", "original_key")
    _, violations = I.drop_duplicates_checked(items, duplicates)
    return violations.select(F.col("item_key").alias("doc_id"), "rule")


def tasks(t: Tables) -> DataFrame:
    """Tasks of a few items: neighbours of one content domain, assessment and grade share a situation."""
    based = t.v_released.filter("content_domain = 'src3'").select(
        "assessment", "grade", K.base_item_id("item_id").alias("base_id"), F.floor(F.col("doc_id") / 200).alias("block")
    )
    roots = based.groupBy("assessment", "grade", "block").agg(F.min("base_id").alias("task"))
    return based.join(roots, ["assessment", "grade", "block"]).drop("block").distinct()


PARTS_SQL = r"""
select r.*, concat(r.assessment, '/', cast(r.grade as varchar(5)), '/', coalesce(k.task, r.base_id)) as part_group
from (select *, regexp_replace(item_id, '(\d)[A-Z]$', '\1') as base_id from v_released) r
left join (select distinct assessment, grade, base_id, min(base_id) over (partition by assessment, grade, floor(doc_id / 2e2)) as task
           from (select *, regexp_replace(item_id, '(\d)[A-Z]$', '\1') as base_id from v_released where content_domain = 'src3') s) k
  on r.assessment = k.assessment and r.grade = k.grade and r.base_id = k.base_id"""


@query("c2_part_groups", "select doc_id, part_group from o_parts", {"o_parts": PARTS_SQL})
def part_groups(t: Tables) -> DataFrame:
    return I.part_groups(t.v_released, tasks(t)).select("doc_id", "part_group")


@query(
    "c3_units",
    """select concat(min(assessment), '/grade ', cast(min(grade) as varchar(5)), '/', min(subject), '/', string_agg(item_id, '+' order by doc_id)) as unit_key,
       part_group, min(doc_id) as first_position, count(*) as items, count(pk) as calibrated_items
       from o_parts left join (select pk from v_items) i on doc_id = pk group by part_group having count(pk) > 0""",
    {"o_parts": PARTS_SQL},
)
def units(t: Tables) -> DataFrame:
    return all_units(t).select("unit_key", "part_group", "first_position", "items", "calibrated_items")


def all_units(t: Tables) -> DataFrame:
    calibrated = t.v_items.select(F.col("pk").alias("doc_id"), F.lit(True).alias("calibrated"))
    items = I.part_groups(t.v_released, tasks(t)).join(calibrated, "doc_id", "left")
    return I.units(items.withColumns({"position": F.col("doc_id"), "calibrated": F.coalesce("calibrated", F.lit(False))}))


@query(
    "e13_unit_summary",
    """select grade, assessment, count(*) as units, cast(sum(case when items > 1 then 1 else 0 end) as bigint) as units_of_several_items,
       cast(sum(items) as bigint) as items, cast(sum(calibrated_items) as bigint) as calibrated_items from (
       select part_group, min(grade) as grade, min(assessment) as assessment, count(*) as items, count(pk) as calibrated_items
       from o_parts left join (select pk from v_items) i on doc_id = pk group by part_group having count(pk) > 0) u group by grade, assessment""",
    {"o_parts": PARTS_SQL},
)
def unit_summary(t: Tables) -> DataFrame:
    return all_units(t).groupBy("grade", "assessment").agg(
        F.count("*").alias("units"), F.sum((F.col("items") > 1).cast("int")).alias("units_of_several_items"),
        F.sum("items").alias("items"), F.sum("calibrated_items").alias("calibrated_items"),
    )


@query(
    "c4_same_scoring_peers",
    """select i.item_key, g.n - p.n as peers, round((g.total - p.total) / nullif(g.n - p.n, 0), 6) as mean_location from v_items i
       join (select grade, irt_model, scaled_points, count(*) as n, sum(location) as total from v_items group by 1, 2, 3) g
         on i.grade = g.grade and i.irt_model = g.irt_model and i.scaled_points = g.scaled_points
       join (select grade, irt_model, scaled_points, part_group, count(*) as n, sum(location) as total from v_items group by 1, 2, 3, 4) p
         on i.grade = p.grade and i.irt_model = p.irt_model and i.scaled_points = p.scaled_points and i.part_group = p.part_group""",
)
def same_scoring_peers(t: Tables) -> DataFrame:
    """Calibrated items scored alike, the part group left out, as group totals minus the part group's."""
    from thetaloom.operators.errors import leave_one_out

    result = leave_one_out(t.v_items, ["location"])
    return result.select("item_key", F.col("peers"), F.round("location_mean", 6).alias("mean_location"))


@query(
    "c5_parameter_payload",
    """select doc_id, irt_model, slope, location, pk is not null as calibrated from v_released left join v_items on doc_id = pk""",
)
def parameter_payload(t: Tables) -> DataFrame:
    items = t.v_released.select("doc_id", F.concat(F.lit("P"), "doc_id").alias("item_key"))
    joined = I.parameter_payload(items, t.v_items, ["irt_model", "slope", "location"])
    return joined.select(
        "doc_id", "item_parameters.irt_model", "item_parameters.slope", "item_parameters.location", F.col("item_parameters").isNotNull().alias("calibrated")
    )


@query(
    "c6_calibration_lookup",
    """select grade, parity, calibration from (select grade, substr(calibration, 6, 1) as parity, min(calibration) as calibration,
       count(distinct calibration) as n from v_items group by 1, 2) x where n = 1""",
)
def calibration_lookup(t: Tables) -> DataFrame:
    unique, _ = I.calibration_lookup(t.v_items.withColumn("parity", F.substring("calibration", 6, 1)), ["grade", "parity"])
    return unique


@query("c7_metadata_filter", "select item_key from v_items where grade in (4, 8) and irt_model = 'GPCM' and calibration = 'cal0-1'")
def metadata_filter(t: Tables) -> DataFrame:
    payload = t.v_items.select("item_key", "grade", F.struct("irt_model", "calibration").alias("item_parameters"), "part_group")
    return payload.filter(
        I.metadata_filter(payload, grade=[4, 8], item_parameters__irt_model="GPCM", item_parameters__calibration="cal0-1", part_group=None)
    ).select("item_key")


@query(
    "c18_consistency_checks",
    """select item_key, 'model does not fit the format' as rule from v_items where pk % 11 = 0 and irt_model <> '3PL'
       union all select item_key, 'not exactly the parameters of the model' from v_items where irt_model = '3PL' and pk % 13 = 0
       union all select item_key, 'steps do not sum to 0' from v_items where irt_model = 'GPCM' and pk % 17 = 0""",
)
def consistency_checks(t: Tables) -> DataFrame:
    """Rows with planted faults: a wrong format, a missing parameter, unbalanced steps."""
    items = t.v_items.withColumns(
        {
            "item_type": F.expr("case when irt_model = '3PL' or pk % 11 = 0 then 'multiple_choice' else 'constructed_response' end"),
            "guessing": F.expr("case when pk % 13 <> 0 then guessing end"),
            "step2": F.expr("case when pk % 17 = 0 then step2 + 1e-1 else step2 end"),
        }
    )
    return I.parameter_violations(items)


@query(
    "c18_item_checks",
    """select item_id as item_key, 'the key is not among the options' as rule from v_released where item_type = 'multiple_choice' and correct_option = 'E'
       union all select item_id, 'options or a key without a choice' from v_released where item_type <> 'multiple_choice' and doc_id % 8 = 0
       union all select item_id, 'labels repeat' from v_released where item_type = 'multiple_choice' and doc_id % 9 = 0
       union all select item_id, 'more points in the scaling than the item has' from v_released join v_items on doc_id = pk where case when doc_id % 7 = 0 then scaled_points + 1 else scaled_points end > max_points""",
)
def item_checks(t: Tables) -> DataFrame:
    """Released items with planted faults: a key beside the options, a key without options, a repeated label, a scaling with
    more points."""
    scaled = t.v_items.select(F.col("pk").alias("doc_id"), F.expr("case when pk % 7 = 0 then scaled_points + 1 else scaled_points end").alias("scaled_points"))
    again = F.when(F.col("doc_id") % 9 == 0, F.concat("options", F.slice("options", 1, 1))).otherwise(F.col("options"))
    items = t.v_released.withColumn("options", options_of()).withColumn("options", again)
    planted = F.when((F.col("item_type") != "multiple_choice") & (F.col("doc_id") % 8 == 0), "A").otherwise(F.col("correct_option"))
    return I.item_violations(items.withColumn("correct_option", planted).withColumn("item_key", F.col("item_id")).join(scaled, "doc_id", "left"))


@query(
    "g11_nearest_scale_value",
    """select item_key, location, arg_min(position, struct_pack(d := d, p := position)) as nearest from (
       select item_key, location, position, abs(v - location) as d from v_items cross join
       (values (0, -2e0), (1, -1e0), (2, -5e-1), (3, 0e0), (4, 2e-1), (5, 5e-1), (6, 8e-1), (7, 1e0), (8, 15e-1), (9, 2e0)) s(position, v)) x group by 1, 2""",
)
def nearest_scale_value(t: Tables) -> DataFrame:
    grid = F.array(*[F.lit(v) for v in (-2.0, -1.0, -0.5, 0.0, 0.2, 0.5, 0.8, 1.0, 1.5, 2.0)])
    return t.v_items.select("item_key", "location", nearest_position(F.col("location"), grid).alias("nearest"))
