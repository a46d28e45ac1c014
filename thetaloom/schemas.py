"""Schemas of the input files; nothing is inferred."""

from pyspark.sql import types as T

TEXT, INT, LONG, DOUBLE, FLAG = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


OPTION = _struct(label=TEXT, text=TEXT)
CATEGORY = _struct(category=TEXT, descriptors=T.ArrayType(TEXT))
PERCENT_CORRECT = _struct(education_system=TEXT, pct_correct=DOUBLE, vs_intl_avg=TEXT, benchmarking=FLAG)

# The fields of an item record, in the order of the file.
ITEM = _struct(
    item_id=TEXT, item_label=TEXT, assessment=TEXT, grade=INT, subject=TEXT, content_domain=TEXT, main_topic=TEXT,
    cognitive_domain=TEXT, item_type=TEXT, max_points=INT, stem=TEXT, options=T.ArrayType(OPTION), correct_option=TEXT,
    scoring_guide=T.ArrayType(CATEGORY), scoring_notes=TEXT, has_figure=FLAG, figure_description=TEXT,
    accessibility_text=TEXT, pct_correct_intl_avg=DOUBLE, pct_correct_usa=DOUBLE, pct_correct=T.ArrayType(PERCENT_CORRECT),
    booklet_page=INT, pdf_page=INT, source_url=TEXT, transcription_model=TEXT,
)

PARAMETERS = _struct(
    assessment=TEXT, grade=INT, subject=TEXT, item_id=TEXT, item_type=TEXT, irt_model=TEXT, slope=DOUBLE, slope_se=DOUBLE,
    location=DOUBLE, location_se=DOUBLE, guessing=DOUBLE, guessing_se=DOUBLE, step1=DOUBLE, step1_se=DOUBLE, step2=DOUBLE,
    step2_se=DOUBLE, step3=DOUBLE, step3_se=DOUBLE, calibration=TEXT, source_item_id=TEXT, source_file=TEXT, source_location=TEXT,
)

CONSTANTS = _struct(
    calibration=TEXT, grade=INT, use_for_scoring=FLAG, plausible_value=TEXT, target_mean=DOUBLE, target_sd=DOUBLE,
    theta_mean=DOUBLE, theta_sd=DOUBLE, a=DOUBLE, b=DOUBLE, method=TEXT,
)

SAVED_OUTPUT = _struct(
    request_id=TEXT, item_key=TEXT, output=TEXT, finish_reason=TEXT, prompt_tokens=LONG, completion_tokens=LONG,
    cost_usd=DOUBLE, seconds=DOUBLE, batch_id=TEXT, requested_at=TEXT,
)

RESULT_LINE = _struct(
    custom_id=TEXT, batch_id=TEXT, batch_status=TEXT, error=TEXT, status_code=INT, body=TEXT, batch_cost=DOUBLE,
)
