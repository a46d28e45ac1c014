"""Keys, names, hashes and labels of items, runs and conditions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short grade names, the pattern of a part letter, the RFC 4122 URL namespace and the cell limit.
GRADE_SHORT_NAMES = {4: "Grade 4", 8: "Grade 8", 12: "Advanced"}
PART_LETTER = r"([0-9])[A-Z]$"
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
YEAR = r"\b(?:19|20)[0-9][0-9]\b"
CELL_LIMIT = 32_767
CELL_NOTE = " [cut at the Excel cell limit; the saved record has the full text]"
CONTROL_CHARACTERS = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
DEFAULT_PROVIDER = "openrouter"


def item_key(assessment, grade, subject, item_id) -> Column:
    """Unique key of an item; item IDs alone repeat across assessments."""
    return F.concat(assessment, F.lit("/grade "), F.col(grade).cast("string"), F.lit("/"), subject, F.lit("/"), item_id)


def base_item_id(item_id) -> Column:
    """The item ID without its part letter."""
    return F.regexp_replace(item_id, PART_LETTER, "$1")


def slug(text) -> Column:
    return F.trim(F.regexp_replace(text, r"[^A-Za-z0-9.-]+", "_"), F.lit("_"))


def item_file_stem(key) -> Column:
    return F.regexp_replace(key, r"[^A-Za-z0-9]+", "_")


def text_hash(text) -> Column:
    return F.sha2(text, 256)


def identity_hash(fields: dict[str, Column], length: int = 16) -> Column:
    """The first hex digits of SHA-256 over the fields as JSON with sorted names. What is not in ``fields``, such as a
    token limit, does not change the identity."""
    record = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    return F.left(F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256), F.lit(length))


def point_id(key) -> Column:
    """UUID version 5 of a key in the URL namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(key, "utf-8")))
    nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex((nibble.bitwiseAND(F.lit(3)) + 8).cast("long")))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def calibration_label(calibration, grade) -> Column:
    """Short grade name, and the first and last year in the name of a calibration."""
    years = F.regexp_extract_all(calibration, F.lit(YEAR), F.lit(0))
    name = F.lit(None).cast("string")
    for value, short in GRADE_SHORT_NAMES.items():
        name = F.when(F.col(grade) == value, F.lit(short)).otherwise(name)
    return F.concat(name, F.lit(", "), F.element_at(years, 1), F.lit("-"), F.element_at(years, -1))


def condition_label(model, provider, effort, role, default_provider: str = DEFAULT_PROVIDER, thinks_by_default: tuple = ("anthropic",)) -> Column:
    """A condition by its model without vendor, its provider unless it is the default, its effort and the student role."""
    model, provider, effort, role = (F.col(name) for name in (model, provider, effort, role))
    name = F.element_at(F.split(model, "/"), -1)
    name = F.when(provider == default_provider, name).otherwise(F.concat(name, F.lit(" ("), provider, F.lit(")")))
    level = (
        F.when(effort.isin("none", "false"), F.lit("no reasoning"))
        .when(effort.isNotNull(), F.concat(effort, F.lit(" reasoning")))
        .when(provider.isin(*thinks_by_default), F.lit("default thinking"))
    )
    return F.concat_ws(", ", name, level, F.when(role == "student", F.lit("as a student")))


def cell_safe(text, limit: int = CELL_LIMIT, note: str = CELL_NOTE) -> Column:
    """Text without control characters, cut to ``limit`` characters with a note that it was cut."""
    clean = F.regexp_replace(text, CONTROL_CHARACTERS, "")
    cut = F.concat(F.left(clean, F.lit(limit - len(note))), F.lit(note))
    return F.when(F.length(clean) > limit, cut).otherwise(clean)
