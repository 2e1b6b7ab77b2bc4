"""Coercion of dirty table columns and extraction of JSON from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts read as missing by the CSV reader.
NA_STRINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Employment length to years.
EMPLOYMENT_YEARS = {
    "< 1 year": 0, "1 year": 1, "2 years": 2, "3 years": 3, "4 years": 4, "5 years": 5,
    "6 years": 6, "7 years": 7, "8 years": 8, "9 years": 9, "10+ years": 10,
}

NUMBER = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[iI]nf(inity)?)\s*$"


def missing_to_null(text: Column) -> Column:
    return F.when(~text.isin(NA_STRINGS), text)


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def to_number(text: Column) -> Column:
    """Number or NULL; texts such as 1.0d, 0x1F and nan are not numbers."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def percent_to_number(text: Column) -> Column:
    return F.regexp_replace(text, "%+$", "").try_cast("double")


def is_percent(text: Column) -> Column:
    return F.endswith(text, F.lit("%"))


def employment_years(text: Column) -> Column:
    value = F.when(F.lit(False), F.lit(0.0))
    for label, years in EMPLOYMENT_YEARS.items():
        value = value.when(text == label, F.lit(float(years)))
    return value


def first_integer(text: Column) -> Column:
    """First run of digits as a double, NULL when there is none."""
    return F.regexp_extract(F.trim(text), r"(\d+)", 1).try_cast("double")


def json_block(text: Column) -> Column:
    """JSON text out of a fenced block, else the widest brace pair, else NULL."""
    fenced = F.regexp_extract(text, r"```(?:json)?\s*([\s\S]*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.nullif(F.when(F.trim(fenced) != "", F.trim(fenced)).otherwise(braces), F.lit(""))


def repair_json(text: Column) -> Column:
    """Keep the last of two values written after one key."""
    return F.regexp_replace(text, r'"([^"]+)":\s*"[^"]*":\s*"([^"]*)"', r'"$1": "$2"')


INTENT_SCHEMA = (
    "query_type string, confidence double, reasoning string, keywords array<string>, needs_tools boolean"
)


def parse_intent(text: Column) -> Column:
    """Intent struct from model output, with the defaults used for absent fields."""
    raw = F.from_json(json_block(text), INTENT_SCHEMA)
    return F.struct(
        F.coalesce(raw["query_type"], F.lit("unknown")).alias("query_type"),
        F.coalesce(raw["confidence"], F.lit(0.5)).alias("confidence"),
        F.coalesce(raw["reasoning"], F.lit("")).alias("reasoning"),
        F.coalesce(raw["keywords"], F.array().cast("array<string>")).alias("keywords"),
        F.coalesce(raw["needs_tools"], F.lit(False)).alias("needs_tools"),
    )


def parse_thought(text: Column) -> Column:
    """Reasoning step from model output; NULL when no JSON is found."""
    fields = ["analysis", "gap", "next_action", "action_input", "reasoning"]
    block = repair_json(json_block(text))
    raw = F.from_json(block, ", ".join(f"{name} string" for name in fields))
    parts = [
        F.coalesce(raw[name], F.lit("FINISH" if name == "next_action" else "")).alias(name)
        for name in fields
    ]
    return F.when(block.isNotNull(), F.struct(*parts))


def encode_keywords(keywords: Column) -> Column:
    return F.to_json(keywords)


def decode_keywords(text: Column) -> Column:
    """Keyword list from JSON; bad or absent JSON gives an empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
