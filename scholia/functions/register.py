"""Expose word and document functions to SQL as native SQL functions (no Python)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from scholia.functions import text as tx
from scholia.operators.text import TYPE_PATTERNS


def _lit(value: str) -> str:
    return "r'" + value + "'" if "'" not in value else '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"'


def _stem_sql(word: str) -> str:
    out = word
    for pattern, replacement in tx.STEM_STAGES:
        out = f"regexp_replace({out}, {_lit(pattern)}, {_lit(replacement.replace(chr(92), '$'))})"
    return f"regexp_replace({out}, {_lit('^(.{2,})([^lszf])' + chr(92) + '2$')}, '$1$2')"


def _type_sql() -> str:
    out = "CASE WHEN lower(filename) RLIKE r'\\.pptx?$' THEN 'Slides'"
    for label, patterns in TYPE_PATTERNS:
        p = _lit(tx.rx("|".join(patterns), "i"))
        out += f" WHEN filename RLIKE {p} OR coalesce(body RLIKE {p}, false) THEN '{label}'"
    return out + " ELSE 'Notes' END"


def definitions() -> dict[str, str]:
    cleaned = "regexp_replace(lower(body), " + _lit(r"[^a-z0-9\s'\-]") + ", ' ')"
    core = f"regexp_replace(regexp_replace(lower(trim(word)), {_lit('(?:[^laeiouy]es|ed|[^laeiouy]e)$')}, ''), '^y', '')"
    return {
        "study_tokens": f"(body STRING) RETURNS ARRAY<STRING> RETURN filter(split({cleaned}, {_lit(chr(92) + 's+')}), w -> length(w) > 1)",
        "study_stem": f"(word STRING) RETURNS STRING RETURN CASE WHEN length(trim(word)) <= 3 THEN lower(trim(word)) ELSE {_stem_sql('lower(trim(word))')} END",
        "study_syllables": f"(word STRING) RETURNS INT RETURN CASE WHEN length(trim(word)) <= 3 THEN 1 ELSE greatest(regexp_count({core}, '[aeiouy]{{1,2}}'), 1) END",
        "study_material_type": f"(filename STRING, body STRING) RETURNS STRING RETURN {_type_sql()}",
        "study_outdated": "(content_year INT, as_of_year INT) RETURNS STRING RETURN CASE WHEN as_of_year - content_year >= 10 THEN 'critical' WHEN as_of_year - content_year >= 6 THEN 'warning' ELSE 'none' END",
    }


def register_functions(spark: SparkSession) -> list[str]:
    for name, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(definitions())
