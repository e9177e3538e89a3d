"""Error rules: the first rule found in a text gives its category. Rules are few and given by the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlake.schemas import ERROR_RULES, ESCALATION, PHRASE_RULES

#: A rule list becomes one expression; longer ones are an error, never cut.
MOST_RULES = 500


def _first(conditions: Sequence[Column]) -> Column:
    """Index of the first condition that holds, else null."""
    if len(conditions) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(conditions)], F.lit(None).cast("int"))


def _pick(rule: Column, values: Sequence, kind: str) -> Column:
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), rule)


def classify(runs: DataFrame, rules: Sequence[tuple[str, str, bool]] = ERROR_RULES) -> DataFrame:
    """Adds rule_id, error_category, is_auto_fixable, confidence_score by message and code (missing ones empty).

    Patterns are searched case-sensitively; the lowest rule wins. Without a match: null, unknown, false, 0.
    """
    text = F.concat_ws(" ", F.coalesce("error_message", F.lit("")), F.coalesce("error_code", F.lit("")))
    out = runs.withColumn("rule_id", _first([text.rlike(p) for p, _, _ in rules]))
    rule = F.col("rule_id")
    return out.withColumns({"error_category": F.coalesce(_pick(rule, [c for _, c, _ in rules], "string"), F.lit("unknown")), "is_auto_fixable": F.coalesce(_pick(rule, [x for _, _, x in rules], "boolean"), F.lit(False)), "confidence_score": F.when(rule.isNull(), 0.0).otherwise(1.0)})


def classify_phrases(runs: DataFrame, rules: Sequence[tuple[str, str, bool, int | None]] = PHRASE_RULES, text: str = "error_message") -> DataFrame:
    """Adds phrase_id, phrase_category, phrase_fixable, wait_minutes by the first phrase that the text holds."""
    out = runs.withColumn("phrase_id", _first([F.coalesce(F.col(text), F.lit("")).contains(p) for p, _, _, _ in rules]))
    rule = F.col("phrase_id")
    return out.withColumns({"phrase_category": F.coalesce(_pick(rule, [r[1] for r in rules], "string"), F.lit("unknown")), "phrase_fixable": F.coalesce(_pick(rule, [r[2] for r in rules], "boolean"), F.lit(False)), "wait_minutes": _pick(rule, [r[3] for r in rules], "int")})


def routed(incidents: DataFrame, matrix: Sequence[tuple[str, str, str, str]] = ESCALATION) -> DataFrame:
    """Adds l1_action, l2_action and team of the incident's category; a category outside the matrix is unknown."""
    dimension = incidents.sparkSession.createDataFrame(list(matrix), "category string, l1_action string, l2_action string, team string")
    known = [c for c, *_ in matrix]
    key = F.when(F.col("error_category").isin(known), F.col("error_category")).otherwise("unknown")
    return incidents.withColumn("category", key).join(F.broadcast(dimension), "category", "left").drop("category")  # a row for each category
