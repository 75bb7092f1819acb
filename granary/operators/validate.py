"""Validation of knowledge rows (source_id, input_type, content, metadata) into an errors column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .extract import INPUT_TYPES
from .text import is_empty, strip

MAX_ID, MAX_CONTENT, MAX_METADATA, MAX_NAME, MIN_TEXT = 256, 100_000, 10_000, 200, 3


def _errors(*checks: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(bad, F.lit(name)) for bad, name in checks)))


def format_errors() -> Column:
    """Field names that break the format, in field order."""
    source, content = F.coalesce("source_id", F.lit("")), F.coalesce("content", F.lit(""))
    return _errors(
        ((source == "") | (F.length(source) > MAX_ID), "source_id"),
        (~F.coalesce("input_type", F.lit("triple")).isin(*INPUT_TYPES), "input_type"),
        (is_empty(F.col("content")) | (F.length(content) > MAX_CONTENT), "content"),
        (F.length(F.coalesce("metadata", F.lit(""))) > MAX_METADATA, "metadata"),
    )


def semantic_errors() -> Column:
    """Fields whose content does not suit the row's type."""
    content, kind = F.coalesce("content", F.lit("")), F.coalesce("input_type", F.lit("triple"))
    bars = F.size(F.filter(F.split(content, r"\|", -1), lambda p: strip(p) != ""))
    sentences = F.size(F.filter(F.split(content, r"\.", -1), lambda p: strip(p) != ""))
    bad = (
        F.when(kind == "triple", bars < 3)
        .when(kind == "schema", ~content.contains("->") & ~content.contains(":"))
        .when(kind == "text", (sentences < 1) | (F.length(content) < MIN_TEXT))
        .when(kind == "entity", (strip(content) == ""))
        .otherwise(F.lit(False))
    )
    return _errors((bad, "content"))


def structured_errors(triples: str = "triples", entities: str = "entities") -> Column:
    """Errors of parsed payloads: triples lacking a part, entities lacking a name or with one too long."""
    lacking = F.exists(triples, lambda t: t["subject"].isNull() | t["predicate"].isNull() | t["object"].isNull())
    unnamed = F.exists(entities, lambda e: (F.coalesce(e["name"], F.lit("")) == "") | (F.length(e["name"]) > MAX_NAME))
    return _errors((F.coalesce(lacking, F.lit(False)), "structured.triples"), (F.coalesce(unnamed, F.lit(False)), "structured.entities"))


VALIDATORS: dict[str, Callable[[], Column]] = {"format": format_errors, "semantic": semantic_errors}


def validate(df: DataFrame, validators: tuple[str, ...] = ("format", "semantic")) -> DataFrame:
    """``df`` with ``error``: validator and field of the first failure, null if all pass."""
    first = [F.when(F.size(VALIDATORS[v]()) > 0, F.concat(F.lit(f"{v}:"), F.get(VALIDATORS[v](), F.lit(0)))) for v in validators]
    return df.withColumn("error", F.coalesce(*first))


def split_valid(df: DataFrame, strict: bool = True, fail_fast: bool = False) -> tuple[DataFrame, DataFrame]:
    """(ok, rejected). Strict drops failing rows from ok; otherwise they stay, with the error in metadata. With
    ``fail_fast`` the job stops at a failing row, with its id and error."""
    checked = validate(df)
    if fail_fast:
        stop = F.raise_error(F.concat_ws(" ", F.lit("invalid row"), F.col("source_id").cast("string"), "error"))
        checked = checked.withColumn("error", F.when(F.col("error").isNotNull(), stop.cast("string")))
    rejected = checked.where("error IS NOT NULL")
    if strict:
        return checked.where("error IS NULL").drop("error"), rejected
    noted = F.when(F.col("error").isNull(), F.col("metadata")).otherwise(F.concat_ws(" ", "metadata", F.concat(F.lit("validation_error="), "error")))
    return checked.withColumn("metadata", noted).drop("error"), rejected
