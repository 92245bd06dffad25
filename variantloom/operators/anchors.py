"""Keys and texts of source records, whatever names their fields go by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variantloom.functions.text import first_filled, strip, text


def _have(df: DataFrame, *names: str) -> list[Column]:
    return [df[n].cast("string") for n in names if n in df.columns]


def identifier(df: DataFrame, strict: bool = True) -> Column:
    """First of ``anchor_id``, ``essay_id``, ``id`` that is not blank, as it stands. Without any: an error, or null if not strict."""
    found = _have(df, "anchor_id", "essay_id", "id")
    key = first_filled(*found, blank=True) if found else F.lit(None).cast("string")
    return F.coalesce(key, F.raise_error(F.lit("a record has no anchor_id, essay_id or id")).cast("string")) if strict else key


def source(df: DataFrame) -> Column:
    found = _have(df, "source_corpus", "dataset")
    return first_filled(*found) if found else F.lit(None).cast("string")


def anchor_text(df: DataFrame) -> Column:
    """Text of a source record: ``anchor_response``, ``essay`` or ``text``; '' without any."""
    return text(first_filled(*_have(df, "anchor_response", "essay", "text"), F.lit("")))


def row_anchor_text(df: DataFrame) -> Column:
    """The source text a candidate row itself carries."""
    return text(first_filled(*_have(df, "anchor_response", "anchor_text"), F.lit("")))


#: Which field holds a candidate's text first, by step; the orders differ on purpose.
PRECEDENCE = {
    "score": ("candidate_response", "candidate_text", "traced_response"),
    "prefilter": ("candidate_text", "candidate_response", "traced_response"),
    "audit": ("candidate_response", "candidate_text", "raw_output"),
    "browse": ("candidate_response", "candidate_text", "rewrite_text"),
}


def candidate_text(df: DataFrame, step: str) -> Column:
    """A candidate's text in the order of ``step``; for scores and pre-filter the trimmed raw output comes last; '' without any."""
    last = [strip(c) for c in _have(df, "raw_output")] if step in ("score", "prefilter") else []
    return text(first_filled(*_have(df, *PRECEDENCE[step]), *last, F.lit("")))


def domain(df: DataFrame) -> Column:
    found = _have(df, "domain", "prompt_group", "task")
    return first_filled(*found) if found else F.lit(None).cast("string")


def last_of_each(df: DataFrame, key: Column, order: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row for each key, the last in the order; keys and their row in ``_key`` and ``_row``. Null keys are left out.

    ``columns`` are those the row holds, all by default; no others are read.

    The order's columns are compared as a struct, so that partial aggregation keeps one row a key and task.
    """
    row = F.struct(*(columns or df.columns))
    picked = df.select(key.alias("_key"), F.struct(*order).alias("_order"), row.alias("_row")).where("_key is not null")
    return picked.groupBy("_key").agg(F.max_by("_row", "_order").alias("_row"))


def job_id(anchor: Column, family: Column, index: Column) -> Column:
    """Id of a generation job; spaces of the family become ``_``, its slash stays."""
    return F.concat_ws("_", anchor, F.translate(family, " ", "_"), index.cast("string"))


def trace_id(anchor: Column, family: Column) -> Column:
    return F.concat_ws("_", anchor, F.translate(family, " /", "__"), F.lit("trace"))


def candidate_id(df: DataFrame) -> Column:
    """``job_id`` where there is one, else made of anchor, family and index as they stand."""
    made = F.concat_ws("_", *(df[c].cast("string") for c in ("anchor_id", "dialect_family", "candidate_index")))
    return F.coalesce(first_filled(*_have(df, "job_id")), made) if "job_id" in df.columns else made
