"""Assignment of source records to target families, and the jobs that follow from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variantloom.functions.text import is_blank, replaced, text
from variantloom.operators.anchors import anchor_text, domain, identifier, job_id, last_of_each, source
from variantloom.operators.order import numbered, numbered_in_turn

# Ranks of score bands; anything else comes last.
BAND_RANK = {"low": 0, "mid": 1, "medium": 1, "high": 2}
OTHER_RANK = 99


def band_rank(c: str | Column) -> Column:
    band = F.lower(F.col(c) if isinstance(c, str) else c)
    out = F.lit(OTHER_RANK)
    for name, rank in BAND_RANK.items():
        out = F.when(band == name, F.lit(rank)).otherwise(out)
    return out


def _narrow(df: DataFrame, order: list[str]) -> DataFrame:
    """What assignments are made of, without texts: the identifier, its source, band and domain, and the order's columns."""
    named = {"anchor_id": identifier(df), "source_corpus": source(df), **{c: (df[c] if c in df.columns else F.lit(None).cast("string")) for c in ("score_band", "domain")}}
    strata = {f"_{c}": (df[c] if c in df.columns else F.lit("unknown")) for c in ("source_corpus", "score_band", "domain")}
    return df.select(*(c.alias(n) for n, c in {**named, **strata}.items()), *(F.col(o).alias(f"_vl_o{k}") for k, o in enumerate(order)))


def _rows(df: DataFrame, families: Sequence[str], candidates: int, strategy: str, place: str) -> DataFrame:
    names = F.array(*map(F.lit, families))
    return df.select(
        "anchor_id", F.element_at(names, (F.col(place) % len(families) + 1).cast("int")).alias("dialect_family"), F.lit(candidates).alias("target_candidates"),
        F.lit(strategy).alias("assignment_strategy"), "source_corpus", "score_band", "domain", F.col(place).alias("position"),
    )


def greedy(anchors: DataFrame, families: Sequence[str], order: list[str], candidates: int = 3, limit: int | None = None) -> DataFrame:
    """The i-th anchor in the order goes to family i mod n. ``position`` is i. Only keys and strata are sorted and written, no texts."""
    if not families:
        raise ValueError("no family to assign to")
    rows = numbered(_narrow(anchors, order), [f"_vl_o{k}" for k in range(len(order))], "_n")
    return _rows(rows if limit is None else rows.where(F.col("_n") < limit), families, candidates, "greedy", "_n")


def balanced(anchors: DataFrame, families: Sequence[str], order: list[str], candidates: int = 3, limit: int | None = None) -> DataFrame:
    """Anchors are taken from strata in turn, one from each, and go to the families in turn.

    Strata are the raw values of ``source_corpus``, ``score_band`` and ``domain`` (a missing column counts as
    ``unknown``, a null as a stratum of its own that sorts as ``None``), in the order of band rank, source and
    domain; strata equal in these stand as they were first seen. One sort gives the order first seen and the
    turn within a stratum, a second one the place; both carry keys and strata only.
    """
    if not families:
        raise ValueError("no family to assign to")
    keys = ["_source_corpus", "_score_band", "_domain"]
    rows = numbered_in_turn(_narrow(anchors, order), keys, [f"_vl_o{k}" for k in range(len(order))], "_turn", "_seen").drop(*(f"_vl_o{k}" for k in range(len(order))))
    first = rows.where("_turn = 0").select(*(F.col(k).alias(f"{k}_") for k in keys), F.col("_seen").alias("_first"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    shown = lambda c: F.coalesce(F.col(c), F.lit("None"))
    mixed = numbered(rows.join(first, same), ["_turn", band_rank(shown("_score_band")), shown("_source_corpus"), shown("_domain"), "_first"], "_n")
    return _rows(mixed if limit is None else mixed.where(F.col("_n") < limit), families, candidates, "balanced", "_n")


def planned(anchors: DataFrame, plan: DataFrame, order: list[str], candidates: int = 3) -> DataFrame:
    """Assignments of a given plan (``essay_id``, ``dialect_family``, ``demo_reason``)."""
    kept = last_of_each(anchors, identifier(anchors, strict=False), order).select("_key", "_row.*")
    rows = plan.select(F.col("essay_id").alias("_key"), "dialect_family", "demo_reason").join(kept.drop("dialect_family", "demo_reason"), "_key")
    return rows.select(
        F.col("_key").alias("anchor_id"), "dialect_family", F.lit(candidates).alias("target_candidates"), F.lit("curated_demo").alias("assignment_strategy"),
        source(rows).alias("source_corpus"), *(rows[c] if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("score_band",)), domain(rows).alias("domain"), "demo_reason",
    )


def unmatched(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Keys of ``left`` that ``right`` lacks; a strict join is one for which this is empty."""
    return left.join(right, on, "left_anti").select(on).distinct()


def jobs(assignments: DataFrame, anchors: DataFrame, families: DataFrame, template: str, version: str, order: list[str]) -> DataFrame:
    """A job for each candidate an assignment asks for, with its prompt.

    Of repeated anchors the last in the order counts. The prompt is rendered once for each assignment, before
    it is multiplied. Assignments whose anchor or family is unknown give no job; see :func:`unmatched`.
    """
    kept = last_of_each(anchors, identifier(anchors, strict=False), order).select(F.col("_key").alias("anchor_id"), F.col("_row").alias("_a"))
    flat = kept.select("anchor_id", "_a.*") if "anchor_id" not in anchors.columns else kept.select("anchor_id", *(F.col(f"_a.{c}").alias(c) for c in anchors.columns if c != "anchor_id"))
    asked = F.when(is_blank("prompt"), F.lit("[PROMPT NOT PROVIDED]")).otherwise(F.col("prompt")) if "prompt" in flat.columns else F.lit("[PROMPT NOT PROVIDED]")
    about = flat.select("anchor_id", asked.alias("_prompt"), anchor_text(flat).alias("_text"))
    rows = assignments.select("anchor_id", "dialect_family", F.coalesce("target_candidates", F.lit(3)).alias("_many")).join(about, "anchor_id").join(families.select("dialect_family", "inventory_text", "notes_text"), "dialect_family")
    prompt = replaced(template, [("{PROMPT}", "_prompt"), ("{ANCHOR_RESPONSE}", "_text"), ("{DIALECT_FAMILY}", "dialect_family"), ("{FEATURE_INVENTORY}", "inventory_text"), ("{DISALLOWED_FEATURES_AND_NOTES}", "notes_text")])
    rendered = rows.withColumn("generation_prompt", prompt).where("_many > 0").withColumn("candidate_index", F.explode(F.sequence(F.lit(1), F.col("_many").cast("int"))))
    return rendered.select(job_id(F.col("anchor_id"), text("dialect_family"), F.col("candidate_index")).alias("job_id"), "anchor_id", "dialect_family", "candidate_index", F.lit(version).alias("prompt_version"), "generation_prompt")
