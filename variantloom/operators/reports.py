"""Reports as ordered lines: a DataFrame of ``line`` that sorts by its other columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variantloom.functions.text import strip, text
from variantloom.operators.trace import summary, with_corrections

ORDER = ["k1", "k2", "k3", "k4", "k5"]


def _block(title: str, c: Column) -> list[Column]:
    body = strip(text(c))
    return [F.lit(title), F.lit(""), F.lit("```text"), F.when(body == "", "[EMPTY]").otherwise(body), F.lit("```"), F.lit("")]


def _lines(rows: DataFrame, lines: list[Column], k1: int, k2: Column, k3: Column, k4: Column) -> DataFrame:
    parts = F.posexplode(F.array(*(c.cast("string") for c in lines)))
    return rows.select(F.lit(k1).alias("k1"), k2.cast("string").alias("k2"), k3.cast("string").alias("k3"), k4.cast("bigint").alias("k4"), parts.alias("k5", "line")).where("line is not null")


def candidate_report(candidates: DataFrame, anchors: DataFrame, title: str = "Candidate review") -> DataFrame:
    """Lines of a review of all candidates by anchor, family and index; write with :func:`variantloom.sources.records.write_lines`.

    ``anchors`` has ``anchor_id``, ``anchor_response`` and optionally ``score_band`` and ``normalized_score``;
    anchors it lacks have an empty text. Anchors stand in the order of their ids as strings.
    """
    none = F.lit("")
    keyed = candidates.withColumn("anchor_id", F.col("anchor_id").cast("string"))
    counted = keyed.agg(F.count_distinct("anchor_id").alias("a"), F.count("*").alias("n"))
    top = _lines(counted, [F.lit(f"# {title}"), none, F.concat(F.lit("Total anchors with candidates: "), "a"), F.concat(F.lit("Total candidate records: "), "n"), none], 0, none, none, F.lit(0))
    about = anchors.select(F.col("anchor_id").cast("string").alias("_id"), F.col("anchor_response").alias("_text"), *(anchors[c].alias(f"_{c}") if c in anchors.columns else F.lit(None).cast("string").alias(f"_{c}") for c in ("score_band", "normalized_score")))
    families = keyed.groupBy("anchor_id").agg(F.array_join(F.array_sort(F.collect_set(text("dialect_family"))), ", ").alias("_families")).join(about, F.col("anchor_id") == F.col("_id"), "left")
    fact = lambda name, c: F.when(text(c) != "", F.concat(F.lit(f"- {name}: "), F.col(c)))
    heads = _lines(families, [F.concat(F.lit("## Anchor "), "anchor_id"), F.concat(F.lit("- Dialect family: "), "_families"), fact("Score band", "_score_band"), fact("Normalized score", "_normalized_score"), none, *_block("Original anchor response:", F.col("_text"))], 1, F.col("anchor_id"), none, F.lit(-1))
    code = lambda name, c: F.concat(F.lit(f"- {name}: `"), text(c), F.lit("`"))
    index = F.coalesce(F.col("candidate_index"), F.lit(0))
    bodies = _lines(keyed, [F.concat(F.lit("### Candidate "), index.cast("string"), F.lit(" - "), text("dialect_family")), code("Candidate ID", "candidate_id"), code("Status", "generation_status"), code("Model", "model"), none, *_block("Candidate response:", F.col("candidate_response"))], 1, F.col("anchor_id"), text("dialect_family"), index)
    return top.unionByName(heads).unionByName(bodies)


def trace_report(rows: DataFrame, totals: DataFrame | None = None, title: str = "Trace comparison", known: list[str] = ()) -> DataFrame:
    """Lines of a comparison of traced rows; ``totals`` is :func:`variantloom.operators.trace.summary` of them, made here by default.

    With known forms, rows without stored corrections have theirs found anew.
    """
    none = F.lit("")
    rows = with_corrections(rows, known)
    totals = summary(rows) if totals is None else totals
    says = lambda name, c: F.concat(F.lit(f"{name}: "), F.col(c).cast("string"))
    top = _lines(totals, [F.lit(f"# {title}"), none, says("Total trace records", "records"), says("Records with changed output", "changed"), says("Applied feature count", "applied_features"), says("Records with possible student-text corrections", "with_corrections"), none], 0, none, none, F.lit(0))
    changed = strip(text("candidate_response")) != strip(text("anchor_text"))
    code = lambda name, c: F.concat(F.lit(f"- {name}: `"), c.cast("string"), F.lit("`"))
    joined = lambda title, items: F.when(F.size(items) > 0, F.concat(F.lit(f"{title}\n"), F.array_join(items, "\n"), F.lit("\n")))
    tick = lambda c: F.concat(F.lit("`"), text(c), F.lit("`"))
    applied = F.transform("parsed_output.applied", lambda x: F.concat(F.lit("- "), tick(x["id"]), F.lit(": "), tick(x["span_before"]), F.lit(" -> "), tick(x["span_after"])))
    refused = F.transform("parsed_output.rejected", lambda x: F.concat(F.lit("- "), tick(x["id"]), F.lit(": "), text(x["reason"])))
    respelt = F.transform("detected_student_corrections", lambda x: F.concat(F.lit("- "), tick(x)))
    lines = [
        F.concat(F.lit("## Anchor "), text("anchor_id")), code("Dialect family", text("dialect_family")), code("Status", text("generation_status")), code("Changed output", changed),
        code("Applied features", F.size("parsed_output.applied")), code("Possible student-text corrections", F.size("detected_student_corrections")), none,
        *_block("Anchor:", F.col("anchor_text")), *_block("Trace output:", F.col("candidate_response")),
        joined("Applied feature trace:", applied), joined("Rejected feature trace:", refused), joined("Possible student-text corrections:", respelt),
        F.when(text("parsed_output.notes") != "", F.concat(F.lit("Trace note: "), F.col("parsed_output.notes"), F.lit("\n"))),
    ]
    return top.unionByName(_lines(rows, lines, 1, text("anchor_id"), text("trace_id"), F.lit(0)))
