"""Taking back respellings of the source text that candidates were flagged for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variantloom.functions.alignment import repair
from variantloom.operators.anchors import candidate_text
from variantloom.operators.records import latest


def repaired(raw: DataFrame, scored: DataFrame, order: list[str] = ("candidate_id",)) -> DataFrame:
    """``raw`` with flagged words put back and ``mechanical_cleanup_repairs``; rows without flags stay as they are.

    ``scored`` has ``candidate_id``, ``anchor_response`` and ``student_text_corrections``; of repeated ids the
    last in ``order`` counts.
    """
    flags = latest(scored, "candidate_id", list(order)).select(F.col("candidate_id").alias("_id"), F.col("anchor_response").alias("_anchor"), F.col("student_text_corrections").alias("_flags"))
    rows = raw.join(flags.where("size(_flags) > 0"), F.col("candidate_id") == F.col("_id"), "left")
    touched = rows.where("_id is not null").withColumn("_r", repair(F.col("_anchor"), candidate_text(raw, "score"), F.col("_flags")))
    mended = F.size("_r.repairs") > 0  # flags that fit no change leave both texts alone
    texts = {c: F.when(mended, F.col("_r.text")).otherwise(F.col(c)) for c in ("candidate_response", "raw_output")}
    touched = touched.withColumns({**texts, "mechanical_cleanup_repairs": F.col("_r.repairs")}).drop("_r")
    rest = rows.where("_id is null").withColumn("mechanical_cleanup_repairs", F.array().cast("array<string>"))
    return touched.unionByName(rest, allowMissingColumns=True).drop("_id", "_anchor", "_flags")
