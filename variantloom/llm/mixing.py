"""Mixing sources to target weights by weighted fair queueing.

Every copy of a document (its source's ``max_repeats`` copies, pass by pass, each pass in a shuffled order)
gets a virtual finish time: the tokens of its source up to and with it, divided by the source's weight. The
mix takes the copies in the order of that time until the budget, all tokens of the corpus, is used up. A
source that runs out leaves its room to the others.

Other spellings (letter case, spaces, ``-`` for ``_``) count for their source. Documents without a source or
with one that has no target count in the total only. Null and empty texts have no tokens and never enter the
mix. A target without a positive weight is reported but gets nothing; a missing ``max_repeats`` counts as 1.
Repeated target rows of a source add up their weights and take the larger repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variantloom.llm.prefix import running_sum, shuffled, slices_for
from variantloom.llm.tokens import token_counts
from variantloom.session import cut


def source_key(c: str) -> Column:
    """The spelling under which sources are compared; null for blank ones."""
    key = F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"[\s ]+", " "))), r"[\s_-]+", "_")
    return F.when(key != "", key)


def targets_of(targets: DataFrame) -> DataFrame:
    return (
        targets.select(source_key("source").alias("_key"), F.col("source").alias("_name"), F.coalesce("target_weight", F.lit(0.0)).alias("_w"), F.coalesce("max_repeats", F.lit(1)).alias("_r"))
        .where("_key is not null").groupBy("_key").agg(F.min("_name").alias("source"), F.sum("_w").alias("target_weight"), F.max("_r").alias("max_repeats"))
    )


def sized(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``_key`` and ``n_tokens`` of every document, written once to the checkpoint folder."""
    rows = documents.select("doc_id", source_key("source").alias("_key"), "text")
    return cut(token_counts(rows, "doc_id", "text", path, ["_key"]))


def timed(sizes: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """The queue: every copy a source may give, with ``repeat`` (from 1), ``queued`` (tokens of its source up to and with it) and ``finish`` (its virtual time)."""
    wanted = targets_of(targets).where("target_weight > 0 and max_repeats > 0")
    rows = sizes.where("n_tokens > 0").join(wanted.drop("source"), "_key")
    copies = rows.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("max_repeats"))))
    copies = copies.withColumn("_at", shuffled("doc_id", "repeat", seed=seed))
    place = (F.col("repeat") - 1 + F.col("_at")) / F.col("max_repeats")
    summed = running_sum(copies, ["_key"], place, ["doc_id"], F.col("n_tokens"), "queued", slices_for(sizes.count()))
    return summed.withColumn("finish", F.col("queued") / F.col("target_weight"))


def served(sizes: DataFrame, queue: DataFrame) -> DataFrame:
    """The mix: the queue's copies by virtual time until the budget is used; ``position`` is tokens up to and with a copy.

    Copies are range-sorted once by virtual time (Spark puts the bounds of its ranges by a sample, so they hold
    like many rows) and written; the sums of the ranges, a row each, give each its start.
    """
    rows = queue.select("doc_id", "_key", "n_tokens", "repeat", "finish").orderBy("finish", "_key", "doc_id", "repeat")
    placed = cut(rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    sums = placed.groupBy("_part").agg(F.sum("n_tokens").alias("_sum"))
    starts = F.broadcast(sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start")))
    within = F.sum("n_tokens").over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    whole = placed.withColumn("position", within).join(starts, "_part").withColumns({"position": F.col("position") + F.col("_start"), "_budget": sizes.agg(F.sum("n_tokens")).scalar()})
    return whole.where("position <= _budget").select("doc_id", "_key", "n_tokens", "repeat", "finish", "position")


def report_of(sizes: DataFrame, queue: DataFrame, mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """A row for each target: its tokens, what it gave, its share, and ``short`` if its weight is out of reach.

    A source is short if its last copy's virtual time comes before the budget: all it can queue is less than
    its weight of the corpus.
    """
    total = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).scalar()
    have = sizes.groupBy("_key").agg(F.sum("n_tokens").alias("source_tokens"), F.count("*").alias("n_documents"))
    most = queue.groupBy("_key").agg(F.max("queued").alias("queued_tokens"))
    got = mixed.groupBy("_key").agg(F.sum("n_tokens").alias("mixed_tokens"), F.max("repeat").alias("passes"))
    out = targets_of(targets).join(have, "_key", "left").join(most, "_key", "left").join(got, "_key", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("source_tokens", "n_documents", "queued_tokens", "mixed_tokens", "passes")}
    out = out.withColumns({**zero, "total_tokens": total, "_mix": mixed.agg(F.sum("n_tokens")).scalar()})
    out = out.withColumn("short", F.col("queued_tokens") < F.col("target_weight") * F.col("total_tokens"))
    return out.withColumn("actual_share", F.when(F.col("_mix") > 0, F.col("mixed_tokens") / F.col("_mix")).otherwise(F.lit(0.0))).drop("_key", "_mix")


def mix(documents: DataFrame, targets: DataFrame, path: str | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The mixed documents and the report."""
    sizes = sized(documents, path)
    queue = timed(sizes, targets, seed)
    mixed = served(sizes, queue)
    return mixed, report_of(sizes, queue, mixed, targets)
