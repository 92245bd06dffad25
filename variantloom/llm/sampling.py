"""A sample that follows target proportions of its cells, by systematic unequal-probability sampling.

The pool's rows stand in the order of their cells, shuffled within each. A row's inclusion probability is its
cell's target over the cell's size (1 at most); with one random start, the rows at which the running sum of
probabilities passes an integer are selected. A cell that then has fewer rows than its floor gets the next
unselected ones of its shuffled order. A row's running sum follows from its number within the cell and the
sum of the cells before, so rows are numbered in slices and no cell is gathered in one task.

The pool: distinct pairs of anchor and family whose anchor has a known data set and band; spellings that
differ in letter case, spaces, ``-`` and ``_``, short family names and ``medium`` count as the standard ones.
Pairs with null or unknown family, data set or band are left out; of an anchor's copies one
with both known counts, else what the copies know together. An empty pool gives an empty sample and a report in which every cell with a target or floor is short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variantloom.llm.prefix import running_sum, shuffled, slices_for
from variantloom.session import cut

CELL = ["dataset", "score_band", "dialect_family"]


def squeezed(c: str | Column) -> Column:
    """Lower case without white space, hyphens and underscores."""
    return F.regexp_replace(F.lower(c), r"[\s _-]+", "")


def band_of(c: str) -> Column:
    band = F.upper(F.trim(c))
    return F.when(band == "MEDIUM", F.lit("MID")).otherwise(band)


def family_names(families: DataFrame) -> DataFrame:
    """``_alias`` and ``dialect_family``: whole names, the parts around ``/`` and brackets, and names without ``American English`` or ``English``."""
    parts = families.select("dialect_family", F.explode(F.concat(F.array("dialect_family"), F.split("dialect_family", r"\s*[/()]\s*"))).alias("_part"))
    short = parts.select("dialect_family", F.explode(F.array("_part", F.regexp_replace("_part", r"(?i)\s+english$", ""), F.regexp_replace("_part", r"(?i)(\s+american)?\s+english$", ""))).alias("_part"))
    return short.select(squeezed("_part").alias("_alias"), "dialect_family").where("_alias != ''").groupBy("_alias").agg(F.min("dialect_family").alias("dialect_family"))


def pool_of(anchors: DataFrame, assignments: DataFrame, summary: DataFrame, families: DataFrame) -> DataFrame:
    """``anchor_id`` with the three columns of its cell, each distinct pair once; written once, as cells and sample both read it."""
    names = summary.where("dataset is not null").groupBy(squeezed("dataset").alias("_d")).agg(F.min("dataset").alias("dataset"))
    bands = summary.select(band_of("score_band").alias("_b"), F.col("score_band")).where("_b is not null").groupBy("_b").agg(F.min("score_band").alias("score_band"))
    known = (
        anchors.select("essay_id", squeezed("dataset").alias("_d"), band_of("score_band").alias("_b")).join(names, "_d", "left").join(bands, "_b", "left")
        .where("essay_id is not null").groupBy("essay_id").agg(F.coalesce(F.min(F.when(F.col("dataset").isNotNull() & F.col("score_band").isNotNull(), F.struct("dataset", "score_band"))), F.struct(F.min("dataset").alias("dataset"), F.min("score_band").alias("score_band"))).alias("_c"))
        .select("essay_id", "_c.*").where("dataset is not null and score_band is not null")
    )
    pairs = assignments.select("anchor_id", squeezed("dialect_family").alias("_alias")).join(family_names(families), "_alias").select("anchor_id", "dialect_family").distinct()
    return cut(pairs.join(known.withColumnRenamed("essay_id", "anchor_id"), "anchor_id").select("anchor_id", *CELL))


def cells_of(pool: DataFrame, summary: DataFrame, families: DataFrame, fraction: float) -> DataFrame:
    """Every cell of the two target tables with ``target``, ``min_rows`` and ``pool_rows``."""
    counts = summary.where("dataset is not null and score_band is not null").groupBy("dataset", "score_band").agg(F.sum("count").alias("_n"))
    every = families.agg(F.collect_list(F.struct("dialect_family", "target_share", "min_rows")).alias("_f"))  # the families are a fixed table
    cells = counts.withColumns({"_f": F.explode(every.scalar()), "_all": counts.agg(F.sum("_n")).scalar()}).select("dataset", "score_band", "_f.*", "_n", "_all")
    have = pool.groupBy(*CELL).agg(F.count("*").alias("pool_rows"))
    out = cells.join(have, CELL, "left").withColumn("_pool", pool.agg(F.count("*")).scalar())
    return out.select(
        *CELL, (F.col("_n") / F.col("_all") * F.coalesce("target_share", F.lit(0.0)) * F.col("_pool") * fraction).alias("target"),
        F.coalesce("min_rows", F.lit(0)).alias("min_rows"), F.coalesce("pool_rows", F.lit(0)).alias("pool_rows"),
    )


def sample(pool: DataFrame, cells: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The sampled rows with ``added`` (by the repair of floors), and the report of the cells.

    A cell is ``short`` if the draw took every row it has and stays below its target, or the repair could not reach its floor.
    """
    start = ((seed * 0x9E3779B97F4A7C15 + 0x5851F42D4C957F2D) % 2**53) / 2**53
    chance = F.when(F.col("pool_rows") > 0, F.least(F.lit(1.0), F.col("target") / F.col("pool_rows"))).otherwise(F.lit(0.0))
    before = Window.orderBy(*CELL).rowsBetween(Window.unboundedPreceding, -1)  # over the cells, a fixed table
    plan = cells.withColumn("_p", chance).withColumn("_at", F.coalesce(F.sum(F.col("_p") * F.col("pool_rows")).over(before), F.lit(0.0)) + start)
    last = F.floor(F.col("_at") + F.col("pool_rows") * F.col("_p") + 1e-9)
    plan = plan.withColumn("_taken", last - F.floor(F.col("_at") + 1e-9)).withColumn("_add", F.greatest(F.lit(0), F.least("min_rows", "pool_rows") - F.col("_taken")))
    rows = running_sum(pool.withColumn("_u", shuffled("anchor_id", *CELL, seed=seed)), CELL, F.col("_u"), ["anchor_id"], F.lit(1), "_i", slices_for(pool.count(), 64))
    joined = rows.join(plan.select(*CELL, "_p", "_at", "_add"), CELL)
    upto = lambda i: F.floor(F.col("_at") + i * F.col("_p") + 1e-9)
    drawn = upto(F.col("_i")) > upto(F.col("_i") - 1)
    missed = F.col("_i") - (upto(F.col("_i")) - F.floor(F.col("_at") + 1e-9))
    taken = joined.withColumn("_drawn", drawn).withColumn("added", ~F.col("_drawn") & (missed <= F.col("_add"))).where("_drawn or added").select("anchor_id", *CELL, "added")
    got = taken.groupBy(*CELL).agg(F.count("*").alias("sampled"), F.sum(F.col("added").cast("int")).alias("added"))
    report = cells.join(got, CELL, "left").withColumns({"sampled": F.coalesce("sampled", F.lit(0)), "added": F.coalesce("added", F.lit(0))})
    drawn = F.col("sampled") - F.col("added")
    return taken, report.withColumn("short", (drawn == F.col("pool_rows")) & (drawn < F.col("target")) | (F.col("sampled") < F.col("min_rows")))
