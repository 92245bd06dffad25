"""Selection, resumption and replacement of records, and tallies over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variantloom.functions.text import first_filled, listed


def split(rows: DataFrame, flag: str = "passed_quality_filter") -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and the rest; null does not pass."""
    good = F.coalesce(F.col(flag), F.lit(False))
    return rows.where(good), rows.where(~good)


def best_of_each(rows: DataFrame, n: int | None = None, key: str = "anchor_id", value: str = "quality_score", flag: str = "passed_quality_filter", order: list[str] = ("candidate_index", "candidate_id")) -> DataFrame:
    """Passing rows; with ``n`` the best of each key with ``selected_reason``.

    Ties go by ``order``, a null value counts as 0. The total in the reason is the key's passing rows.
    A task hands on at most ``n`` rows of a key (Spark limits ranked windows before their shuffle), and the
    totals are counts, so no key's rows meet in one task.
    """
    passing = split(rows, flag)[0]
    if n is None:
        return passing
    worth = F.coalesce(F.col(value), F.lit(0.0))
    top = passing.withColumn("_vl_rank", F.row_number().over(Window.partitionBy(key).orderBy(worth.desc(), *order))).where(F.col("_vl_rank") <= n)
    totals = passing.groupBy(F.col(key).alias("_vl_key")).agg(F.count("*").alias("_vl_total"))
    top = top.join(totals, F.col(key).eqNullSafe(F.col("_vl_key")))
    why = F.concat(F.lit("rank "), F.col("_vl_rank").cast("string"), F.lit("/"), F.col("_vl_total").cast("string"), F.lit(" for anchor "), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return top.withColumn("selected_reason", why).drop("_vl_rank", "_vl_key", "_vl_total")


def reason_tally(rows: DataFrame, top: int | None = None, flag: str = "passed_quality_filter", order: list[str] = ("candidate_id",)) -> DataFrame:
    """How often each reason rejects a row: ``reason``, ``n``, most first; ``top`` keeps the first ones.

    Ties stand as they are first seen, rows taken by ``order`` (columns that ``rows`` lacks are passed over)
    and a row's reasons in theirs; then by name.
    """
    seen = [F.col(c) for c in order if c in rows.columns]
    told = split(rows, flag)[1].select(F.struct(*seen, F.lit(0).alias("_vl_none")).alias("_vl_row"), F.posexplode("rejection_reasons").alias("_vl_at", "reason"))
    counts = told.groupBy("reason").agg(F.count("*").alias("n"), F.min(F.struct("_vl_row", "_vl_at")).alias("_vl_seen"))
    counts = counts.orderBy(F.desc("n"), "_vl_seen", "reason").select("reason", "n")
    return counts if top is None else counts.limit(top)


def verdict_counts(rows: DataFrame, flag: str = "passed_quality_filter") -> DataFrame:
    """One row: ``n``, ``passed``, ``rejected`` and ``respelt`` (rejected for a corrected source text)."""
    good = F.coalesce(F.col(flag), F.lit(False))
    return rows.agg(F.count("*").alias("n"), F.count_if(good).alias("passed"), F.count_if(~good).alias("rejected"), F.count_if(F.array_contains("rejection_reasons", "student_text_correction")).alias("respelt"))


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def rolled_up(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts by all keys, their prefixes and in all; null where a key is summed over (see ``level``)."""
    return rows.rollup(*keys).agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def lists_by(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Sorted distinct values of each key."""
    return rows.select(key, value).distinct().groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(f"{value}_list"))


def ids(rows: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Distinct ids that are neither null nor empty."""
    return rows.select(first_filled(F.col(key).cast("string")).alias(key)).where(F.col(key).isNotNull()).distinct()


def remaining(jobs: DataFrame, done: DataFrame, key: str, done_key: str | None = None) -> DataFrame:
    """Jobs whose id no record of ``done`` has; those without an id remain."""
    seen = ids(done, done_key or key).withColumnRenamed(done_key or key, "_vl_done")
    return jobs.join(seen, F.col(key).cast("string") == F.col("_vl_done"), "left_anti")


def head(rows: DataFrame, n: int | None, order: list[str]) -> DataFrame:
    """The first n rows of an order (a feature of its own, not a way to save work)."""
    return rows if n is None else rows.orderBy(*order).limit(n)


def appended(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def without(rows: DataFrame, drop: DataFrame, key: str) -> DataFrame:
    """Rows whose id is not among those of ``drop``."""
    return rows.join(ids(drop, key).withColumnRenamed(key, "_vl_drop"), F.col(key).cast("string") == F.col("_vl_drop"), "left_anti")


def upserted(base: DataFrame, new: DataFrame, key: str = "candidate_id", order: list[str] = ()) -> DataFrame:
    """``base`` with every copy of a record replaced by the new one of its id, and new ids appended.

    Of several new records of an id the last in ``order`` counts. A replacement is a fresh record: columns it
    lacks become null. Base rows without an id stay.
    """
    columns = list(dict.fromkeys([*base.columns, *new.columns]))
    types = {**dict(new.dtypes), **dict(base.dtypes)}
    whole = lambda df: F.struct(*((df[c] if c in df.columns else F.lit(None).cast(types[c])).alias(c) for c in columns))
    fresh = new.where(F.col(key).isNotNull()).select(F.col(key).alias("_vl_key"), F.struct(*(order or [key])).alias("_vl_order"), whole(new).alias("_vl_new")).groupBy("_vl_key").agg(F.max_by("_vl_new", "_vl_order").alias("_vl_new"))
    old = base.select(F.col(key).alias("_vl_id"), whole(base).alias("_vl_old"))
    kept = old.join(fresh, F.col("_vl_id") == F.col("_vl_key"), "left").select(F.coalesce("_vl_new", "_vl_old").alias("_vl_r"))
    added = fresh.join(old.select("_vl_id"), F.col("_vl_key") == F.col("_vl_id"), "left_anti").select(F.col("_vl_new").alias("_vl_r"))
    return kept.unionByName(added).select("_vl_r.*")


def targets(scored: DataFrame, wanted: list[str], flag: str = "passed_quality_filter") -> DataFrame:
    """Ids of records that did not pass for one of the wanted reasons."""
    hit = F.arrays_overlap(F.coalesce(F.col("rejection_reasons"), F.array().cast("array<string>")), F.array(*map(F.lit, wanted)).cast("array<string>"))
    return ids(split(scored, flag)[1].where(hit))


def to_retry(scored: DataFrame, wanted: list[str], finished: DataFrame | None = None, only: str | None = None, limit: int | None = None) -> DataFrame:
    """Targets without those already retried, among an allow-list (comma-separated), in order of id, the first ``limit``."""
    rows = targets(scored, wanted)
    if finished is not None:
        rows = rows.join(ids(finished, "retry_of_candidate_id").withColumnRenamed("retry_of_candidate_id", "candidate_id"), "candidate_id", "left_anti")
    if only:
        rows = rows.where(F.array_contains(listed(F.lit(only)), F.col("candidate_id")))
    return head(rows, limit, ["candidate_id"])


def latest(rows: DataFrame, key: str, at: list[str | Column]) -> DataFrame:
    """One record of each id, the last by ``at``; nulls come first. Kept with partial aggregation."""
    row = F.struct(*rows.columns)
    return rows.groupBy(F.col(key).alias("_vl_key")).agg(F.max_by(row, F.struct(*at)).alias("_vl_row")).select("_vl_row.*")


