"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from variantloom.llm import mixing, neardup, pairs, reading, sampling, textnorm, tokens, truncation


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _spent(candidates: DataFrame) -> Column:
    return F.coalesce(candidates["usage.output_tokens"], candidates["tokens_out"])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates whose response was cut off before its end."""
    return truncation.judged(c := _table(spark, folder, "candidates"), tokens=_spent(c)).where("cut").select("candidate_id").distinct()


def p1_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Share of each model's candidates that is cut off."""
    return truncation.report(c := _table(spark, folder, "candidates"), tokens=_spent(c))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of candidates that share at least half of their three-word runs."""
    return neardup.similar_pairs(_table(spark, folder, "candidates")).select("candidate_id_a", "candidate_id_b")


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Class and group of every candidate of at least 30 words."""
    return neardup.groups(_table(spark, folder, "candidates"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates whose response the consistent form changes."""
    return textnorm.consistent_form(_table(spark, folder, "candidates")).where("changed").select("candidate_id").distinct()


def p5_consistent(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate's response in its consistent form."""
    return textnorm.consistent_form(_table(spark, folder, "candidates")).select("candidate_id", "consistent", "changed").distinct()


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode(_table(spark, folder, "documents"))


def _defects(spark: SparkSession, folder: str) -> DataFrame:
    """One defect, or none, of each candidate; of copies of a record that differ the defective one counts."""
    candidates = _table(spark, folder, "candidates")
    return pairs.judged(candidates, _table(spark, folder, "prompt_jobs"), _spent(candidates)).groupBy("candidate_id").agg(F.max("defect").alias("defect"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Defective pairs of prompt and response, each with its defect."""
    return _defects(spark, folder).where("defect is not null")


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct candidates by defect; null for sound pairs."""
    return _defects(spark, folder).groupBy("defect").agg(F.count("*").alias("n"))


def _sampled(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    summary, families = _table(spark, folder, "dart_anchor_summary"), _table(spark, folder, "family_targets")
    pool = sampling.pool_of(_table(spark, folder, "anchors"), _table(spark, folder, "assignments"), summary, families)
    return sampling.sample(pool, sampling.cells_of(pool, summary, families, 0.2))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Cells whose target or floor the pool cannot reach."""
    return _sampled(spark, folder)[1].where("short").select(*sampling.CELL)


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Target, floor, pool and sampled rows of every cell."""
    return _sampled(spark, folder)[1]


def p4_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The sampled pairs of anchor and family."""
    return _sampled(spark, folder)[0]


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that cannot reach their weight."""
    return p7_report(spark, folder).where("short").select("source")


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens, passes and actual share of every source with a target."""
    return mixing.mix(_table(spark, folder, "documents"), _table(spark, folder, "mix_targets"))[1]


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The mixed documents in their order."""
    return mixing.mix(_table(spark, folder, "documents"), _table(spark, folder, "mix_targets"))[0].withColumnRenamed("_key", "source")


def p8_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Score and level of every English document."""
    return reading.levels(_table(spark, folder, "documents"), _table(spark, folder, "reading_labels"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """English documents of level 4."""
    return p8_levels(spark, folder).where("level = 4").select("doc_id").distinct()


def p8_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """The largest move of a score in each round of the propagation."""
    return spark.createDataFrame(reading.harmonic(_table(spark, folder, "documents"), _table(spark, folder, "reading_labels"))[1], "round int, largest_move double")


def p8_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Levels by source."""
    documents = _table(spark, folder, "documents").withColumn("source", mixing.source_key("source"))
    return reading.profile(p8_levels(spark, folder), documents)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q.__name__: q for q in (p1_found, p1_sources, p2_found, p2_groups, p3_found, p3_counts, p4_found, p4_report, p4_sample, p5_found, p5_consistent, p6_ids, p7_found, p7_report, p7_mix, p8_found, p8_levels, p8_rounds, p8_profile)}
_CELLS = r"""WITH d AS (SELECT regexp_replace(lower(dataset), '[\s_-]+', '', 'g') AS k, min(dataset) AS dataset FROM dart_anchor_summary GROUP BY 1),
b AS (SELECT DISTINCT upper(trim(score_band)) AS k, score_band FROM dart_anchor_summary),
f AS (SELECT regexp_replace(lower(x), '[\s_-]+', '', 'g') AS k, min(dialect_family) AS dialect_family FROM (SELECT dialect_family, unnest([part, regexp_replace(part, '\s+english$', '', 'i'), regexp_replace(part, '(\s+american)?\s+english$', '', 'i')]) AS x
 FROM (SELECT dialect_family, unnest(list_concat([dialect_family], regexp_split_to_array(dialect_family, '\s*[/()]\s*'))) AS part FROM family_targets)) WHERE x <> '' GROUP BY 1),
known AS (SELECT essay_id, min(d.dataset) AS dataset, min(b.score_band) AS score_band FROM anchors a JOIN d ON regexp_replace(lower(a.dataset), '[\s_-]+', '', 'g') = d.k
 JOIN b ON CASE WHEN upper(trim(a.score_band)) = 'MEDIUM' THEN 'MID' ELSE upper(trim(a.score_band)) END = b.k GROUP BY 1),
pool AS (SELECT DISTINCT s.anchor_id, f.dialect_family, known.dataset, known.score_band FROM assignments s JOIN f ON regexp_replace(lower(s.dialect_family), '[\s_-]+', '', 'g') = f.k JOIN known ON s.anchor_id = essay_id),
have AS (SELECT dataset, score_band, dialect_family, count(*) AS n FROM pool GROUP BY ALL),
cells AS (SELECT dataset, score_band, dialect_family, "count" / (SELECT sum("count") FROM dart_anchor_summary) * target_share * (SELECT count(*) FROM pool) * 0.2 AS target, min_rows FROM dart_anchor_summary, family_targets)
"""
SQL: dict[str, str] = {"p4_found": _CELLS + "SELECT dataset, score_band, dialect_family FROM cells LEFT JOIN have USING (dataset, score_band, dialect_family) WHERE coalesce(n, 0) < target OR coalesce(n, 0) < min_rows"}
