"""Pre-filter, scores and verdicts of candidates against their source texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variantloom.functions import similarity as sim
from variantloom.functions.alignment import align
from variantloom.functions.text import reasons, strip, text, word_count
from variantloom.operators.anchors import candidate_text, row_anchor_text
from variantloom.session import spread
from variantloom.sources.inventory import labels, marker_rows, markers

# Statuses of a candidate that was made, and of one that was not.
PASSING = ("ok", "demo_unvalidated", "generated", "scored")
FAILED = ("failed", "model_fail", "api_error")


def is_failed(df: DataFrame) -> Column:
    """Whether response or raw output is just ``FAIL``, or the status says so."""
    said = [strip(text(c)) == "FAIL" for c in ("candidate_response", "raw_output") if c in df.columns]
    out = strip(F.lower(text("generation_status"))).isin(*FAILED) if "generation_status" in df.columns else F.lit(False)
    for s in said:
        out = out | s
    return out


def says_fail(c: Column) -> Column:
    return F.upper(strip(c)) == "FAIL"


def marker_hits(c: Column, family: Column, inventory: dict[str, dict]) -> Column:
    """``array<struct<marker, n>>`` of the family's markers in a text, in their order; empty for an unknown family.

    The inventory is configuration, so each pattern is a literal that is compiled once; no join is needed.
    """
    low = F.lower(text(c))
    by: dict[str, list[Column]] = {}
    for name, _, marker, pattern in marker_rows(inventory):
        by.setdefault(name, []).append(F.struct(F.lit(marker).alias("marker"), F.regexp_count(low, F.lit(pattern)).alias("n")))
    out = F.array().cast("array<struct<marker:string,n:int>>")
    for name, hits in by.items():
        out = F.when(family == name, F.array(*hits)).otherwise(out)
    return F.filter(out, lambda h: h["n"] > 0)


def detected(hits: Column) -> Column:
    """Distinct markers in order."""
    return F.array_distinct(F.transform(hits, lambda h: h["marker"]))


def realizations(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0), lambda s, h: s + h["n"])


def names_of(family: Column, lists: dict[str, list[str]]) -> Column:
    """The list of a family; empty for an unknown one."""
    out = F.array().cast("array<string>")
    for name, values in lists.items():
        out = F.when(family == name, F.array(*map(F.lit, values)).cast("array<string>")).otherwise(out)
    return out


def length_delta(anchor: Column, candidate: Column) -> Column:
    """Difference of the word counts by the anchor's (1 at least)."""
    base = F.greatest(word_count(anchor), F.lit(1))
    return F.abs(word_count(candidate) - base) / base


def prefilter(pairs: DataFrame, inventory: dict[str, dict], tolerance: float = 0.20, least: int = 2, corrections: bool = True) -> DataFrame:
    """Adds the pre-filter's columns; ``pairs`` has ``anchor_response``, a candidate text and ``dialect_family``.

    Without ``corrections`` nothing leaves the JVM and respellings are not looked for.
    """
    family = F.col("dialect_family")
    pairs = spread(pairs) if corrections else pairs
    rows = pairs.withColumns({"_vl_anchor": row_anchor_text(pairs), "_vl_text": candidate_text(pairs, "prefilter")})
    rows = rows.withColumns({"_vl_hits": marker_hits(F.col("_vl_text"), family, inventory), "_vl_delta": length_delta(F.col("_vl_anchor"), F.col("_vl_text"))})
    if corrections:
        allowed = names_of(family, {f: labels(c) for f, c in inventory.items()})
        found = align(F.col("_vl_anchor"), F.col("_vl_text"), allowed=allowed, chars="none")["corrections"]
    else:
        found = F.array().cast("array<string>")
    rows = rows.withColumns({"detected_features": detected(F.col("_vl_hits")), "feature_realization_count": realizations(F.col("_vl_hits")), "student_text_corrections": found})
    why = reasons(
        ("length_outside_tolerance", F.col("_vl_delta") > tolerance), ("insufficient_approved_features", F.col("feature_realization_count") < least),
        ("generation_failed", says_fail(F.col("_vl_text"))), ("student_text_correction", F.size("student_text_corrections") > 0),
    )
    out = rows.withColumn("rejection_reasons", why).withColumn("passed_prefilter", F.size("rejection_reasons") == 0)
    shown = sim.rounded(F.col("_vl_delta")) if corrections else F.col("_vl_delta")
    return out.withColumns({"length_delta": shown, "semantic_equivalence_status": F.lit("not_checked")}).drop("_vl_anchor", "_vl_text", "_vl_hits", "_vl_delta")


def scores(anchor: Column, candidate: Column, edits: Column, char_jaccard: Column, char_ratio: Column) -> Column:
    """The struct of cheap scores, rounded to four places."""
    r, longest = sim.rounded, F.greatest(F.length(anchor), F.length(candidate))
    return F.struct(
        sim.exact(anchor, candidate).alias("exact_match"), r(sim.length_ratio(anchor, candidate)).alias("length_ratio"), edits.alias("levenshtein_distance"),
        r(F.when(longest == 0, F.lit(0.0)).otherwise(edits / longest)).alias("levenshtein_normalized"), r(sim.token_jaccard(anchor, candidate)).alias("token_jaccard"),
        r(char_jaccard).alias("char_3gram_jaccard"), r(char_ratio).alias("difflib_ratio"),
    )


def score(pairs: DataFrame, inventory: dict[str, dict], least_change: float = 0.005, most_delta: float = 0.20, least_words: int = 10) -> DataFrame:
    """Adds scores, word counts, corrections and the verdict. Reasons that were there stay, but for ``student_text_correction``, which is found anew."""
    family = F.col("dialect_family")
    pairs = spread(pairs)
    rows = pairs.withColumns({"_vl_anchor": row_anchor_text(pairs), "_vl_text": candidate_text(pairs, "score")})
    spans = F.col("applied_spans") if "applied_spans" in pairs.columns else None
    allowed = names_of(family, {f: markers(c) for f, c in inventory.items()})
    rows = rows.withColumn("_vl_m", align(F.col("_vl_anchor"), F.col("_vl_text"), allowed=allowed, spans=spans, chars="char"))
    rows = sim.with_char_jaccard(rows, "_vl_anchor", "_vl_text", "_vl_jaccard").withColumn("_vl_edits", sim.edit_distance("_vl_anchor", "_vl_text"))
    rows = rows.withColumns({
        "similarity_scores": scores(F.col("_vl_anchor"), F.col("_vl_text"), F.col("_vl_edits"), F.col("_vl_jaccard"), F.col("_vl_m.char_ratio")), "anchor_word_count": word_count("_vl_anchor"), "candidate_word_count": word_count("_vl_text"),
        "rewrite_word_count": word_count("_vl_text"), "student_text_corrections": F.col("_vl_m.corrections"),
    })
    rows = rows.withColumn("composite_change_score", sim.rounded(1 - F.col("similarity_scores.difflib_ratio")))
    rows = rows.withColumn("quality_score", sim.rounded(F.col("composite_change_score") * F.col("similarity_scores.token_jaccard")))
    status = strip(F.lower(text("generation_status"))) if "generation_status" in pairs.columns else F.lit("")
    a, c = F.col("anchor_word_count"), F.col("candidate_word_count")
    fresh = reasons(
        ("generation_failed", is_failed(pairs) | says_fail(F.col("_vl_text"))), ("student_text_correction", F.size("student_text_corrections") > 0),
        ("length_outside_tolerance", (a > 0) & (c > 0) & (F.abs(c - a) / a > most_delta)), ("candidate_too_short", c < least_words), ("insufficient_change", F.col("composite_change_score") < least_change),
    )
    odd = F.when((status != "") & ~status.isin(*PASSING), F.array(F.concat(F.lit("generation_status:"), status))).otherwise(F.array().cast("array<string>"))
    before = F.coalesce(F.col("rejection_reasons"), F.array().cast("array<string>")) if "rejection_reasons" in pairs.columns else F.array().cast("array<string>")
    kept = F.filter(before, lambda x: x != "student_text_correction")
    out = rows.withColumn("rejection_reasons", F.array_sort(F.array_distinct(F.concat(kept, odd, fresh))))
    return out.withColumn("passed_quality_filter", F.size("rejection_reasons") == 0).drop("_vl_anchor", "_vl_text", "_vl_m", "_vl_jaccard", "_vl_edits")


def rule_reasons(anchor: Column, candidate: Column, most_delta: float = 0.20, least_words: int = 10) -> Column:
    """The scoring rules that need no alignment: length and shortness. Words are counted once, wherever the plan moves the rules."""
    counts = F.array(F.struct(word_count(anchor).alias("a"), word_count(candidate).alias("c")))
    rules = lambda s: reasons(("length_outside_tolerance", (s["a"] > 0) & (s["c"] > 0) & (F.abs(s["c"] - s["a"]) / s["a"] > most_delta)), ("candidate_too_short", s["c"] < least_words))
    return F.transform(counts, rules)[0]
