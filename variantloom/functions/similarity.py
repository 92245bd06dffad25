"""Similarity of two texts, in the JVM but for the edit distance. Values are unrounded; :func:`rounded` gives correctly rounded decimals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variantloom.functions.edits import distances
from variantloom.functions.text import col, lower_words, strip, text, token_set
from variantloom.session import ship


def rounded(c: Column, digits: int = 4) -> Column:
    """Rounded from the binary value, as Python does, in the JVM; Spark's ``round`` works on the decimal form and differs near ties.

    ``x * 10^digits`` is taken as an exact sum of two doubles (Veltkamp's split), so that the half is met
    exactly; a true tie goes to the even digit. For values below 2^52 / 10^digits. Null stays null.
    """
    scale = float(10**digits)

    def exact(v: Column) -> Column:
        parts = F.transform(F.array(v), lambda x: F.struct((x * scale).alias("p"), (x * 134217729.0 - (x * 134217729.0 - x)).alias("h"), x.alias("x")))
        parts = F.transform(parts, lambda s: F.struct(s["p"].alias("p"), ((s["h"] * scale - s["p"]) + (s["x"] - s["h"]) * scale).alias("e"), F.floor(s["p"]).cast("double").alias("k")))
        above = lambda s: (s["p"] - s["k"] > 0.5) | (s["p"] - s["k"] == 0.5) & ((s["e"] > 0) | (s["e"] == 0) & (s["k"] % 2 != 0))
        return F.transform(parts, lambda s: (s["k"] + above(s).cast("double")) / scale)[0]

    return exact(c.cast("double"))


def exact(a: str | Column, b: str | Column) -> Column:
    """Equal without white space at the ends; null equals ''."""
    return strip(text(a)) == strip(text(b))


def length_ratio(a: str | Column, b: str | Column) -> Column:
    """Characters of b to those of a; 0 for an empty a."""
    return F.when(F.length(text(a)) == 0, F.lit(0.0)).otherwise(F.length(text(b)) / F.length(text(a)))


def edit_distance(a: str | Column, b: str | Column) -> Column:
    """Edits of code points, many pairs at once; null equals ''."""
    ship()
    return F.pandas_udf(lambda x, y: pd.Series(distances(x.tolist(), y.tolist()), dtype="int32"), "int")(text(a), text(b))


def edit_share(a: str | Column, b: str | Column) -> Column:
    """Edit distance by the longer length; 0 for two empty texts."""
    longest = F.greatest(F.length(text(a)), F.length(text(b)))
    return F.when(longest == 0, F.lit(0.0)).otherwise(edit_distance(a, b) / longest)


def within_edits(a: str | Column, b: str | Column, k: int) -> Column:
    """Whether the edit distance is at most k, with early exit."""
    return F.levenshtein(text(a), text(b), k) >= 0


def set_jaccard(a: Column, b: Column) -> Column:
    """Shared by all elements of two arrays; 1 for two empty ones, 0 for one."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def token_jaccard(a: str | Column, b: str | Column) -> Column:
    return set_jaccard(token_set(a), token_set(b))


def code_points(c: str | Column) -> Column:
    """Code points of the lower-case text."""
    low = F.lower(text(c))
    return F.when(low == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(low, ""), lambda x: F.ascii(x).cast("bigint")))


def char_grams(codes: Column, n: int = 3) -> Column:
    """Distinct runs of n (3 at most) code points, each as one number; a shorter text is its own only run.

    Numbers, not strings, because distinct and set functions hash them instead of comparing all with all.
    """
    if not 1 <= n <= 3:
        raise ValueError("runs of 1 to 3 characters fit in a number")
    many = F.greatest(F.size(codes) - (n - 1), F.lit(0))
    runs = F.slice(codes, 1, many)
    for j in range(1, n):
        runs = F.zip_with(runs, F.slice(codes, 1 + j, many), lambda x, y: F.shiftleft(x, 21) + y)
    whole = F.array(F.aggregate(codes, F.lit(0).cast("bigint"), lambda x, y: F.shiftleft(x, 21) + y))
    return F.when(many == 0, whole).otherwise(F.array_distinct(runs))


def with_char_jaccard(df: DataFrame, a: str | Column, b: str | Column, name: str, n: int = 3) -> DataFrame:
    """``df`` with the Jaccard similarity of runs of n characters.

    A step on the DataFrame, as code points and runs are each used several times and Catalyst keeps them in
    projections of their own only where they are columns.
    """
    steps = df.withColumns({"_vl_x": code_points(a), "_vl_y": code_points(b)})
    steps = steps.withColumns({"_vl_x": char_grams(F.col("_vl_x"), n), "_vl_y": char_grams(F.col("_vl_y"), n)})
    return steps.withColumn(name, set_jaccard(F.col("_vl_x"), F.col("_vl_y"))).drop("_vl_x", "_vl_y")


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two number arrays; 0 for null or empty ones, different lengths or zero norms."""
    x, y = (F.transform(F.coalesce(col(c), F.array().cast("array<double>")), lambda v: v.cast("double")) for c in (a, b))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, w: s + w)
    dot = total(F.zip_with(x, y, lambda p, q: F.coalesce(p * q, F.lit(0.0))))
    norm = F.sqrt(total(F.transform(x, lambda v: v * v))) * F.sqrt(total(F.transform(y, lambda v: v * v)))
    return F.when((F.size(x) != F.size(y)) | (F.size(x) == 0) | (norm == 0), F.lit(0.0)).otherwise(dot / norm)


def is_append(a: str | Column, b: str | Column, most: int = 3) -> Column:
    """Whether b has the words of a and then 1 to ``most`` more."""
    x, y = lower_words(a), lower_words(b)
    extra = F.size(y) - F.size(x)
    return extra.between(1, most) & (F.slice(y, 1, F.size(x)) == x)
