"""Reading levels by harmonic propagation over a graph of documents and words.

English documents and their words (with the lengths of their sentences as further nodes) form a bipartite
graph; an edge weighs (1 + ln tf) * ln(N / df)^2. Graded documents are clamped at the mean of their grades. In
each round a word takes the weighted mean of its documents, then a document that of its words. Each ungraded
document also has a leaf of its own that holds what the words of graded documents alone say of it, and takes
``LEAF`` of its value from there: this keeps scores from levelling, and makes each round a contraction, so
that the rounds converge. They are run until no score moves by more than ``TOLERANCE``. Words of one document
only carry nothing between documents and are left out.

A document's score is what its words and its leaf say, clamped or not. The cuts between levels are put where
they tell the grades of at most ``GRADED`` graded documents apart best, in the middle of the widest such range.

Documents whose ``lang`` says English (any spelling) are English; of those that have none, the ones whose words
are known enough: a word is known if three documents said to be English have it, and the share that tells all
documents said to be English from all said to be in other languages best is asked for. Others, and null, empty
and blank texts, have no score and no level. Short marks around a text are a few words among many and shift a
score by little. Repeated grades of one document are averaged; grades of unknown documents count for nothing.
Without any grade there are no levels.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variantloom.llm.prefix import SLICES, bounded_sample
from variantloom.session import cut, ship

#: Share of its value an ungraded document takes from its leaf, the largest move of a score after the last round.
LEAF, TOLERANCE = 0.5, 1e-3
#: Upper bound of the graded documents the cuts are fitted on.
GRADED = 20_000
#: Nodes, those of most documents, whose values are broadcast (24 bytes each); the others, each of few documents, are joined by a shuffle.
HOT = 100_000
LEVELS = (1, 2, 3, 4)
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_END = re.compile(r"[.!?]+\s")


def nodes_of(text: str) -> dict[str, int]:
    """Words and sentence lengths (on a scale of half octaves) with their counts."""
    low = text.lower().replace(chr(0x2019), "'")
    out = Counter(_WORD.findall(low))
    for sentence in _END.split(low):
        n = len(sentence.split())
        if n > 2:
            out[f"#{min(16, int(np.log2(n) * 2))}"] += 1
    return out


def graph(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``kind`` (``en``, ``unknown`` or ``other``), ``nodes`` (hashes) and ``tf`` of all documents with words."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "kind": [], "nodes": [], "tf": []}
            for i, text, kind in zip(batch["doc_id"], batch["text"], batch["kind"]):
                words = nodes_of(text)
                if not words:
                    continue
                if len(known) > 500_000:
                    known = {}
                for w in words:
                    if w not in known:
                        known[w] = xxhash.xxh3_64_intdigest(w) - (1 << 63)
                out["doc_id"].append(i)
                out["kind"].append(kind)
                out["nodes"].append([known[w] for w in words])
                out["tf"].append([1 + float(np.log(n)) for n in words.values()])
            yield pd.DataFrame(out)

    lang = F.lower(F.trim("lang"))
    kind = F.when(F.coalesce(lang, F.lit("")) == "", F.lit("unknown")).when(lang.rlike("^en($|[^a-z])|^english$"), F.lit("en")).otherwise(F.lit("other"))
    rows = documents.where("text is not null").select("doc_id", "text", kind.alias("kind"))
    return rows.mapInPandas(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, kind string, nodes array<bigint>, tf array<double>")


def _edges(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select("doc_id", *columns, F.explode(F.arrays_zip("nodes", "tf")).alias("_e")).select("doc_id", *columns, F.col("_e.nodes").alias("node"), F.col("_e.tf").alias("tf"))


def _hot(weights: DataFrame) -> DataFrame:
    """The nodes of most documents, ``HOT`` of them."""
    return cut(weights.orderBy(F.desc("_df"), "node").limit(HOT).select("node"))


def _met(edges: DataFrame, values: DataFrame, hot: DataFrame, many: bool) -> DataFrame:
    """``edges`` with the values of their nodes: hot nodes by broadcast, where there are ``many`` the others by a shuffle."""
    if not many:
        return edges.join(F.broadcast(values), "node")
    warm = edges.join(F.broadcast(values.join(F.broadcast(hot), "node", "left_semi")), "node")
    return warm.unionByName(edges.join(F.broadcast(hot), "node", "left_anti").join(values, "node"))


def english(docs: DataFrame) -> DataFrame:
    """Of the documents of :func:`graph`, those in English."""
    said = docs.where("kind = 'en'")
    if docs.where("kind = 'unknown'").isEmpty():
        return said.drop("kind")
    words = cut(said.select(F.explode("nodes").alias("node")).groupBy("node").agg(F.count("*").alias("_df")).where("_df >= 3"))
    many = words.limit(HOT + 1).count() > HOT
    hits = _met(_edges(docs), words.select("node"), _hot(words), many).groupBy("doc_id").agg(F.sum("tf").alias("_hit"))
    every = docs.select("doc_id", "kind", F.aggregate("tf", F.lit(0.0), lambda a, b: a + b).alias("_all"))
    shares = cut(every.join(hits, "doc_id", "left").select("doc_id", "kind", (F.coalesce("_hit", F.lit(0.0)) / F.col("_all")).alias("share")))
    good = shares.where((F.col("kind") == "unknown") & (F.col("share") >= _least_share(shares))).select("doc_id")
    return said.unionByName(docs.where("kind = 'unknown'").join(good, "doc_id", "left_semi")).drop("kind")


def _least_share(shares: DataFrame) -> float:
    """The share of known words that tells English best from other languages, over all documents of known ``kind``; one half without documents of both.

    In the widest such gap, a third of the way up: English on a new subject has fewer known words than the
    documents at hand, while other languages have no more of them. Errors of either kind count by their share
    of their kind, in whole numbers. Shares are sorted within slices; the driver sees a row for each slice.
    """
    counted = shares.where("kind != 'unknown'").groupBy("share").agg(F.sum((F.col("kind") == "en").cast("bigint")).alias("_en"), F.sum((F.col("kind") != "en").cast("bigint")).alias("_other"))
    places = cut(counted.withColumn("_slice", F.least(F.floor(F.col("share") * SLICES), F.lit(SLICES - 1)).cast("int")))
    slices = [tuple(r) for r in places.groupBy("_slice").agg(F.sum("_en"), F.sum("_other"), F.min("share")).orderBy("_slice").collect()]
    en, other = sum(r[1] for r in slices), sum(r[2] for r in slices)
    if not en or not other:
        return 0.5
    starts = [(r[0], sum(x[1] for x in slices[:k]), sum(x[2] for x in slices[:k]), slices[k + 1][3] if k + 1 < len(slices) else None) for k, r in enumerate(slices)]
    starts = places.sparkSession.createDataFrame(starts, "_slice int, _en0 bigint, _other0 bigint, _first double")
    order = Window.partitionBy("_slice").orderBy("share")
    below = order.rowsBetween(Window.unboundedPreceding, 0)
    edges = places.select("_slice", "share", F.sum("_en").over(below).alias("_en"), F.sum("_other").over(below).alias("_other"), F.lead("share").over(order).alias("_after")).join(F.broadcast(starts), "_slice")
    edges = edges.select("share", F.coalesce("_after", "_first").alias("_next"), ((F.col("_en0") + F.col("_en")) * other + (other - F.col("_other0") - F.col("_other")) * en).alias("_wrong")).where("_next is not null")
    best = edges.orderBy("_wrong", F.desc(F.col("_next") - F.col("share")), "share").first()
    return slices[0][3] if best is None else (2 * best["share"] + best["_next"]) / 3


def harmonic(documents: DataFrame, labels: DataFrame, leaf: float = LEAF, tolerance: float = TOLERANCE) -> tuple[DataFrame, list[tuple[int, float]]]:
    """``doc_id``, ``score`` and ``grade`` (null where not graded) of every English document with words, and the largest move of a score in each round."""
    if not 0 < leaf < 1:
        raise ValueError("a leaf's share lies between 0 and 1")
    grades = labels.where("doc_id is not null and level is not null").groupBy("doc_id").agg(F.avg("level").alias("grade"))
    docs = english(cut(graph(documents)))
    docs = cut(docs.join(grades, "doc_id", "left"))  # the arrays are written once; rounds write scores only
    n = docs.agg(F.count("*")).scalar()
    weight = _edges(docs).groupBy("node").agg(F.count("*").alias("_df")).where("_df > 1").select("node", "_df", F.pow(F.log(n / F.col("_df")), F.lit(2)).alias("idf"))
    weight = cut(weight.where("idf > 0"))
    hot, many = _hot(weight), weight.limit(HOT + 1).count() > HOT
    idf = weight.select("node", "idf")
    every = _edges(docs)

    def drawn(state: DataFrame) -> DataFrame:
        """What the words say of each document, given the documents' values ``_f``."""
        # idf is the same for all edges of a word and falls out of its mean
        spoken = _edges(state.where("_f is not null"), "_f").groupBy("node").agg((F.sum(F.col("tf") * F.col("_f")) / F.sum("tf")).alias("says")).join(idf, "node")
        met = _met(every, cut(spoken), hot, many)
        return cut(met.groupBy("doc_id").agg((F.sum(F.col("tf") * F.col("idf") * F.col("says")) / F.sum(F.col("tf") * F.col("idf"))).alias("_from")))

    leaves = drawn(docs.withColumn("_f", F.col("grade"))).withColumnRenamed("_from", "_leaf")
    score, moves = leaves.withColumnRenamed("_leaf", "score"), []
    while True:
        state = docs.join(score, "doc_id", "left").withColumn("_f", F.coalesce("grade", "score"))
        said = drawn(state).join(leaves, "doc_id", "left").withColumn("_next", F.when(F.col("_leaf").isNull(), F.col("_from")).otherwise((1 - leaf) * F.col("_from") + leaf * F.col("_leaf")))
        after = cut(said.join(score, "doc_id", "left").select("doc_id", F.col("_next").alias("score"), F.abs(F.col("_next") - F.coalesce("score", F.lit(0.0))).alias("_move")))
        move = after.agg(F.max("_move")).first()[0] or 0.0
        moves.append((len(moves) + 1, float(move)))
        score = after.select("doc_id", "score")
        if move <= tolerance:
            return docs.select("doc_id", "grade").join(score, "doc_id", "left").select("doc_id", "score", "grade"), moves


def cuts_of(graded: list[tuple[float, float]]) -> list[float]:
    """Cuts between neighbouring levels: of all places that tell the fewest grades wrong, the middle of the widest gap."""
    if not graded:
        return []
    rows = sorted(graded)
    s, g = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    out = []
    for low in LEVELS[:-1]:
        above = g > low + 0.5
        # wrong when cutting before row k: those above among the first k, those not above among the rest
        wrong = np.r_[0, np.cumsum(above)] + np.r_[np.cumsum((~above)[::-1])[::-1], 0]
        gap = np.diff(np.r_[s[0] - 1e-6, s, s[-1] + 1e-6])
        gap[0] = gap[-1] = 0.0
        best = np.flatnonzero(wrong == wrong.min())
        k = best[np.argmax(gap[best])]
        edge = np.r_[s[0] - 2e-6, s, s[-1] + 2e-6]
        out.append(float((edge[k] + edge[k + 1]) / 2))
    return [max(out[: k + 1]) for k in range(len(out))]


def levels(documents: DataFrame, labels: DataFrame, leaf: float = LEAF, tolerance: float = TOLERANCE) -> DataFrame:
    """``doc_id``, ``score``, ``grade`` and ``level`` (1 to 4, null without a score) of every English document with words."""
    scored = harmonic(documents, labels, leaf, tolerance)[0]
    cuts = cuts_of([tuple(r) for r in bounded_sample(scored.where("grade is not null and score is not null").select("score", "grade"), GRADED)])
    level: Column = F.lit(LEVELS[0] if cuts else None).cast("int")
    for at in cuts:
        level = level + (F.col("score") > at).cast("int")
    return scored.withColumn("level", F.when(F.col("score").isNotNull(), level))


def profile(leveled: DataFrame, documents: DataFrame, by: str = "source") -> DataFrame:
    """Documents, mean score and share of each level by a column of the documents."""
    rows = documents.select("doc_id", by).join(leveled, "doc_id").where("level is not null")
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), *(F.avg((F.col("level") == k).cast("int")).alias(f"share_{k}") for k in LEVELS))
