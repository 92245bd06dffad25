"""Near-duplicate texts by Jaccard similarity of their word runs, over a collection of any size.

1. Every text becomes lower-case words under which look-alikes, accents' spelling and invisible characters
   make no difference (:func:`variantloom.llm.textnorm.comparison_words`). Texts with the same words (by 128
   bits of hash) form a *class*; only classes are compared, so a text handed in a million times costs one
   comparison.
2. Each class gets a fast similarity sketch of ``T`` coordinates: in round i every word run is hashed to one
   bin and the smallest hash stays in each bin that earlier rounds left empty; after ``T`` such rounds, round
   T + j puts every run into bin j, so that all coordinates are filled. Two sketches agree in each coordinate
   with probability J, with concentration as if coordinates were independent.
3. Bands of ``ROWS`` coordinates are hashed and shuffled; classes that share a band are candidates. Pairs
   leave a bucket as two blocks of at most ``BLOCK`` members, and blocks are dealt out evenly before they are
   multiplied, so no task holds a hot bucket's pairs. Nothing is capped.
4. A candidate stays if the one-bit sketches of both agree in ``AGREE`` of 256 places, and is then verified
   exactly on the words themselves.

The number of coordinates of a band follows from the number of texts, that of the bands from the threshold
(:func:`plan_for`). Losses: a pair at the threshold shares no band with probability ``LOSS`` = 0.6 %, at 0.6
instead of 0.5 with 2e-5; the bit test loses 5e-5 at 0.5 and less above. Texts of fewer than ``min_words`` words, null
and empty texts have no partners.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variantloom.llm.textnorm import comparison_words
from variantloom.operators.order import numbered_within
from variantloom.session import cut, ship, small

BLOCK = 512
#: Chance that a pair at the threshold shares no band; similarity of unrelated texts and candidates of a text by chance that are put up with, which set a band's coordinates.
LOSS, UNRELATED, BY_CHANCE = 0.006, 0.02, 64
#: Rows of bands that a task sorts, where the session's number of partitions would give it more.
BANDS_A_TASK = 4_000_000
_MAX = np.uint64(2**64 - 1)
_K1, _K2, _K3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def plan_for(texts: int, threshold: float) -> tuple[int, int, int]:
    """Coordinates of a band, of a sketch, and agreeing bits of 256 that are asked for.

    Wider bands have fewer candidates by chance, whose number grows with the square of the collection, but
    need more bands for the same loss. Half of the bits that do not agree by similarity agree by chance; five
    standard deviations are left below that.
    """
    rows = bands = 0
    for rows in range(4, 11):
        bands = int(np.ceil(np.log(LOSS) / np.log(1 - threshold**rows)))
        if texts * bands * UNRELATED**rows <= BY_CHANCE:
            break
    t = rows * max(bands, -(-256 // rows))
    p = (1 + threshold) / 2
    return rows, t, int(256 * p - 3.9 * np.sqrt(256 * p * (1 - p)))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; works in place on a fresh array."""
    x ^= x >> np.uint64(30)
    x *= _K1
    x ^= x >> np.uint64(27)
    x *= _K2
    x ^= x >> np.uint64(31)
    return x


def runs_of(words: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and the text of each; ``words`` holds the word hashes of all texts."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    h = words[:n].copy()
    for j in range(1, k):
        h = mix(h) * _K3 + words[j : j + n]
    inside = doc[:n] == doc[k - 1 :]
    return mix(h[inside]), doc[:n][inside]


def sketches(values: np.ndarray, doc: np.ndarray, n: int, t: int) -> np.ndarray:
    """Fast similarity sketches, one row of t coordinates for each of n sets; a set without elements keeps the maximum."""
    out = np.full(n * t, _MAX, dtype=np.uint64)
    left = np.full(n, t)
    left[np.setdiff1d(np.arange(n), doc)] = 0
    for i in range(t):
        live = left[doc] > 0
        if not live.all():
            values, doc = values[live], doc[live]
        if not len(values):
            break
        h = mix(values + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64))
        at = doc * t + ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64)
        free = out[at] == _MAX
        at, h = at[free], mix(h[free])
        np.minimum.at(out, at, h)
        fresh = np.unique(at)
        left -= np.bincount(fresh // t, minlength=n)
    if len(values):
        holes = out.reshape(n, t) == _MAX
        for j in range(t):
            need = holes[:, j][doc]
            if need.any():
                h = mix(values[need] + np.uint64((t + j + 1) * 0x9E3779B97F4A7C15 % 2**64))
                np.minimum.at(out, doc[need] * t + j, mix(h))
    return out.reshape(n, t)


def bands_of(sketch: np.ndarray, rows: int) -> np.ndarray:
    """Hash of each band, 40 bits; the band's number is part of it."""
    n, t = sketch.shape
    s = sketch.reshape(n, t // rows, rows)
    h = np.broadcast_to(np.arange(1, t // rows + 1, dtype=np.uint64) * _K3, (n, t // rows)).copy()
    for j in range(rows):
        h = mix(h) + s[:, :, j]
    return (mix(h) >> np.uint64(24)).view(np.int64)


def bits_of(sketch: np.ndarray) -> np.ndarray:
    """One bit of each of the first 256 coordinates, as four integers."""
    bits = (sketch[:, :256] & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64)


def classes(df: DataFrame, key: str, text: str, k: int, min_words: int, rows: int, t: int) -> DataFrame:
    """``_id``, ``_cls``, ``_cls2`` (the second half of the class's hash), the four bit words and, for the first row of a class in its partition, ``_bands``."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        seen: set[int] = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                ids, words = [], []
                for i, text in zip(batch.column(0)[lo : lo + 1024].to_pylist(), batch.column(1)[lo : lo + 1024].to_pylist()):
                    if i is not None and text and len(w := comparison_words(text)) >= min_words:
                        ids.append(i)
                        words.append(w)
                if not ids:
                    continue
                digests = [xxhash.xxh3_128_intdigest(" ".join(w)) for w in words]
                cls, cls2 = (np.array([d >> shift & (1 << 64) - 1 for d in digests], dtype=np.uint64).view(np.int64) for shift in (0, 64))
                first: dict[int, int] = {}
                for p, d in enumerate(digests):
                    first.setdefault(d, p)
                new = [p for d, p in first.items() if d not in seen]
                if len(seen) > 2_000_000:
                    seen.clear()
                seen.update(first)
                if len(known) > 500_000:
                    known = {}
                for p in new:
                    for w in words[p]:
                        if w not in known:
                            known[w] = xxhash.xxh3_64_intdigest(w)
                flat = np.array([known[w] for p in new for w in words[p]], dtype=np.uint64)
                values, doc = runs_of(flat, np.array([len(words[p]) for p in new], dtype=np.int64), k)
                sketch = sketches(values, doc, len(new), t)
                bits = bits_of(sketch)
                bands: list = [None] * len(ids)
                quad: list = [None] * len(ids)
                for row, p in enumerate(new):
                    bands[p], quad[p] = row, row
                where = np.array([-1 if b is None else b for b in bands])
                has = where >= 0
                hashes = bands_of(sketch, rows)
                width = hashes.shape[1]
                offsets = np.r_[0, np.cumsum(np.where(has, width, 0))].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes[where[has]].ravel()))
                columns = [pa.array([0 if not h else int(bits[r, j]) for r, h in zip(where, has)], type=pa.int64(), mask=~has) for j in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, type=batch.schema.field(0).type), pa.array(cls), pa.array(cls2), *columns, lists], names=["_id", "_cls", "_cls2", "_b0", "_b1", "_b2", "_b3", "_bands"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).where(F.col(text).isNotNull()).mapInArrow(run, f"_id {kind}, _cls bigint, _cls2 bigint, _b0 bigint, _b1 bigint, _b2 bigint, _b3 bigint, _bands array<bigint>")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of a partition sorted by (hash, class) become pairs of blocks of their distinct members."""
    held: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.int64), np.empty(0, np.int64))

    def emit(lefts: list[np.ndarray], rights: list[np.ndarray]) -> pa.RecordBatch:
        lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in side])].astype(np.int32)), pa.array(np.concatenate(side))) for side in (lefts, rights)]
        return pa.RecordBatch.from_arrays(lists, names=["_left", "_right"])

    def full(h: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        fresh = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])] if len(h) else np.empty(0, bool)
        h, c = h[fresh], c[fresh]
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[starts, len(h)])
        lefts, rights = [], []
        for s, n in zip(starts[sizes > 1], sizes[sizes > 1]):
            parts = [c[s + lo : s + min(lo + BLOCK, n)] for lo in range(0, n, BLOCK)]
            for i, a in enumerate(parts):
                for b in parts[i:]:
                    lefts.append(a)
                    rights.append(b)
                    if len(lefts) >= 2000 or len(a) > 64 and len(lefts) >= 50:
                        yield emit(lefts, rights)
                        lefts, rights = [], []
        if lefts:
            yield emit(lefts, rights)

    for batch in batches:
        h, c = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate(held))
        if not len(h):
            continue
        last = np.searchsorted(h, h[-1], side="left")  # the last bucket may go on
        held = h[last:], c[last:]
        yield from full(h[:last], c[:last])
    yield from full(*held)


def candidate_pairs(sketched: DataFrame, bands_each: int, least_agree: int) -> DataFrame:
    """Distinct pairs ``_a`` < ``_b`` of classes that share a band and whose bits agree."""
    bands = sketched.where(F.col("_bands").isNotNull()).select(F.explode("_bands").alias("_h"), "_cls")
    least = int(sketched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, sketched.where(F.col("_bands").isNotNull()).count() * bands_each // BANDS_A_TASK)
    blocks = bands.repartition(parts, "_h").sortWithinPartitions("_h", "_cls").mapInArrow(_blocks, "_left array<bigint>, _right array<bigint>")
    pairs = (
        blocks.repartition(parts).select(F.explode("_left").alias("_a"), "_right").select("_a", F.explode("_right").alias("_b"))
        .where("_a < _b").distinct()
    )
    bits = sketched.where(F.col("_bands").isNotNull()).groupBy("_cls").agg(*(F.first(f"_b{i}").alias(f"_b{i}") for i in range(4)))
    side = lambda s: bits.select(F.col("_cls").alias(f"_{s}"), *(F.col(f"_b{i}").alias(f"_{s}{i}") for i in range(4)))
    agree = F.lit(256) - sum((F.bit_count(F.col(f"_a{i}").bitwiseXOR(F.col(f"_b{i}"))) for i in range(4)), F.lit(0))
    return pairs.join(side("a"), "_a").join(side("b"), "_b").where(agree >= least_agree).select("_a", "_b")


def exact_similarity(a: str, b: str, k: int) -> float:
    """Jaccard similarity of the sets of k-word runs."""
    x, y = ({*zip(*(w[j:] for j in range(k)))} for w in (comparison_words(a), comparison_words(b)))
    union = len(x | y)
    return len(x & y) / union if union else 0.0


def similar_classes(df: DataFrame, key: str, text: str, threshold: float = 0.8, k: int = 5, min_words: int = 5, plan: tuple[int, int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Links between classes, and the members of each class.

    Links: ``_a``, ``_b`` (classes, _a < _b), ``similarity``; members: ``_id``, ``_cls``, one row per distinct
    id. Rows whose id is null are left out, repeated rows count once. ``plan`` is by default that of
    :func:`plan_for`. The sketches are kept in memory or on disk until candidates and members are written, and
    computed anew where an executor is lost.
    """
    rows, t, agree = plan or plan_for(df.count(), threshold)
    made = classes(df, key, text, k, min_words, rows, t).persist(StorageLevel.MEMORY_AND_DISK)
    # texts of one class differ in the second half of their hashes once in some 2^64 pairs: these get classes of their own
    twice = small(made.groupBy("_cls").agg(F.min("_cls2").alias("_low"), F.max("_cls2").alias("_high")).where("_low != _high").select(F.col("_cls").alias("_torn")))
    sketched = made.join(twice, F.col("_cls") == F.col("_torn"), "left").withColumn("_cls", F.when(F.col("_torn").isNull(), F.col("_cls")).otherwise(F.xxhash64("_cls", "_cls2")))
    members = cut(sketched.select("_id", "_cls").distinct())
    pairs = cut(candidate_pairs(sketched, t // rows, agree))
    made.unpersist()
    wanted = pairs.select(F.col("_a").alias("_cls")).union(pairs.select("_b")).distinct()
    one = small(members.join(wanted, "_cls", "left_semi").groupBy("_cls").agg(F.min("_id").alias("_id")))
    texts = df.select(F.col(key).alias("_id"), F.col(text).alias("_text")).where("_text is not null").join(one, "_id").groupBy("_cls").agg(F.first("_text").alias("_text"))
    judged = F.pandas_udf(_judge(k), "double")
    links = (
        pairs.join(texts.withColumnsRenamed({"_cls": "_a", "_text": "_ta"}), "_a").join(texts.withColumnsRenamed({"_cls": "_b", "_text": "_tb"}), "_b")
        .withColumn("similarity", judged("_ta", "_tb")).where(F.col("similarity") >= threshold).select("_a", "_b", "similarity")
    )
    return links, members


def _dealt(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``members`` with ``_block``, and of each class the number of its last block; a block has ``BLOCK`` members at most."""
    several = members.groupBy("_cls").agg(F.count("*").alias("_many")).where("_many > 1")
    placed = numbered_within(members.join(several.select("_cls"), "_cls", "left_semi"), ["_cls"], ["_id"], "_place")
    copies = cut(placed.select("_id", "_cls", F.floor(F.col("_place") / BLOCK).cast("int").alias("_block")))
    alone = members.join(several.select("_cls"), "_cls", "left_anti").withColumn("_block", F.lit(0))
    return alone.unionByName(copies), copies.groupBy("_cls").agg(F.max("_block").alias("_last"))


def _judge(k: int):
    import pandas as pd

    return lambda a, b: pd.Series([exact_similarity(x, y, k) for x, y in zip(a, b)])


def similar_pairs(df: DataFrame, key: str = "candidate_id", text: str = "candidate_response", threshold: float = 0.5, k: int = 3, min_words: int = 30) -> DataFrame:
    """All pairs of different ids whose texts are similar: ``<key>_a`` < ``<key>_b`` and ``similarity``."""
    links, members = similar_classes(df, key, text, threshold, k, min_words)
    dealt, last = _dealt(members)
    # members of linked classes meet block by block, and so do copies, so that a class of any size is many keys
    side = lambda name: dealt.select(F.col("_id").alias(f"_i{name}"), F.col("_cls").alias(f"_{name}"), F.col("_block").alias(f"_block{name}"))
    across = links
    for name in ("a", "b"):
        known = last.select(F.col("_cls").alias(f"_{name}"), F.col("_last").alias(f"_last{name}"))
        across = across.join(known, f"_{name}", "left").withColumn(f"_block{name}", F.explode(F.sequence(F.lit(0), F.coalesce(f"_last{name}", F.lit(0)))))
    across = across.join(side("a"), ["_a", "_blocka"]).join(side("b"), ["_b", "_blockb"]).select("_ia", "_ib", "similarity")
    copies = dealt.join(last, "_cls")
    first = copies.select(F.col("_id").alias("_ia"), "_cls", F.col("_block").alias("_x"), F.explode(F.sequence("_block", "_last")).alias("_y"))
    second = copies.select(F.col("_id").alias("_ib"), "_cls", F.explode(F.sequence(F.lit(0), "_block")).alias("_x"), F.col("_block").alias("_y"))
    within = first.join(second, ["_cls", "_x", "_y"]).where("_ia < _ib").select("_ia", "_ib", F.lit(1.0).alias("similarity"))
    both = across.unionByName(within)
    return both.select(F.least("_ia", "_ib").alias(f"{key}_a"), F.greatest("_ia", "_ib").alias(f"{key}_b"), "similarity").where(F.col(f"{key}_a") != F.col(f"{key}_b")).distinct()


def components(links: DataFrame, a: str = "_a", b: str = "_b") -> DataFrame:
    """``node`` and ``root`` (the least node it is connected with) of every node of ``links``.

    Alternating large-star and small-star steps; each round's edges are written to the shared checkpoint
    folder. A node's neighbours meet only in a minimum, never in a list.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        after = cut(small)
        same = after.join(edges, ["u", "v"], "left_anti").isEmpty() and edges.join(after, ["u", "v"], "left_anti").isEmpty()
        edges = after
        if same:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def groups(df: DataFrame, key: str = "candidate_id", text: str = "candidate_response", threshold: float = 0.5, k: int = 3, min_words: int = 30) -> DataFrame:
    """One row per distinct id with a text of at least ``min_words`` words: ``key``, ``class_id`` (texts with the
    same words), ``group_id`` (classes connected by links), ``n_links`` (of its class to other classes)."""
    links, members = similar_classes(df, key, text, threshold, k, min_words)
    links = cut(links)
    ends = links.select(F.col("_a").alias("_cls")).unionAll(links.select("_b")).groupBy("_cls").agg(F.count("*").alias("n_links"))
    roots = components(links).withColumnsRenamed({"node": "_cls", "root": "group_id"})
    out = members.join(ends, "_cls", "left").join(roots, "_cls", "left")
    return out.select(F.col("_id").alias(key), F.col("_cls").alias("class_id"), F.coalesce("group_id", "_cls").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
