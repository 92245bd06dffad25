"""Encoding of a corpus with a public byte-level BPE vocabulary, in numpy.

Texts are split by the published pattern; every distinct piece of a batch is encoded once. Pieces are put
in buckets by their length in bytes and padded to one integer matrix a bucket. In each round every row
merges its leftmost pair of minimum rank and, from there to the right and without overlap, the same pair's
other places, which would be next: a merge never creates a pair of lower rank than its own. The ranks of all
neighbouring pairs come from one lookup in an open-addressing hash table over (left id, right id). Rows are
compacted after each round, and those without a pair left leave the matrix. Pieces of every length go the
same way, so one of a million bytes takes as many rounds as it has different merges.

Null and empty texts have the empty list; strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from variantloom.session import ship

#: The pattern that splits text before the merges (a fixed value, published with the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Upper bounds of the length buckets in bytes, doubled beyond the last; cells of one matrix.
BUCKETS, CELLS = (2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 64), 1 << 21
#: Pieces kept in a worker's cache; it starts anew beyond this.
CACHE = 200_000
_NONE = np.int32(2**31 - 1)


class BytePairs:
    """A vocabulary of ranks, with its hashed pair table."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {v: k for k, v in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        keys, ids = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    ids.append(rank)
        self._build(np.array(keys, dtype=np.uint64), np.array(ids, dtype=np.int32))
        self.cache: dict[str, np.ndarray] = {}
        import regex

        self.split = regex.compile(PATTERN).findall

    def _build(self, keys: np.ndarray, ids: np.ndarray) -> None:
        self.shift = np.uint64(64 - max(4, int(len(keys) * 4).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.mask = np.int64(size - 1)
        self.keys = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.ids = np.full(size, _NONE, dtype=np.int32)
        slot, todo, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):  # each round settles the first key of every free slot
            self.probes += 1
            free = self.keys[slot[todo]] == np.iinfo(np.uint64).max
            _, first = np.unique(slot[todo][free], return_index=True)
            won = todo[free][first]
            self.keys[slot[won]], self.ids[slot[won]] = keys[won], ids[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or ``_NONE``; padding is negative."""
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64)).astype(np.uint64).ravel()
        out = np.full(keys.shape, _NONE, dtype=np.int32)
        todo = np.flatnonzero((right.ravel() >= 0) & (left.ravel() >= 0))
        slot = self._slot(keys[todo])
        for _ in range(self.probes + 1):
            held = self.keys[slot]
            hit = held == keys[todo]
            out[todo[hit]] = self.ids[slot[hit]]
            more = ~hit & (held != np.iinfo(np.uint64).max)
            if not more.any():
                break
            todo, slot = todo[more], (slot[more] + 1) & self.mask
        return out.reshape(left.shape)

    def _bucket(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces, padded to one matrix."""
        lengths = np.array([len(p) for p in pieces])
        width = int(lengths.max())
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(len(pieces), width)
        m = np.where(np.arange(width) < lengths[:, None], self.byte[raw], np.int32(-1))
        out: list[np.ndarray] = [None] * len(pieces)
        rows = np.arange(len(pieces))
        while len(rows):
            columns = np.arange(m.shape[1] - 1)
            ranks = self.pair_ranks(m[:, :-1], m[:, 1:])
            best = ranks.min(axis=1) if m.shape[1] > 1 else np.full(len(rows), _NONE)
            for k in np.flatnonzero(best == _NONE):
                out[rows[k]] = m[k][m[k] >= 0]
            keep = best != _NONE
            rows, m, ranks, best = rows[keep], m[keep], ranks[keep], best[keep]
            if not len(rows):
                break
            # of a run of touching places, every second one from its start
            here = ranks == best[:, None]
            before = np.maximum.accumulate(np.where(here, -1, columns), axis=1)
            here &= (columns - before) % 2 == 1
            m[:, :-1] = np.where(here, best[:, None], m[:, :-1])
            left = m >= 0
            left[:, 1:] &= ~here
            size = left.sum(axis=1)
            packed = np.full((len(rows), int(size.max())), -1, dtype=np.int32)
            packed[np.arange(packed.shape[1]) < size[:, None]] = m[left]
            m = packed
        return out

    def encode_pieces(self, pieces: list[str]) -> None:
        """Put the ids of new pieces into the cache."""
        todo = list({p for p in pieces if p not in self.cache})
        if len(self.cache) + len(todo) > CACHE:
            self.cache = {}
            todo = list(set(pieces))
        raw = sorted((p.encode("utf-8"), p) for p in todo)
        by: dict[int, list[tuple[bytes, str]]] = {}
        for b, p in raw:
            by.setdefault(next((k for k in BUCKETS if len(b) <= k), 1 << (len(b) - 1).bit_length()), []).append((b, p))
        for width, group in by.items():
            many = max(1, CELLS // width)
            for lo in range(0, len(group), many):
                part = group[lo : lo + many]
                for (_, p), ids in zip(part, self._bucket([b for b, _ in part])):
                    self.cache[p] = ids

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text. Pieces are handled for some texts at a time, so that memory stays bounded."""
        out, none = [], np.empty(0, dtype=np.int32)
        for lo in range(0, len(texts), 64):
            split = [self.split(t) if t else [] for t in texts[lo : lo + 64]]
            self.encode_pieces([p for s in split for p in s])
            cache = self.cache
            out += [np.concatenate([cache[p] for p in s]) if s else none for s in split]
        return out

    def decode(self, ids) -> bytes:
        return b"".join(self.tokens[int(i)] for i in ids)


@lru_cache(maxsize=4)
def byte_pairs(path: str = VOCABULARY) -> BytePairs:
    """The vocabulary of a file, once a process."""
    return BytePairs(path)


def path_of(spark: SparkSession, path: str | None) -> str:
    """The vocabulary's path, whose file is sent with the job, once a session, for workers that do not have it there."""
    where, context = path or os.environ.get("VARIANTLOOM_VOCABULARY", VOCABULARY), spark.sparkContext
    sent = context.__dict__.setdefault("_variantloom_files", set())
    if where not in sent:
        context.addFile(where)
        sent.add(where)
    return where


def at_worker(where: str) -> str:
    return where if os.path.exists(where) else SparkFiles.get(os.path.basename(where))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key`` and ``ids`` (list of int) of every row; the rows keep their partitions, nothing is shuffled."""
    ship(df.sparkSession)
    where = path_of(df.sparkSession, path)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_pairs(at_worker(where))
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids = bpe.encode_batch(part.column(1).to_pylist())
                offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
                flat = np.concatenate(ids) if ids else np.empty(0, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.int32()))], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, key: str, text: str = "text", path: str | None = None, carry: list[str] = ()) -> DataFrame:
    """``key``, the columns of ``carry`` and ``n_tokens`` (0 for null and empty texts) of every row."""
    ship(df.sparkSession)
    where = path_of(df.sparkSession, path)
    fields = [key, *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_pairs(at_worker(where))
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                n = pa.array([len(x) for x in bpe.encode_batch(part.column(len(fields)).to_pylist())], type=pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(fields)], n], names=[*fields, "n_tokens"])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in fields)
    return df.select(*fields, text).mapInArrow(run, schema + ", n_tokens bigint")
