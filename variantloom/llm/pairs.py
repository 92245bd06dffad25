"""Defects of prompt and response pairs, by a conditional random field over the clauses of the response.

A response is split into clauses. A clause is described by learned features: hashed words and pairs of words;
how common its words are in the prompts of all jobs, and how well a character model of these words reads them
(the language of the corpus); how much of it, weighted by rarity, its prompt already says, in words and in
runs; what part of the answer it is; whether the answer breaks off in it. A linear-chain CRF, fitted here by
gradient ascent on the clauses of at most ``SAMPLE`` pairs, tags every clause as answer, refusal, echo,
foreign or unfinished; the share of words each tag covers decides the pair's defect:

``empty``           no clause says anything (:mod:`variantloom.llm.blank`)
``refusal``         refusing clauses cover half of the words or more
``copy``            echoing clauses do
``other_language``  foreign clauses do
``truncated``       the last clause is unfinished, and :mod:`variantloom.llm.truncation` finds the answer cut off

What the CRF is fitted on does not come from its features. Echoes are prompts given back, whole or in part;
unfinished answers are sampled ones cut at random; foreign ones are sampled ones whose letters were swapped,
vowels with vowels and others with others, so that only the make of the words differs. Refusals are answers
that open with one of a few set phrases; ``MASKED`` copies of each lose their words, so that a refusal in words
never seen is still told by what it is: short, well-formed and without a word of its prompt. Other clauses are
answers where they share rare words with their prompt, else unknown, and summed out.

The answer is the response, or the raw output where that is null or blank. A pair has one defect or none, in
the order above. Pairs without a prompt can have every defect but ``copy``; a null id is left out.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variantloom.llm.blank import is_empty
from variantloom.llm.neardup import mix, runs_of
from variantloom.llm.prefix import bounded_sample
from variantloom.llm.textnorm import INVISIBLE, base_form, comparison_words, plain_words
from variantloom.llm.truncation import SAMPLE as SENTENCES
from variantloom.llm.truncation import LEAST, baselines, decided, placed, read_model
from variantloom.session import cut, ship

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
#: Upper bounds of the sample of pairs the CRF is fitted on, of the refusing pairs added to it, and of the vocabulary (words by the number of prompts they occur in).
SAMPLE, REFUSING, VOCABULARY = 1500, 300, 50_000
#: Copies of a refusing pair in the fit, and those of them that lose their words.
RARE, MASKED = 4, 2
#: Share of all prompts in which a common word occurs.
COMMON = 0.001
#: Share of its words that a copy has in runs of its prompt, checked after the tags.
LEAST_SAID = 0.55
#: Words in the runs that show an echo, dimensions of hashed words, clauses of a stretch that is fitted on as one chain.
RUN, HASHED, STRETCH = 3, 1 << 13, 40

# Openings of refusals, that label answers for the fit and are no features.
SEEDS = re.compile(
    r"^\W*(?:(?:i am|i'm|im) (?:very |really )?sorry|sorry|my apologies|i (?:must )?apologi[sz]e|regrettably|unfortunately|i regret|as an? (?:\w+ )?(?:language )?(?:assistant|model|ai)\b"
    r"|(?:i am|i'm|im) (?:unable|not able|not comfortable)|i (?:cannot|can ?not|can't|cant|won't|wont|will not|must decline|decline|have to decline|have to pass)|no,? i (?:cannot|can't|won't))\b"
)
_CLAUSE = re.compile(r"[^.!?;\n…．]+(?:[.!?;\n…．]+|$)")
_ANY_WORD = re.compile(r"\w+")
_LETTERS = re.compile(r"[^\W\d_]")
_LATIN = re.compile("[A-Za-z" + chr(0xC0) + "-" + chr(0x24F) + "]")


def clauses_of(text: str) -> list[str]:
    """Clauses with their end marks; one of fewer than three words, such as a lead-in, goes with the next."""
    out, held = [], ""
    for c in _CLAUSE.findall(text):
        held += c
        if len(held) > 60 or len(_ANY_WORD.findall(held)) >= 3:
            out.append(held)
            held = ""
    if _ANY_WORD.search(held):
        out.append(held)
    return out


def word_hashes(words: list[str], known: dict[str, int]) -> list[int]:
    try:
        return [known[w] for w in words]
    except KeyError:
        if len(known) > 500_000:
            known.clear()
        for w in words:
            known.setdefault(w, xxhash.xxh3_64_intdigest(w))
        return [known[w] for w in words]


def among(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each of ``a`` is in ``b``, by sorting, which is several times faster here than ``numpy.isin``."""
    if not len(b):
        return np.zeros(len(a), dtype=bool)
    b = np.sort(b)
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a


class Language:
    """Words of the prompts with the number of prompts they occur in, and a character model of them."""

    def __init__(self, counts: dict[str, int], prompts: int):
        self.prompts = max(1, prompts)
        self.counts = counts
        rows = sorted((xxhash.xxh3_64_intdigest(w), n) for w, n in counts.items())
        self.keys = np.array([k for k, _ in rows], dtype=np.uint64)
        self.common = np.array([n >= COMMON * self.prompts for _, n in rows], dtype=bool)
        self.rarity = np.log((self.prompts + 1) / (np.array([n for _, n in rows], dtype=float) + 0.5)) if rows else np.empty(0)
        three = np.full((28, 28, 28), 0.05)
        for w, n in counts.items():
            codes = self.codes(w)
            for a, b, c in zip(codes, codes[1:], codes[2:]):
                three[a, b, c] += np.log1p(n)
        self.bits = np.log2(three / three.sum(axis=2, keepdims=True))
        self.read: dict[int, float] = {}

    @staticmethod
    def codes(word: str) -> list[int]:
        return [0, 0, *(ord(c) - 96 if "a" <= c <= "z" else 27 for c in word), 0]

    def fit_of(self, word: str) -> float:
        """Mean bits of a word's characters under the model, 0 at best."""
        codes = self.codes(word)
        return float(self.bits[codes[:-2], codes[1:-1], codes[2:]].mean())

    def of(self, hashes: np.ndarray, words: list[str]) -> tuple[np.ndarray, ...]:
        """Of each word: whether prompts have it, whether many do, its rarity among them, and the fit of its characters."""
        at = np.minimum(np.searchsorted(self.keys, hashes), max(0, len(self.keys) - 1))
        there = self.keys[at] == hashes if len(self.keys) else np.zeros(len(hashes), bool)
        most = float(np.log(2 * self.prompts + 2))
        rarity = np.where(there, self.rarity[at] if len(self.keys) else 0.0, most)
        if len(self.read) > 500_000:
            self.read.clear()
        every, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        fit = np.empty(len(every))
        for k, (h, j) in enumerate(zip(every.tolist(), first.tolist())):
            v = self.read.get(h)
            if v is None:
                v = self.read[h] = self.fit_of(words[j])
            fit[k] = v
        fit = fit[back]
        common = there & self.common[at] if len(self.keys) else there
        return there, common, rarity / most, fit


#: Dense features of a clause, in order.
DENSE = ("one", "echo", "whole echo", "known", "fit", "other letters", "shared", "shared in answer", "unshared known answer", "few clauses", "length", "first", "breaks off")


class Clauses:
    """Clauses of pairs: dense features ``x``, hashed words ``idx`` (flat, with ``at``, the clause of each), ``pair`` and ``size`` (words)."""

    def __init__(self, answers: list[str], prompts: list[str | None], cut_off: list[bool], language: Language, known: dict[str, int]):
        pair, flat, words_of, lengths, first, letters = [], [], [], [], [], []
        prompt_flat, prompt_lengths, told_before = [], [], {}
        ends: list[int] = []
        self.n = len(answers)
        for p, (answer, prompt) in enumerate(zip(answers, prompts)):
            told = told_before.get(prompt) if prompt else []
            if told is None:
                told = told_before[prompt] = word_hashes(comparison_words(prompt), known)
            prompt_flat += told
            prompt_lengths.append(len(told))
            low = answer.lower().replace(chr(0x2019), "'")
            plain, start = low.isascii(), len(lengths)
            for clause in clauses_of(low):
                words = plain_words(clause) if plain else comparison_words(clause)
                if not words:
                    continue
                count = 0 if plain else len(_LETTERS.findall(clause))
                letters.append(1.0 - len(_LATIN.findall(clause)) / count if count else 0.0)
                first.append(float(len(lengths) == start))
                flat += word_hashes(words, known)
                words_of += words
                lengths.append(len(words))
                pair.append(p)
            ends.append(len(lengths) - 1 if cut_off[p] and len(lengths) > start else -1)
        self.pair, self.size = np.array(pair, dtype=np.int64), np.array(lengths, dtype=np.int64)
        m = len(lengths)
        self.x, self.idx, self.at, self.scale = np.zeros((m, len(DENSE))), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if not m:
            return
        words, salt = np.array(flat, dtype=np.uint64), np.uint64(0x9E3779B97F4A7C15)
        clause = np.repeat(np.arange(m), self.size)
        of_pair = np.bincount(self.pair, self.size, minlength=self.n).astype(np.int64)
        prompt_words, prompt_size = np.array(prompt_flat, dtype=np.uint64), np.array(prompt_lengths, dtype=np.int64)
        # an echo: the runs of the clause that the prompt holds, of those that start in it and may go on into the next clause of its pair
        runs, run_at = runs_of(words, of_pair, RUN)
        starts = np.concatenate([np.arange(a, a + max(0, n - RUN + 1)) for a, n in zip(np.r_[0, np.cumsum(of_pair)[:-1]], of_pair)]) if len(runs) else np.empty(0, np.int64)
        told, told_at = runs_of(prompt_words, prompt_size, RUN)
        hit = among(mix(runs + run_at.astype(np.uint64) * salt), mix(told + told_at.astype(np.uint64) * salt))
        covered = np.zeros(len(words) + RUN)
        for j in range(RUN):
            covered[starts[hit] + j] = 1.0
        mean = lambda v: np.bincount(clause, v, minlength=m) / self.size
        there, common, rarity, fit = language.of(words, words_of)
        owner = self.pair[clause]
        said = among(mix(words + owner.astype(np.uint64) * salt), mix(prompt_words + np.repeat(np.arange(self.n), prompt_size).astype(np.uint64) * salt))
        weight = rarity * there + 1e-3  # words that no prompt has share nothing with one
        share = np.bincount(clause, weight * said, minlength=m) / np.bincount(clause, weight, minlength=m)
        whole = np.bincount(owner, weight * said, minlength=self.n) / np.maximum(1e-9, np.bincount(owner, weight, minlength=self.n))
        usual = np.bincount(owner, common.astype(float), minlength=self.n) / np.maximum(1, of_pair)
        blind = prompt_size == 0
        whole[blind], share[blind[self.pair]] = 0.5, 0.5
        x, many = self.x, np.bincount(self.pair, minlength=self.n)
        x[:, 0], x[:, 1], x[:, 3], x[:, 4], x[:, 5] = 1.0, mean(covered[: len(words)]), mean(common.astype(float)), (mean(fit) + 4) / 2, letters
        x[:, 2] = x[:, 1] >= 0.85
        x[:, 6], x[:, 7], x[:, 8] = share, whole[self.pair], ((1 - np.minimum(1, 2 * whole)) * usual)[self.pair]
        x[:, 9] = 1.0 / many[self.pair]
        x[:, 10] = np.where(blind, 1.0, np.minimum(1.0, of_pair / np.maximum(1, prompt_size)))[self.pair]
        x[:, 11] = first
        x[[k for k in ends if k >= 0], 12] = 1.0
        two = words[:-1] * salt + words[1:]
        inside = clause[:-1] == clause[1:]
        key = np.r_[mix(words.copy()), mix(two[inside])] % np.uint64(HASHED)
        both = np.sort(np.r_[clause, clause[:-1][inside]] * HASHED + key.astype(np.int64))
        both = both[np.r_[True, both[1:] != both[:-1]]]
        self.at, self.idx = both // HASHED, both % HASHED
        self.scale = 1 / np.sqrt(np.maximum(1, np.bincount(self.at, minlength=m)))[self.at]  # a long clause is not louder than a short one


    def only(self, pairs: np.ndarray) -> "Clauses":
        """The clauses of some of the pairs, which keep their numbers."""
        out, keep = object.__new__(Clauses), pairs[self.pair]
        place = np.cumsum(keep) - 1
        words = keep[self.at] if len(self.at) else np.empty(0, bool)
        out.n, out.pair, out.size, out.x = self.n, self.pair[keep], self.size[keep], self.x[keep].copy()
        out.at, out.idx, out.scale = (place[self.at[words]] if len(self.at) else self.at), self.idx[words], self.scale[words]
        return out


def swapped(text: str, seed: int) -> str:
    """The text with its letters exchanged, vowels for vowels and others for others, in all but some of its words, as languages share a few."""
    r = random.Random(seed)
    table = {}
    for group in ("aeiou", "bcdfghjklmnpqrstvwxyz"):
        other = list(group)
        while any(a == b for a, b in zip(group, other)):
            r.shuffle(other)
        table |= {ord(a): b for a, b in zip(group, other)} | {ord(a.upper()): b.upper() for a, b in zip(group, other)}
    kept = r.uniform(0, 0.4)
    return _ANY_WORD.sub(lambda m: m.group() if r.random() < kept else m.group().translate(table), text)


class Chain:
    """A linear-chain CRF with one weight for each tag and dense feature, each tag and hashed word, and each pair of tags."""

    def __init__(self, emission: np.ndarray, transition: np.ndarray, words: np.ndarray | None = None):
        self.emission, self.transition = emission, transition
        self.words = np.zeros((len(transition), 0)) if words is None else words

    def scores(self, c: "Clauses") -> np.ndarray:
        out = c.x @ self.emission.T
        if len(c.idx) and self.words.shape[1]:
            for k in range(len(out[0])):
                out[:, k] += np.bincount(c.at, self.words[k][c.idx] * c.scale, minlength=len(out))
        return out

    @staticmethod
    def padded(x: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row and column of each clause in a matrix of pairs, the longest first, and its shape's mask."""
        names, at = np.unique(pair, return_inverse=True)
        first = np.searchsorted(pair, names)
        column = np.arange(len(pair)) - first[at]
        place = np.empty(len(names), dtype=np.int64)
        place[np.argsort(-np.bincount(at), kind="stable")] = np.arange(len(names))
        row = place[at]
        mask = np.zeros((len(names), int(column.max()) + 1), dtype=bool)
        mask[row, column] = True
        return row, column, mask

    @classmethod
    def fit(cls, c: "Clauses", pair: np.ndarray, tags: np.ndarray, masked: np.ndarray, rounds: int = 80, rate: float = 0.5, decay: float = 1e-4, word_decay: float = 2e-3) -> "Chain":
        """Gradient ascent on the likelihood of the known tags; unknown ones (-1) are summed out. ``pair`` is the chain of each clause; ``masked`` clauses have no words."""
        k, x = len(TAGS), c.x
        row, column, mask = cls.padded(x, pair)
        n, width = mask.shape
        seen = ~masked[c.at]
        at, idx, scale = c.at[seen], c.idx[seen], c.scale[seen]
        w, t, h = np.zeros((k, x.shape[1])), np.zeros((k, k)), np.zeros((k, HASHED))
        gw, gt, gh = np.full_like(w, 1e-6), np.full_like(t, 1e-6), np.full_like(h, 1e-6)
        free = np.zeros((n, width, k))
        free[row, column] = np.where((tags[:, None] == np.arange(k)) | (tags[:, None] < 0), 0.0, -1e4)
        for _ in range(rounds):
            score = np.zeros((n, width, k))
            score[row, column] = x @ w.T + np.stack([np.bincount(at, h[j][idx] * scale, minlength=len(x)) for j in range(k)], axis=1)
            one, two = cls.marginals(score + free, t, mask)
            all_one, all_two = cls.marginals(score, t, mask)
            missing = (one - all_one)[row, column]
            dw = missing.T @ x / n - decay * w
            dt = (two - all_two) / n - decay * t
            dh = np.stack([np.bincount(idx, missing[at, j] * scale, minlength=HASHED) for j in range(k)]) / n - word_decay * h
            for v, d, g in ((w, dw, gw), (t, dt, gt), (h, dh, gh)):
                g += d**2
                v += rate * d / np.sqrt(g + 1e-5)
        return cls(w, t, h)

    @staticmethod
    def marginals(score: np.ndarray, t: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width, k = score.shape
        soft = lambda v, axis: (m := v.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis=axis))
        alive = mask.sum(axis=0)  # rows stand by length, so the first ones live on
        a, b, end = np.zeros_like(score), np.zeros_like(score), score[:, 0].copy()
        a[:, 0] = score[:, 0]
        for j in range(1, width):
            m = alive[j]
            a[:m, j] = soft(a[:m, j - 1, :, None] + t, 1) + score[:m, j]
            end[:m] = a[:m, j]
        total = soft(end, 1)
        for j in range(width - 2, -1, -1):
            m = alive[j + 1]
            b[:m, j] = soft(t + (score[:m, j + 1] + b[:m, j + 1])[:, None, :], 2)
        one = np.exp(np.minimum(a + b - total[:, None, None], 0)) * mask[:, :, None]
        two = np.zeros_like(t)
        for j in range(1, width):
            m = alive[j]
            two += np.exp(np.minimum(a[:m, j - 1, :, None] + t + (score[:m, j] + b[:m, j])[:, None, :] - total[:m, None, None], 0)).sum(axis=0)
        return one, two

    def tags(self, c: "Clauses") -> np.ndarray:
        """The likeliest tags (Viterbi) of the clauses of all pairs; pairs of like length go together, so that a long one pads few."""
        if not len(c.x):
            return np.empty(0, np.int64)
        scores, out = self.scores(c), np.zeros(len(c.x), dtype=np.int64)
        many = np.bincount(c.pair, minlength=c.n)
        rank = np.empty(c.n, dtype=np.int64)
        rank[np.argsort(many, kind="stable")] = np.arange(c.n)
        part = rank[c.pair] // 64
        for lo in np.unique(part):
            rows = np.flatnonzero(part == lo)
            out[rows] = self._viterbi(scores[rows], c.pair[rows])
        return out

    def _viterbi(self, scores: np.ndarray, pair: np.ndarray) -> np.ndarray:
        row, column, mask = self.padded(scores, pair)
        n, width = mask.shape
        score = np.zeros((n, width, scores.shape[1]))
        score[row, column] = scores
        best, back = score[:, 0].copy(), np.zeros(score.shape, dtype=np.int8)
        for j in range(1, width):
            step = best[:, :, None] + self.transition
            back[:, j] = step.argmax(axis=1)
            best = np.where(mask[:, j, None], step.max(axis=1) + score[:, j], best)
        out = np.zeros((n, width), dtype=np.int64)
        ends = mask.sum(axis=1) - 1
        here = best.argmax(axis=1)
        for j in range(width - 1, -1, -1):
            out[:, j] = here
            here = np.where((j <= ends) & (j > 0), back[np.arange(n), j, here], here)
        return out[row, column]


def defects(answers: list[str | None], prompts: list[str | None], cut_off: list[bool], chain: Chain, language: Language, known: dict[str, int], empty: list[bool] | None = None) -> list[tuple[str | None, str | None]]:
    """Of each pair its defect, or None, if the answer is whole, and if it is cut off; the second is that of the first where ``cut_off`` is false."""
    texts = ["" if e else base_form(a) for a, e in zip(answers, empty or map(is_empty, answers))]
    c = Clauses(texts, prompts, [False] * len(answers), language, known)
    n = len(answers)
    words = np.bincount(c.pair, c.size, minlength=n)
    said = np.bincount(c.pair, c.size * c.x[:, 1], minlength=n) / np.maximum(1, words)
    last = np.r_[c.pair[1:] != c.pair[:-1], True] if len(c.pair) else np.empty(0, bool)
    both = []
    for off in (False, True):
        if off:
            some = np.array(cut_off, dtype=bool)
            if not some.any():
                both.append(both[0])
                break
            part = c.only(some)
            part.x[last[some[c.pair]], 12] = 1.0
        else:
            part = c
        tag = chain.tags(part)
        share = np.stack([np.bincount(part.pair, part.size * (tag == k), minlength=n) for k in range(len(TAGS))]) / np.maximum(1, words) if n else np.zeros((len(TAGS), 0))
        end = np.full(n, -1)
        end[part.pair] = tag
        out: list[str | None] = []
        for p in range(n):
            if off and not some[p]:
                out.append(both[0][p])
            elif not words[p]:
                out.append("empty")
            elif share[1, p] >= 0.5:
                out.append("refusal")
            elif share[2, p] + share[4, p] >= 0.5 and said[p] >= LEAST_SAID:  # a copy may break off in its only clause
                out.append("copy")
            elif share[3, p] >= 0.5:
                out.append("other_language")
            else:
                out.append("truncated" if off and end[p] == 4 else None)
        both.append(out)
    return list(zip(*both))


def answers_of(candidates: DataFrame, tokens: Column) -> DataFrame:
    """``_k``, ``_t`` (the answer), ``_s`` (source) and ``_n`` (tokens) of every record with an id."""
    blank = F.col("candidate_response").isNull() | F.col("candidate_response").rlike(r"^[\s" + INVISIBLE + chr(0xA0) + r"]*$")
    answer = F.when(blank, F.col("raw_output")).otherwise(F.col("candidate_response"))
    return candidates.where("candidate_id is not null").select(F.col("candidate_id").alias("_k"), answer.alias("_t"), F.col("model").alias("_s"), tokens.cast("double").alias("_n"))


def language_of(prompts: DataFrame, words: int = VOCABULARY) -> Language:
    """The language of prompts ``_p``: their ``words`` most frequent words, counted over all of them a partition at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = Counter(), 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["_word", "_n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    total += 1
                    n.update(set(comparison_words(text)))
            if len(n) > 200_000:
                yield flush()
                n.clear()
        n[""] = total
        yield flush()

    counts = cut(prompts.select("_p").mapInArrow(count, "_word string, _n bigint").groupBy("_word").agg(F.sum("_n").alias("_n")))
    total = counts.where("_word = ''").agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    rows = counts.where("_n >= 3 and _word != ''").orderBy(F.desc("_n"), "_word").limit(words).collect()
    return Language({r[0]: r[1] for r in rows}, total)


def judged(candidates: DataFrame, jobs: DataFrame, tokens: Column, sample: int = SAMPLE, sentences: int = SENTENCES) -> DataFrame:
    """``candidate_id`` and ``defect`` (null for none) of every record.

    Each answer is read once, and tagged once as whole and, unless the automaton accepts its end, once as cut
    off; these narrow rows are written, and the sources' baselines over all of them choose.
    """
    spark = candidates.sparkSession
    ship(spark)
    rows = answers_of(candidates, tokens)
    prompts = jobs.where("job_id is not null").select(F.col("job_id").alias("_k"), F.col("generation_prompt").alias("_p"))
    ends, language = read_model(rows, sentences), language_of(prompts)
    low = F.regexp_replace(F.lower(F.ltrim("_t")), chr(0x2019), "'")
    few = bounded_sample(rows.where("_t is not null").select("_k", "_t"), sample) + bounded_sample(rows.where(low.rlike(SEEDS.pattern)).select("_k", "_t"), REFUSING)
    few = list(dict.fromkeys(few))
    asked = dict(jobs.where(F.col("job_id").isin([r[0] for r in few])).select("job_id", "generation_prompt").collect())
    chain = fitted([r[1] for r in few], [asked.get(r[0]) for r in few], language, lambda t: ends.of(t)[0] > 2)
    models = spark.sparkContext.broadcast((ends, chain, language))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end, crf, read = models.value
        known: dict[str, int] = {}
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.iloc[lo : lo + 512]
                a, p, *told = ([None if v is None or v != v else v for v in part[c].tolist()] for c in ("_t", "_p", "_n", "_usual", "_scatter", "_limit"))
                weight = [end.of(*x) for x in zip(a, *told)]
                found = defects(a, p, [e > LEAST for e, _ in weight], crf, read, known, [e == float("-inf") for e, _ in weight])
                frame = {"_k": part["_k"].tolist(), "_s": part["_s"].tolist(), "_e": [e for e, _ in weight], "_bare": [b for _, b in weight]}
                yield pd.DataFrame({**frame, "_whole": pd.Series([x for x, _ in found], dtype=object), "_cut": pd.Series([x for _, x in found], dtype=object)})

    kind = rows.schema["_k"].dataType.simpleString()
    whole = placed(rows).join(prompts, "_k", "left").select("_k", "_s", "_t", "_p", "_n", "_usual", "_scatter", "_limit")
    seen = cut(whole.mapInPandas(run, f"_k {kind}, _s string, _e double, _bare boolean, _whole string, _cut string"))
    out = seen.join(baselines(seen.select("_s", "_e", "_bare")), F.col("_s").eqNullSafe(F.col("_source")), "left")
    return out.select(F.col("_k").alias("candidate_id"), F.when(decided(), F.col("_cut")).otherwise(F.col("_whole")).alias("defect"))


def fitted(answers: list[str | None], prompts: list[str | None], language: Language, breaks_off, seed: int = 3) -> Chain:
    """The CRF of a sample of pairs, with made pairs of each tag; see the module's text. ``breaks_off`` says of a text whether its end looks cut."""
    r = random.Random(seed)
    kept = [(base_form(a), p) for a, p in zip(answers, prompts) if not is_empty(a)]
    refusing = [bool(SEEDS.search(a.lower().replace(chr(0x2019), "'"))) for a, _ in kept]
    sound = [k for k, f in enumerate(refusing) if not f]
    rows: list[tuple[str, str | None, int, bool, int]] = []  # text, prompt, tag (-1: by its clauses), whether only the last clause has it, masked
    for k, (a, p) in enumerate(kept):
        if refusing[k]:
            rows += [(a, p, 1, False, m >= RARE - MASKED) for m in range(RARE)]
        else:
            rows.append((a, p, -1, False, False))
    some = lambda n: r.sample(sound, min(n, len(sound)))
    for k in some(150):
        p = kept[k][1]
        if p:
            parts = [x for x in re.split(r"\n\s*\n|(?<=:)\n", p) if len(x.split()) > 6] or [p]
            rows += [(text, p, 2, False, m) for m, text in enumerate((p, r.choice(parts), parts[-1].lower(), re.sub(r"[^\w\s'-]", "", parts[-1]), parts[-1].replace(". ", r.choice(["! ", " ; ", ", ", " "]))))]
    for k in some(250):
        a, p = kept[k]
        rows.append((a[: int(len(a) * r.uniform(0.2, 0.95))].rstrip(), p, 4, True, False))
    for k in some(200):
        a, p = kept[k]
        rows.append((swapped(a, r.randrange(1 << 30)), p, 3, False, True))
    if not rows:
        return Chain(np.zeros((len(TAGS), len(DENSE))), np.zeros((len(TAGS), len(TAGS))), np.zeros((len(TAGS), HASHED)))
    c = Clauses([x[0] for x in rows], [x[1] for x in rows], [breaks_off(x[0]) for x in rows], language, {})
    whole = np.array([x[2] for x in rows])[c.pair]
    only_last, masked = np.array([x[3] for x in rows])[c.pair], np.array([bool(x[4]) for x in rows])[c.pair]
    last = np.r_[c.pair[1:] != c.pair[:-1], True]
    answer = (c.x[:, 6] >= 0.15) & (c.x[:, 1] < 0.6) & (c.x[:, 3] >= 0.6) & (c.x[:, 12] == 0)
    tags = np.where(whole >= 0, whole, np.where(answer, 0, -1))
    tags = np.where(only_last & ~last, np.where(answer, 0, -1), tags)
    tags = np.where(only_last & last & (c.x[:, 12] == 0), -1, tags)  # a cut that does not show
    within = np.arange(len(c.pair)) - np.searchsorted(c.pair, c.pair)
    _, stretch = np.unique(c.pair * 1_000_000 + within // STRETCH, return_inverse=True)
    return Chain.fit(c, stretch, tags, masked)
