"""Texts that were cut off, and how often each source cuts.

1. A stack automaton walks over every text to its end and keeps what it opened: quotes, brackets, markup tags,
   code fences and, in a text that begins as JSON, its objects, lists and strings with their escapes. At the
   end it says what stayed open, whether the text ends in a broken byte sequence, a half-written escape,
   entity or tag, a lone hyphen, or a mark such as ``[cut]``, and whether a terminator was seen. A broken end
   or a cut mark decides alone.
2. What an open structure of a kind, or a terminator, says is measured: texts of a sample are cut at random
   places, and the shares of cut and of whole texts that show it give a log-odds weight.
3. Where the terminator is missing the automaton cannot tell a bare end from a cut, so the last sentence is
   read by a model of where sentences end: whether sentences that run like this one end after these words. It
   is fitted on the same sample's sentences, whole and cut; its vocabulary comes from all texts.
4. Tokens spent: a source's usual tokens per character, and how they scatter, come from all of its terminated
   texts; an answer that cost more than its characters explain was longer before. Numbers of tokens at which a
   source's texts lack a terminator far more often than its others are limits of the source.
5. The baseline of a source decides: how often its texts lack a terminator and, by expectation-maximisation
   over the evidence of all of its bare texts, which share of these was cut. A text is cut off if its evidence
   exceeds the odds of its source.

Null, blank and placeholder texts (:mod:`variantloom.llm.blank`) are no cases.
"""

from __future__ import annotations

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
from variantloom.llm.prefix import bounded_sample
from variantloom.llm.textnorm import INVISIBLE, base_form, folded
from variantloom.session import cut, ship, small

#: Upper bounds of the sample and of the vocabulary the sentence model is fitted with (words by their number of occurrences in all texts).
SAMPLE, VOCABULARY = 6000, 100_000
DIMENSIONS = 1 << 18
#: Share of cut answers whose tokens are those of the whole answer, for the weight of tokens spent.
TELLING = 0.6
#: Evidence is counted in steps of a quarter between these bounds for the baselines.
LEAST, MOST, STEPS = -20.0, 20.0, 4
#: Bare texts of a source with the same number of tokens from which on the number may be a limit.
LIMIT_ROWS = 10

# What ends a text that was complete, and marks that follow an ending.
TERMINATORS = ".!?…。！？؟।．"
CLOSERS = "\"'”’»)]}*_`"
# Marks that programs leave where they cut.
CUT_MARK = re.compile(r"[\[(<{]\s*(?:\.\.\.|…|cut(?:\s*off)?|truncated|continued|continues|more|snip(?:ped)?|max(?:imum)?[ _](?:length|tokens)(?: reached)?|length limit)\s*[\])>}]\s*$", re.I)
BROKEN = re.compile(r"(?:�|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?|&(?:[a-zA-Z]{1,8}|#x?[0-9a-fA-F]{0,6})|%[0-9A-Fa-f]?|Ã|â€?)$")
HALF_TAG = re.compile(r"<[/a-zA-Z][^<>]*$")
#: Characters at the end that hold any of these marks.
MARK = 200
DANGLING = re.compile(r"\s[-–—]$|[(\[{<]$")
_WORD = re.compile(r"@?\w+(?:['’]\w+)*")
_SENTENCE = re.compile(r"[.!?…．]+[\"'”’»)\]]*(?=\s|$)|\n{2,}")
_EMOJI = re.compile("[" + chr(0x2190) + "-" + chr(0x2BFF) + chr(0x1F000) + "-" + chr(0x1FAFF) + chr(0xFE0F) + "]$")


_PAIRS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
_MARKS = re.compile(r"```|</?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*)?/?>|[()\[\]{}“”«»\"]")
_JSON = re.compile(r'\\.|["{}\[\]]', re.S)
# Tags that have no end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr p li td tr th".split())


def _close(stack: list[str], mark: str) -> None:
    if mark in stack:
        while stack.pop() != mark:
            pass


def _json_stack(text: str) -> list[str]:
    """Objects, lists and a string of JSON that stay open; escapes inside strings are passed over."""
    stack: list[str] = []
    for m in _JSON.finditer(text):
        c = m.group()
        if stack[-1:] == ["json string"]:
            if c == '"':
                stack.pop()
        elif c == '"':
            stack.append("json string")
        elif c in "{[":
            stack.append(c)
        elif c in "}]":
            _close(stack, _PAIRS[c])
    return stack


def _text_stack(text: str) -> list[str]:
    stack: list[str] = []
    for m in _MARKS.finditer(text):
        c = m.group()
        if c == "```":
            _close(stack, c) if c in stack else stack.append(c)
        elif "```" in stack:
            continue  # code is not read
        elif c[0] == "<":
            name = re.match(r"</?([A-Za-z0-9-]+)", c).group(1).lower()
            if c[1] == "/":
                _close(stack, f"<{name}>")
            elif name not in VOID and not c.endswith("/>"):
                stack.append(f"<{name}>")
        elif c in "([{“«":
            stack.append(c)
        elif c in _PAIRS:
            _close(stack, _PAIRS[c])
        elif '"' in stack:
            _close(stack, c)
        elif _opens_quote(text, m.start()):
            stack.append(c)
    return stack


def automaton(text: str) -> list[str]:
    """What stays open at the end of a text, in order of opening, and how it ends: ``cut mark``, ``broken``, ``dangling``, ``terminated`` or ``bare``."""
    begin = text.lstrip()[:1]
    stack = _json_stack(text) if begin == "{" or begin == "[" and text.lstrip()[1:2] in '"{[' and len(text.lstrip()) > 1 else _text_stack(text)
    end = text.rstrip()
    tail, tag = end[-MARK:], end.rfind("<")
    if CUT_MARK.search(tail):
        return [*stack, "cut mark"]
    if BROKEN.search(tail) or tag >= 0 and HALF_TAG.match(end, tag):
        return [*stack, "broken"]
    if DANGLING.search(tail[-2:]):
        return [*stack, "dangling"]
    bare = end.rstrip(CLOSERS).rstrip()
    if end and (_EMOJI.search(end) or (bare or end)[-1] in TERMINATORS):
        return [*stack, "terminated"]
    return [*stack, "bare"]


#: A terminator or an emoji, then white space, closers or invisible characters: for baselines in the JVM.
PLAIN_END = "[.!?" + chr(0xFF0E) + chr(0xFF01) + chr(0xFF1F) + r"\x{2026}\x{2190}-\x{2BFF}\x{1F000}-\x{1FAFF}][\s\"')\]" + chr(0x201D) + chr(0x2019) + INVISIBLE + r"]*$"
KINDS = ("(", "[", "{", "“", "«", '"', "```", "<>", "json string")


def _kind(mark: str) -> str:
    return "<>" if mark[0] == "<" else mark


def _opens_quote(text: str, at: int) -> bool:
    before, after = text[at - 1 : at], text[at + 1 : at + 2]
    return (not before or before.isspace() or before in "([{:,-—") and bool(after) and not after.isspace()


def sentences(text: str) -> tuple[list[list[str]], list[str], bool]:
    """Words of each terminated sentence; words of the unterminated rest; whether the rest ends in the middle of its last word's line."""
    out, at = [], 0
    for m in _SENTENCE.finditer(text):
        words = [w.lower() for w in _WORD.findall(text[at : m.start()])]
        if words:
            out.append(words)
        at = m.end()
    return out, [w.lower() for w in _WORD.findall(text[at:])], at < len(text)


class EndModel:
    """P(a sentence ends here) from its words so far: hashed features, logistic regression, fitted by Adagrad."""

    def __init__(self, texts: list[str], words: dict[str, int] | None = None, rounds: int = 4, seed: int = 7):
        """``words`` counts those of all texts, by default of the sample."""
        rng = np.random.default_rng(seed)
        split = [sentences(t)[0] for t in texts]
        count = Counter(words if words is not None else (w for s in split for x in s for w in x))
        self.vocabulary = {w for w, n in count.items() if n >= 3}
        self.prefixes = {w[:k] for w in self.vocabulary for k in range(1, len(w))}
        self.spelling: dict[str, str] = {}
        for w in sorted(self.vocabulary, key=lambda w: -count[w]):
            if len(w) > 3:
                self.spelling.setdefault(_letters(w), w)
        # words that hold a sentence together: frequent and spread over many sentences
        spread = Counter(w for s in split for x in s for w in set(x))
        self.frame = {w for w, _ in spread.most_common(150)}
        rows, y = [], []
        for s in split:
            for x in s:
                if len(x) < 3:
                    continue
                rows.append(self.features(x))
                y.append(1.0)
                for _ in range(2):
                    k = int(rng.integers(1, len(x)))
                    part = x[:k]
                    if rng.random() < 0.5 and len(x[k - 1]) > 2:  # in the middle of a word
                        part = [*x[: k - 1], x[k - 1][: int(rng.integers(1, len(x[k - 1])))]]
                        if part[-1] in self.vocabulary:
                            part = x[:k]
                    rows.append(self.features(part))
                    y.append(0.0)
        self.weights = np.zeros(DIMENSIONS)
        self._fit(rows, np.array(y), rounds, rng)

    def read(self, word: str) -> str:
        """The vocabulary word that a misspelt one with doubled or swapped letters stands for, else the word."""
        if word in self.vocabulary or len(word) < 4 or word in self.prefixes:
            return word
        other = self.spelling.get(_letters(word))
        return other if other and abs(len(other) - len(word)) <= 1 else word

    def features(self, words: list[str]) -> list[int]:
        w = ["", "", "", *words[:-3], *(self.read(x) for x in words[-3:])]
        a, b, c = w[-3], w[-2], w[-1]
        known = c in self.vocabulary
        last = c if known else ("~part" if c in self.prefixes else "~new")
        frame = sorted({x for x in words[:-1] if x in self.frame})
        out = [f"1{last}", f"2{b} {last}", f"3{a} {b} {last}", f"n{min(len(words), 30) // 2}", f"f{words[0] if words else ''}", f"g{' '.join(words[:2])}"]
        out += [f"in {x}" for x in frame]
        if words:
            out += [f"o{words[0]}|{last}", f"p{' '.join(words[:2])}|{b} {last}"]
        out += [f"x{x}|{last}" for x in frame]
        return [hash_of(f) % DIMENSIONS for f in out]

    def _fit(self, rows: list[list[int]], y: np.ndarray, rounds: int, rng) -> None:
        lengths = np.array([len(r) for r in rows])
        width = int(lengths.max()) if len(rows) else 0
        x = np.full((len(rows), width), DIMENSIONS, dtype=np.int64)
        for i, r in enumerate(rows):
            x[i, : len(r)] = r
        w, g = np.zeros(DIMENSIONS + 1), np.full(DIMENSIONS + 1, 1e-6)
        for _ in range(rounds):
            order = rng.permutation(len(rows))
            for lo in range(0, len(order), 512):
                k = order[lo : lo + 512]
                p = 1 / (1 + np.exp(-np.clip(w[x[k]].sum(axis=1) / 1.0, -30, 30)))
                d = np.repeat((p - y[k])[:, None], width, axis=1)
                grad = np.bincount(x[k].ravel(), d.ravel(), minlength=DIMENSIONS + 1) / 8
                grad[-1] = 0
                at = np.flatnonzero(grad)
                g[at] += grad[at] ** 2
                w[at] -= 0.3 * grad[at] / np.sqrt(g[at] + 1e-3) + 2e-5 * w[at]
        self.weights = w[:-1]

    def log_odds(self, words: list[str]) -> float:
        """Of the sentence being complete after these words."""
        return float(self.weights[self.features(words)].sum()) if words else 5.0


def _letters(word: str) -> str:
    return word[0] + "".join(sorted(set(word)))


def hash_of(text: str) -> int:
    return xxhash.xxh32_intdigest(text)


def plain(text: str) -> str:
    """The form of a text that is judged."""
    return folded(base_form(text))


class Evidence:
    """Log-odds of a text being cut off against being whole, before the odds of its source."""

    def __init__(self, texts: list[str], words: dict[str, int] | None = None, seed: int = 5):
        self.ends = EndModel(texts, words)
        rng = np.random.default_rng(seed)
        whole, cut, ended = Counter(), Counter(), 0
        for t in texts:
            whole.update({_kind(k) for k in automaton(t)[:-1]})
            part = automaton(t[: int(len(t) * rng.uniform(0.1, 0.97))])
            cut.update({_kind(k) for k in part[:-1]})
            ended += part[-1] == "terminated"
        n = len(texts) + 20  # 20 made-up texts, of which one cut one and next to no whole one shows a kind
        self.open = {k: float(np.log((cut[k] + 1) / n) - np.log((whole[k] + 0.02) / n)) for k in KINDS}
        self.ended = float(np.log((ended + 1) / n))
        self.shares = np.linspace(0.2, 0.97, 40)

    def of_tokens(self, tokens: float | None, length: int, usual: float | None, scatter: float | None) -> float:
        """What tokens say, given the usual log of tokens per character of the source and its scatter."""
        if not tokens or tokens <= 0 or usual is None or not length:
            return 0.0
        z = np.log(tokens / length) - usual
        s = max(scatter or 0.0, 0.02)
        # cut at a share f of its characters the answer has 1/f times the tokens per character
        far = np.exp(-np.minimum(700, ((z + np.log(self.shares)) / s) ** 2 / 2)).mean()
        near = np.exp(-min(700.0, (z / s) ** 2 / 2))
        return float(np.log(TELLING * far + (1 - TELLING) * near + 1e-12) - np.log(near + 1e-12))

    def of(self, text: str | None, tokens: float | None = None, usual: float | None = None, scatter: float | None = None, limit: float | None = None) -> tuple[float, bool]:
        """The evidence, ``limit`` being that of the number of tokens as a limit, and whether the text ends without a terminator; -inf for what is no case."""
        if text is None or is_empty(text):
            return float("-inf"), False
        text = plain(text)
        state = automaton(text)
        if state[-1] in ("cut mark", "broken", "dangling"):
            return MOST, True
        if len(state) == 1 and state[-1] == "terminated":
            return LEAST, False  # the automaton accepts it
        score = sum(self.open[k] for k in {_kind(k) for k in state[:-1]})
        if state[-1] == "terminated":
            return score + self.ended + min(0.0, self.of_tokens(tokens, len(text), usual, scatter)), False
        rest = sentences(text)[1]
        if not rest:
            return score + self.ended, False
        # two cuts were fitted on for each whole sentence
        return score - self.ends.log_odds(rest) - float(np.log(2)) + max(limit or LEAST, self.of_tokens(tokens, len(text), usual, scatter)), True


def _ended() -> Column:
    """Whether a text ends in a terminator, for baselines; its last characters tell."""
    return F.coalesce(F.right(F.rtrim("_t"), F.lit(MARK)).rlike(PLAIN_END), F.lit(True))


def read_model(rows: DataFrame, size: int = SAMPLE, words: int = VOCABULARY) -> Evidence:
    """The model of rows with a text ``_t``: fitted on ``size`` distinct terminated texts, its vocabulary the ``words`` most frequent ones of all texts."""
    sample = bounded_sample(rows.where(F.col("_t").rlike(r"[.!?]\s*$")).select("_t"), size)
    counts = rows.select("_t").mapInArrow(_words, "_word string, _n bigint").groupBy("_word").agg(F.sum("_n").alias("_n")).where("_n >= 3")
    known = dict(tuple(r) for r in counts.orderBy(F.desc("_n"), "_word").limit(words).collect())
    return Evidence([plain(r[0]) for r in sample], known or None)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a partition as the sentence model reads them, with their counts, handed on whenever there are many."""
    count: Counter[str] = Counter()
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["_word", "_n"])
    for batch in batches:
        for t in batch.column(0).to_pylist():
            if t:
                count.update(_WORD.findall((t if t.isascii() else plain(t)).lower()))
        if len(count) > 200_000:
            yield flush()
            count = Counter()
    yield flush()


def source_tokens(rows: DataFrame) -> DataFrame:
    """Of each source of rows ``_s``, ``_t`` (text), ``_n`` (tokens): ``_usual`` (log of tokens per character of its terminated texts, the median) and ``_scatter`` (half of the middle two thirds)."""
    per = F.log(F.col("_n") / F.length("_t"))
    at = F.percentile_approx(F.when(_ended() & (F.length("_t") >= 100) & (F.col("_n") > 0), per), F.array(F.lit(1 / 6), F.lit(0.5), F.lit(5 / 6)), F.lit(1000))
    return rows.groupBy(F.col("_s").alias("_source")).agg(at.alias("_q")).select("_source", F.col("_q")[1].alias("_usual"), ((F.col("_q")[2] - F.col("_q")[0]) / 2).alias("_scatter"))


def source_limits(rows: DataFrame) -> DataFrame:
    """Numbers of tokens (``_tokens`` of ``_source``) whose texts are bare more often than the source's: the log ratio of odds, ``_limit``."""
    counts = rows.where("_n > 0").groupBy(F.col("_s").alias("_source"), F.col("_n").alias("_tokens")).agg(F.count_if(~_ended()).alias("_bare"), F.count_if(_ended()).alias("_whole"))
    every = counts.groupBy("_source").agg(F.sum("_bare").alias("_b"), F.sum("_whole").alias("_w")).withColumnRenamed("_source", "_every")
    odds = F.log((F.col("_bare") + 1) / (F.col("_whole") + 1)) - F.log((F.col("_b") + 1) / (F.col("_w") + 1))
    found = counts.where(F.col("_bare") >= LIMIT_ROWS).join(every, F.col("_source").eqNullSafe(F.col("_every"))).withColumn("_limit", odds)
    return found.where("_limit > 0").select("_source", "_tokens", "_limit")


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` with what their sources' tokens say: ``_usual``, ``_scatter`` and ``_limit``."""
    usual, limits = small(source_tokens(rows)), small(source_limits(rows)).withColumnRenamed("_source", "_bound")
    both = rows.join(usual, F.col("_s").eqNullSafe(F.col("_source")), "left")
    return both.join(limits, F.col("_s").eqNullSafe(F.col("_bound")) & (F.col("_n") == F.col("_tokens")), "left").drop("_source", "_bound", "_tokens")


def weighed(rows: DataFrame, model: Evidence) -> DataFrame:
    """``_k``, ``_s``, ``_e`` (evidence) and ``_bare`` of every row of ``_k``, ``_s``, ``_t``, ``_n``; the model is a broadcast whose size its sample bounds."""
    told = rows.sparkSession.sparkContext.broadcast(model)

    def weigh(t: pd.Series, n: pd.Series, usual: pd.Series, scatter: pd.Series, limit: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([told.value.of(*x) for x in zip(t, *(v.astype(object).where(v.notna(), None) for v in (n, usual, scatter, limit)))], columns=["e", "bare"])

    both = placed(rows).withColumn("_w", F.pandas_udf(weigh, "e double, bare boolean")("_t", "_n", "_usual", "_scatter", "_limit"))
    return both.select("_k", "_s", F.col("_w.e").alias("_e"), F.col("_w.bare").alias("_bare"))


def baselines(evidence: DataFrame) -> DataFrame:
    """Of each source: ``_odds`` of a bare text having been cut, and ``_ended_odds`` of a terminated one, as logs.

    Evidence is counted in steps over all rows, at most 161 counts a source; the share of cut texts among a
    source's bare ones is where expectation-maximisation from one half ends.
    """
    step = F.round(F.greatest(F.lit(LEAST), F.least(F.lit(MOST), "_e")) * STEPS).cast("int")
    counts = evidence.where(F.col("_e") > float("-inf")).groupBy("_s", "_bare", step.alias("_step")).agg(F.count("*").alias("_n"))

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        bare = group[group["_bare"]]
        e, n, share = bare["_step"].to_numpy() / STEPS, bare["_n"].to_numpy().astype(float), 0.5
        for _ in range(500):
            odds = np.log(share / (1 - share))
            after = (float((n / (1 + np.exp(-np.clip(e + odds, -500, 500)))).sum()) + 0.5) / (n.sum() + 1)
            after = min(1 - 1e-9, max(1e-9, after))
            done, share = abs(after - share) < 1e-9, after
            if done:
                break
        every = share * n.sum() / max(1.0, group["_n"].sum())
        every = min(1 - 1e-9, max(1e-9, every))
        return pd.DataFrame({"_source": [group["_s"].iloc[0]], "_odds": [np.log(share / (1 - share))], "_ended_odds": [np.log(every / (1 - every))]})

    kind = evidence.schema["_s"].dataType.simpleString()
    return small(counts.groupBy("_s").applyInPandas(settle, f"_source {kind}, _odds double, _ended_odds double"))


def decided() -> Column:
    return F.coalesce(F.col("_e") + F.when(F.col("_bare"), F.col("_odds")).otherwise(F.col("_ended_odds")) > 0, F.lit(False))


def judged(df: DataFrame, key: str = "candidate_id", text: str = "candidate_response", source: str = "model", tokens: Column | None = None, size: int = SAMPLE) -> DataFrame:
    """``key``, ``source`` and ``cut`` (boolean) of every row.

    Every text is walked over once; its evidence, a narrow row, is written, and the sources' baselines over
    all of it decide. A text that ends in a terminator with nothing open is whole. Rows whose text is null, blank or a placeholder are no cases.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(key).alias("_k"), F.col(source).alias("_s"), F.col(text).alias("_t"), (F.lit(None).cast("double") if tokens is None else tokens.cast("double")).alias("_n"))
    evidence = cut(weighed(rows, read_model(rows, size)))
    out = evidence.join(baselines(evidence), F.col("_s").eqNullSafe(F.col("_source")), "left").withColumn("cut", decided())
    return out.select(F.col("_k").alias(key), F.col("_s").alias(source), "cut")


def report(df: DataFrame, key: str = "candidate_id", text: str = "candidate_response", source: str = "model", tokens: Column | None = None) -> DataFrame:
    """Of each source: distinct ids ``n``, those cut off ``n_cut``, and ``share``."""
    once = judged(df, key, text, source, tokens).groupBy(source, key).agg(F.max("cut").alias("cut"))
    return once.groupBy(source).agg(F.count("*").alias("n"), F.count_if("cut").alias("n_cut")).withColumn("share", F.col("n_cut") / F.col("n"))
