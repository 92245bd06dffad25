"""The subpackage's operators against brute force, round trips and odd input."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from variantloom.llm import blank, mixing, neardup, pairs, prefix, reading, sampling, textnorm, tokens, truncation

SUBJECTS = ["the coach", "the nurse", "my cousin", "the writer", "our class", "the baker", "a new student", "the crew"]
VERBS = ["found", "moved", "washed", "carried", "dropped", "painted", "hid", "saved"]
THINGS = ["an old lamp", "the round kettle", "a blue bicycle", "their quilt", "one narrow boat", "the quiet violin", "a dusty map", "this drum"]
PLACES = ["by the river", "in the attic", "at the market", "under the bridge", "behind the school", "on the hill"]
FACTS = ["the rules were not fair", "it was too dark to grow", "time is short for kids", "the money was almost gone"]


def sentence(r):
    s, v, t, p, f = (r.choice(x) for x in (SUBJECTS, VERBS, THINGS, PLACES, FACTS))
    return r.choice([f"Because {f}, {s} {v} {t} {p}", f"The reason is {f} but {s} still {v} {t} {p}", f"If {s} had not {v} {t} then nothing would change", f"What {s} {v} was {t}, and this took place {p}"])


def essay(r, n=8):
    return ". ".join(sentence(r) for _ in range(n)) + "."


def spoilt(spark, rows, schema, extra="cls string, _k string, _t string, count int"):
    """Rows with extra columns of names that operators use themselves."""
    df = spark.createDataFrame(rows, schema)
    for part in extra.split(", "):
        name, kind = part.split()
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


# p5 --------------------------------------------------------------------------------------------------------
def test_base_form():
    fix = textnorm.base_form
    assert fix("a" + chr(0xA0) + "b" + chr(0x200B) + "c" + chr(0xFB01) + "e" + chr(0x301) + chr(0x2011) + "x" + chr(0xAD)) == "a bcfi" + chr(0xE9) + "-x"
    kept = "naïve café “quoted” – dash — \t\r\n 🙂 Всё хорошо. Η δασκάλα"
    assert fix(kept) == kept
    family = chr(0x1F468) + chr(0x200D) + chr(0x1F469)
    assert fix(family) == family and fix("a" + chr(0x200D) + "b") == "ab"
    assert fix(chr(0xFF21) + chr(0xFF0C)) == "A,"
    for c in range(0x20, 0x3000):
        once = fix("x" + chr(c) + "y")
        assert fix(once) == once


def test_dominant_script():
    fix = textnorm.repaired
    assert fix("The Russian word рот means mouth", {"pot"}) == "The Russian word рот means mouth"
    assert fix("He wrote «сор» there, not cop.", {"cop"}) == "He wrote «сор» there, not cop."
    assert fix("всем привeт", {"привет"}) == "всем привет" and fix("Xорошо мне", {"хорошо"}) == "Хорошо мне"
    assert fix("thе ореn door", {"the", "open"}) == "the open door" and fix("an angle α is", {"a"}) == "an angle α is"
    assert fix("poco a росо se", {"poco"}) == "poco a poco se" and fix("привeт", {"other"}) == "привeт"


def test_consistent_form(spark):
    rows = [("1", "thе cat sat"), ("2", "the cat sat"), ("3", "Всё хорошо"), ("4", None), ("5", ""), ("6", "xуz the Я"), ("1", "thе cat sat"), ("7", "the" + chr(0x200B)), (None, "а cat the"), ("8", "a" * 50000 + chr(0xA0)), ("9", "a cat")]
    got = textnorm.consistent_form(spoilt(spark, rows, "candidate_id string, candidate_response string")).collect()
    assert len(got) == len(rows)
    by = {r.candidate_id: (r.consistent, r.changed) for r in got}
    assert by["1"] == ("the cat sat", True) and by["3"] == ("Всё хорошо", False) and by["4"] == (None, False) and by["5"] == ("", False)
    assert by["6"] == ("xуz the Я", False)  # no word of the corpus reads so
    assert by["7"] == ("the", True) and by[None] == ("a cat the", True) and by["8"][1]
    assert textnorm.consistent_form(spoilt(spark, [], "candidate_id string, candidate_response string")).count() == 0


# p6 --------------------------------------------------------------------------------------------------------
ODD = ["", None, "Hello world", "<|endoftext|> is text", "naïve café", "日本語テキスト", "🙂🙂 ok", " " * 300 + "x", "a" * 2000, "ab" * 1500, "x\n\n\n  y\t", "don't we'll I've", "12345 678", "\u0000\x7f", "é" * 700]


def test_tokens():
    tiktoken = pytest.importorskip("tiktoken")
    bpe = tokens.byte_pairs()
    ranks = {v: k for k, v in bpe.tokens.items()}
    other = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(5)
    noise = ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(32, 0x500), r.randrange(0x4E00, 0x4F00), 0x1F600 + r.randrange(40)])) for _ in range(r.randrange(1, 120))) for _ in range(300)]
    for text, ids in zip(ODD + noise, bpe.encode_batch(ODD + noise)):
        assert list(ids) == (other.encode_ordinary(text) if text else [])
        assert bpe.decode(ids).decode() == (text or "")


def test_encode(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, ODD[3])]
    got = tokens.encode(spoilt(spark, rows, "doc_id bigint, text string", "ids string, n_tokens int")).collect()
    assert len(got) == len(rows) and [r.ids for r in got if r.doc_id in (0, 1)] == [[], []]
    counts = tokens.token_counts(spoilt(spark, rows, "doc_id bigint, text string"), "doc_id").collect()
    assert {r.doc_id: r.n_tokens for r in counts} == {r.doc_id: len(r.ids) for r in got}
    assert tokens.encode(spoilt(spark, [], "doc_id bigint, text string")).count() == 0


# p2 --------------------------------------------------------------------------------------------------------
def test_sketch_estimates():
    r = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.9):
        both = r.integers(0, 2**63, 200, dtype=np.uint64)
        only = int(200 * (1 - share) / share / 2)
        a, b = (np.r_[both, r.integers(0, 2**63, only, dtype=np.uint64)] for _ in range(2))
        s = neardup.sketches(np.r_[a, b], np.r_[np.zeros(len(a), int), np.ones(len(b), int)], 2, 2048)
        true = 200 / (200 + 2 * only)
        assert abs((s[0] == s[1]).mean() - true) < 0.05
    for texts in (1000, 10**7, 10**9):  # wider bands keep the loss at the threshold
        for threshold in (0.5, 0.8):
            rows, t, agree = neardup.plan_for(texts, threshold)
            assert (1 - threshold**rows) ** (t // rows) <= neardup.LOSS + 1e-9 and t >= 256 and agree < 128 * (1 + threshold)
    few = neardup.sketches(np.array([7, 7, 9], dtype=np.uint64), np.zeros(3, int), 2, 64)
    assert (few[0] != neardup._MAX).all() and (few[1] == neardup._MAX).all()


def edited(r, text):
    words = text.split()
    for _ in range(r.randrange(0, 12)):
        k = r.randrange(len(words))
        words[k : k + 1] = r.choice([[], ["other"], [words[k], "more"]])
    return " ".join(words)


def test_similar_pairs(spark):
    r = random.Random(7)
    texts = [essay(r, 5) for _ in range(25)]
    rows = [(f"c{k:03}", edited(r, r.choice(texts))) for k in range(150)]
    rows += [("c000", rows[0][1]), ("d1", rows[0][1].upper()), ("d2", rows[1][1].replace("e", "е", 3)), ("n", None), ("e", ""), ("s", "too short"), (None, rows[0][1]), ("long", essay(r, 3000)), ("rep", "one two three " * 400)]
    want = set()
    runs = {}
    for i, t in rows:
        w = textnorm.comparison_words(t or "")
        if i and len(w) >= 30:
            runs[i] = set(zip(w, w[1:], w[2:]))
    for a, b in combinations(sorted(runs), 2):
        if len(runs[a] & runs[b]) >= 0.5 * len(runs[a] | runs[b]):
            want.add((a, b))
    df = spoilt(spark, rows, "candidate_id string, candidate_response string", "_cls string, _id int, similarity int")
    found = neardup.similar_pairs(df).collect()
    got = {(x.candidate_id_a, x.candidate_id_b) for x in found}
    assert len(found) == len(got) and got <= want and len(got) >= 0.99 * len(want) and len(want) > 100
    # so does every width of bands
    other = (5, 810, 164)
    links, members = neardup.similar_classes(df, "candidate_id", "candidate_response", 0.5, 3, 30, other)
    assert links.count() >= 0.99 * neardup.similar_classes(df, "candidate_id", "candidate_response", 0.5, 3, 30)[0].count() > 50
    # hot buckets are cut into blocks without losing a pair
    old, neardup.BLOCK = neardup.BLOCK, 3
    try:
        assert {(x.candidate_id_a, x.candidate_id_b) for x in neardup.similar_pairs(df).collect()} == got
    finally:
        neardup.BLOCK = old
    grouped = {x.candidate_id: x.group_id for x in neardup.groups(df).collect()}
    assert set(grouped) == set(runs) and all(grouped[a] == grouped[b] for a, b in got)
    parent = {i: i for i in runs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in got:
        parent[root(a)] = root(b)
    assert len({root(i) for i in runs}) == len(set(grouped.values()))
    assert neardup.similar_pairs(df.limit(0)).count() == 0 and neardup.groups(df.limit(0)).count() == 0


def test_hot_copies(spark):
    """Half of all rows are copies of one text, which has near-duplicates as well: all pairs, from blocks."""
    r = random.Random(3)
    hot, other = essay(r, 6), [essay(r, 6) for _ in range(30)]
    rows = [(f"h{k:02}", hot.upper() if k % 2 else hot) for k in range(40)] + [(f"n{k}", hot + f" And {k} more words came.") for k in range(3)] + [(f"o{k}", t) for k, t in enumerate(other)]
    df = spark.createDataFrame(rows, "candidate_id string, candidate_response string")
    old, neardup.BLOCK = neardup.BLOCK, 7
    try:
        got = {(x.candidate_id_a, x.candidate_id_b) for x in neardup.similar_pairs(df).collect()}
    finally:
        neardup.BLOCK = old
    ids = [i for i, _ in rows if i[0] in "hn"]
    assert got == set(combinations(sorted(ids), 2))
    torn = neardup.classes(df, "candidate_id", "candidate_response", 3, 30, 4, 320).where("_id like 'h%'")
    assert torn.select("_cls", "_cls2").distinct().count() == 1


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (12, 10), (20, 21)] + [(100 + k, 101 + k) for k in range(40)]
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "_a bigint, _b bigint")).collect()}
    assert {n: got[n] for n in (1, 4, 12, 21, 140)} == {1: 1, 4: 1, 12: 10, 21: 20, 140: 100}


# p1 --------------------------------------------------------------------------------------------------------
def test_automaton():
    state = truncation.automaton
    assert state('He said "no') == ['"', "bare"] and state("a (b [c] d) e.") == ["terminated"] and state("x {[(") == ["{", "[", "(", "dangling"]
    assert state("broken �")[-1] == state("broken\\u00")[-1] == state("end &am")[-1] == state("an <ins")[-1] == "broken"
    assert state("was then [cut]")[-1] == "cut mark" and state("and so on…") == ["terminated"] and state("fine 🙂") == ["terminated"] and state("") == ["bare"]
    assert state("```\ncode.")[0] == "```" and state("```\nx (\n``` done.") == ["terminated"]
    # a terminator does not hide what is open before it: markup, JSON strings with escapes, quotes
    assert state("<div>One <b>two.") == ["<div>", "<b>", "terminated"] and state("<p>One<br>two</p> x.") == ["terminated"]
    assert state('{"a": "say \\"hi\\" (now.') == ["{", "json string", "terminated"] and state('{"a": ["b", "c"]}') == ["bare"] and state("[1] A note.") == ["terminated"]
    assert state("word " * 200_000 + '(and "so.') == ["(", '"', "terminated"]


def test_evidence():
    r = random.Random(2)
    model = truncation.Evidence([essay(r) for _ in range(400)])
    whole = essay(r)
    assert model.of(None) == (float("-inf"), False) and model.of('{"output": ""}')[0] == float("-inf") and model.of("FAIL")[0] == float("-inf")
    assert model.of(whole)[0] < 0 and model.of("The bo�")[0] > 5 and model.of(whole[: len(whole) // 2].rsplit(" ", 2)[0] + " the")[0] > 0
    assert model.of('{"a": {"b": "' + whole)[0] > model.of(whole)[0] + 5  # open structures weigh against a final stop
    assert model.of_tokens(200, 400, float(np.log(0.25)), 0.05) > 3 and model.of_tokens(100, 400, float(np.log(0.25)), 0.05) < 0 and model.of_tokens(None, 400, 0.1, 0.1) == 0


def test_truncation(spark):
    r = random.Random(11)
    rows, cut = [], {}
    for k in range(700):
        t, n = essay(r), None
        tokens_out = len(t) / 4
        kind = k % 7
        if kind == 0:
            at = r.randrange(len(t) // 3, len(t) - 12)
            while t[at - 1] in ". ":
                at -= 1
            t, n = t[:at], True
        elif kind == 1:
            t = t[:-1]
        rows.append((f"c{k}", "m" if k % 2 else None, t, tokens_out))
        cut[f"c{k}"] = bool(n)
    rows += [("n", "m", None, None), ("e", "m", "", 3.0), ("f", "m", "FAIL", 1.0), ("b", None, "It was then that the ma�", None), ("b", None, "It was then that the ma�", None), ("l", "m", (essay(r, 4000) + " ") * 3, 1.0)]
    df = spoilt(spark, rows, "candidate_id string, model string, candidate_response string, n double", "cut int, _s string, _usual int")
    got = {x.candidate_id: x.cut for x in truncation.judged(df, tokens=df["n"]).collect()}
    assert set(got) == {x[0] for x in rows} and got["b"] and not any(got[i] for i in "nefl")
    right = Counter((cut[i], got[i]) for i in cut)
    assert right[True, True] >= 0.9 * (right[True, True] + right[True, False])
    assert right[False, True] <= 0.02 * (right[False, True] + right[False, False])
    shares = {x.model: (x.n, x.n_cut) for x in truncation.report(df, tokens=df["n"]).collect()}
    assert sum(n for n, _ in shares.values()) == len(set(x[0] for x in rows))
    assert truncation.judged(df.limit(0), tokens=df["n"]).count() == 0


# p3 --------------------------------------------------------------------------------------------------------
def test_empty():
    wrapped = '{"output": "' + " " * 500 + '", "note": null}'
    assert blank.is_empty(wrapped) and blank.is_empty("<div>" * 100 + "</div>" * 100) and blank.is_empty("```json\n{}\n```") and not blank.is_empty('{"output": "' + "A text. " * 100 + '"}')
    for t in (None, "", " \n", chr(0xFEFF), "FAIL", '{"output": ""}', '{"output": null}', "{}", "[]", "```\n```", '""', "(empty)", "N/A", "-", "...", "None", "<p></p>", "[no output]"):
        assert blank.is_empty(t), t
    for t in ("I fail to see it.", '{"output": "A text."}', "No output was given to us by the teacher."):
        assert not blank.is_empty(t), t


def test_chain_is_exact():
    r = np.random.default_rng(2)
    x, pair = r.normal(size=(9, 3)), np.array([0, 0, 0, 0, 1, 1, 2, 2, 2])
    k = len(pairs.TAGS)
    chain = pairs.Chain(r.normal(size=(k, 3)), r.normal(size=(k, k)))
    got = chain._viterbi(x @ chain.emission.T, pair)
    from itertools import product

    for p in range(3):
        rows = np.flatnonzero(pair == p)
        score = lambda tags: sum(x[i] @ chain.emission[t] for i, t in zip(rows, tags)) + sum(chain.transition[a, b] for a, b in zip(tags, tags[1:]))  # noqa: B023, E731
        best = max(product(range(k), repeat=len(rows)), key=score)
        assert tuple(got[rows]) == best
        every = np.array([score(t) for t in product(range(k), repeat=len(rows))])
        weight = np.exp(every - every.max())
        share = np.zeros((len(rows), k))
        for w, t in zip(weight / weight.sum(), product(range(k), repeat=len(rows))):
            share[np.arange(len(rows)), t] += w
        s = (x[rows] @ chain.emission.T)[None]
        one, _ = pairs.Chain.marginals(s, chain.transition, np.ones((1, len(rows)), dtype=bool))
        assert np.allclose(one[0], share)


REFUSALS = ["I'm sorry, but I cannot help with this request.", "Unfortunately, I am unable to complete the requested transformation.", "Regrettably, this is something I must decline for safety reasons.", "As a language assistant, I won't rewrite the answer in this variety."]
SPANISH = ["Según el relato, el abuelo perdió la bicicleta azul en la plaza.", "La niña encontró una lámpara vieja cerca del muelle, y por eso cambió todo.", "Creo que nuestro vecino pintó dos frascos en el mercado porque así lo dice el texto."]


def test_defects(spark):
    r = random.Random(4)
    rows, jobs, want = [], [], {}
    for k in range(500):
        anchor = essay(r, 6)
        prompt = f"Rewrite the student answer below and print nothing else.\n\nPrompt:\nWhy did the settlers disagree about the canal?\n\nAnchor Response:\n{anchor}"
        kind = k % 12
        text, raw, defect = essay(r, 6), None, None
        if kind == 0:
            text, defect = r.choice(["", None, "FAIL", '{"output": ""}', " "]), "empty"
        elif kind == 1:
            text, defect = r.choice(REFUSALS), "refusal"
        elif kind == 2:
            text, defect = r.choice([anchor, anchor.lower(), "Output:\n\n" + anchor, "Why did the settlers disagree about the canal?", anchor.replace(".", " ;")]), "copy"
        elif kind == 3:
            text, defect = " ".join(r.choice(SPANISH) for _ in range(5)), "other_language"
        elif kind == 4:
            text, defect = text[: text.rindex(" ", 0, len(text) - 25) + 2], "truncated"
        elif kind == 5:
            text = text + " I'm sorry but that was not fair at all. My abuela says \"poco a poco se llega lejos\"."
        elif kind == 6:
            text, raw = None, text
        rows.append((f"c{k}", "a", "failed" if kind == 7 else "ok", text, raw, "m"))
        jobs.append((f"c{k}", prompt))
        want[f"c{k}"] = defect
    rows += [(None, None, None, None, None, None), ("nojob", None, None, essay(r), None, None), rows[0], ("long", "a", None, essay(r, 3000), None, "m")]
    df = spoilt(spark, rows, "candidate_id string, anchor_id string, generation_status string, candidate_response string, raw_output string, model string", "defect int, _p int, job_id int")
    asked = spoilt(spark, jobs, "job_id string, generation_prompt string", "candidate_id int, _a int")
    got = {x.candidate_id: x.defect for x in pairs.judged(df, asked, F.lit(None).cast("double")).collect()}
    assert set(got) == {x[0] for x in rows if x[0]} and got["nojob"] is None and got["long"] is None
    wrong = Counter((want[i], got[i]) for i in want if want[i] != got[i])
    assert sum(wrong.values()) <= 10, wrong
    assert pairs.judged(df.limit(0), asked, F.lit(None).cast("double")).count() == 0


# None of these languages or wordings stands in a list of the operator.
UNSEEN = [
    "Moim zdaniem chłopiec zgubił niebieski rower nad rzeką, a potem długo go szukał. W domu nikt nie wiedział, co się stało. Dlatego wszyscy byli bardzo smutni tego wieczoru.",
    "Bence çocuk mavi bisikletini nehir kenarında kaybetti ve uzun süre aradı. Evde kimse ne olduğunu bilmiyordu. Bu yüzden o akşam herkes çok üzgündü.",
    "Menurut saya anak itu kehilangan sepeda birunya di tepi sungai dan lama mencarinya. Di rumah tidak ada yang tahu apa yang terjadi. Karena itu semua orang sangat sedih malam itu.",
    "Podle mého názoru chlapec ztratil modré kolo u řeky a dlouho ho hledal. Doma nikdo nevěděl, co se stalo. Proto byli ten večer všichni velmi smutní.",
    "Minun mielestäni poika kadotti sinisen pyöränsä joen rannalle ja etsi sitä pitkään. Kotona kukaan ei tiennyt mitä oli tapahtunut. Siksi kaikki olivat sinä iltana hyvin surullisia.",
]
UNSEEN_REFUSALS = [
    "This falls outside what I do here, so please ask someone else to look at it.",
    "Making such a version is not something that fits my role, and another tool may serve you better.",
    "It would be best for me to leave this one alone.",
]


def test_unseen_defects(spark):
    r = random.Random(14)
    rows, jobs, want = [], [], {}

    def add(i, text, anchor, defect):
        rows.append((i, None, text, None, "m"))
        jobs.append((i, f"Rewrite the student answer below and print nothing else.\n\nPrompt:\nWhy did the settlers disagree about the canal?\n\nAnchor Response:\n{anchor}"))
        want[i] = defect

    for k in range(500):
        anchor = essay(r, 6)
        words = anchor.split()
        for _ in range(45):
            words[r.randrange(len(words) - 1)] = r.choice(["right", "done", "reckon", "yonder"])
        add(f"c{k}", *((r.choice(REFUSALS), anchor, "refusal") if k % 10 == 0 else (" ".join(words), anchor, None)))
    for k, t in enumerate(UNSEEN):
        add(f"l{k}", t, essay(r, 6), "other_language")
    for k, t in enumerate(UNSEEN_REFUSALS):
        add(f"r{k}", t, essay(r, 6), "refusal")
    df = spark.createDataFrame(rows, "candidate_id string, generation_status string, candidate_response string, raw_output string, model string")
    asked = spark.createDataFrame(jobs, "job_id string, generation_prompt string")
    got = {x.candidate_id: x.defect for x in pairs.judged(df, asked, F.lit(None).cast("double")).collect()}
    assert {i: got[i] for i in got if i[0] in "lr"} == {i: want[i] for i in got if i[0] in "lr"}
    wrong = Counter((want[i], got[i]) for i in want if got[i] != want[i])
    assert sum(wrong.values()) <= 5, wrong


# p4 and p7 -------------------------------------------------------------------------------------------------
def test_running_sum(spark):
    rows = [(g, k, (k * 37) % 101 / 101, k % 5) for g in ("a", "b", None) for k in range(101)]
    df = spark.createDataFrame(rows, "g string, k int, p double, v int")
    got = {(x.g, x.k): x.s for x in prefix.running_sum(df, ["g"], F.col("p"), ["k"], F.col("v"), "s", slices=7).collect()}
    for g in ("a", "b", None):
        total = 0
        for _, k, _, v in sorted((x for x in rows if x[0] == g), key=lambda x: (x[2], x[1])):
            total += v
            assert got[g, k] == total
    assert len(prefix.bounded_sample(df, 50)) == 50 and prefix.bounded_sample(df, 50) == prefix.bounded_sample(df, 50) and prefix.bounded_sample(df.limit(0), 5) == []


SUMMARY = [("One-A", "HIGH", 3), ("One-A", "MID", 2), ("Two_2.0", "HIGH", 5)]
SHARES = [("Southern American English", 0.5, 2), ("Midwestern/North Central", 0.3, 4), ("African American English (AAE)", 0.2, 3)]


def test_sampling(spark):
    anchors = [(f"a{k}", None, ["One-A", "one_a ", "Two 2.0", None, "other"][k % 5], ["HIGH", "medium", " high", "MID", ""][(k // 5) % 5]) for k in range(900)] + [("a3", None, "One-A", "MID"), (None, None, "One-A", "MID")]
    pool_rows = [(f"a{k}", ["Southern", "southern american english", "AAE", "midwestern / north central", None, "unknown"][(k // 3) % 6]) for k in range(900)] * 2 + [(None, "Southern")]
    tables = [spoilt(spark, anchors, "essay_id string, anchor_id string, dataset string, score_band string", "dialect_family int"), spoilt(spark, pool_rows, "anchor_id string, dialect_family string", "dataset int"), spark.createDataFrame(SUMMARY, "dataset string, score_band string, count int"), spark.createDataFrame(SHARES, "dialect_family string, target_share double, min_rows int")]
    pool = sampling.pool_of(*tables)
    rows = [tuple(r) for r in pool.collect()]
    assert len(rows) == len(set(rows)) and {r[1] for r in rows} <= {"One-A", "Two_2.0"} and ("a3", "One-A", "MID", "Southern American English") in rows
    cells = sampling.cells_of(pool, *tables[2:], 0.2)
    taken, report = sampling.sample(pool, cells)
    taken, report = [tuple(r) for r in taken.collect()], report.collect()
    assert len(report) == 9 and {r[:4] for r in taken} <= set(rows) and len({r[:4] for r in taken}) == len(taken)
    have = Counter(r[1:4] for r in rows)
    for r in report:
        n = have[r.dataset, r.score_band, r.dialect_family]
        target = {(a, b): c for a, b, c in SUMMARY}[r.dataset, r.score_band] / 10 * {f: s for f, s, _ in SHARES}[r.dialect_family] * len(rows) * 0.2
        assert r.pool_rows == n and abs(r.target - target) < 1e-9 and r.short == (n < target or n < r.min_rows)
        assert abs(r.sampled - r.added - min(n, target)) < 1 + 1e-6 and r.sampled >= min(n, r.min_rows)
    empty = sampling.sample(pool.limit(0), sampling.cells_of(pool.limit(0), *tables[2:], 0.2))
    assert empty[0].count() == 0 and empty[1].where("short").count() == 9


def test_mixing(spark):
    r = random.Random(9)
    rows = [(k, essay(r, r.randrange(1, 4)), r.choice(["big", "Big ", "mid-one", "mid_one", None, "none"])) for k in range(300)] + [(900 + k, "tiny text", "small") for k in range(3)] + [(1000, None, "big"), (1001, "", "big")]
    docs = spoilt(spark, rows, "doc_id bigint, text string, source string", "n_tokens int, repeat int, _key int")
    targets = spark.createDataFrame([("big", 0.3, 2), ("mid_one", 0.5, 3), ("small", 0.15, 4), ("absent", 0.05, 2), ("zero", 0.0, 2)], "source string, target_weight double, max_repeats int")
    mixed, report = mixing.mix(docs, targets)
    mixed, report = mixed.collect(), {x.source: x for x in report.collect()}
    total = report["big"].total_tokens
    assert {s for s, x in report.items() if x.short} == {s for s, x in report.items() if x.max_repeats * x.source_tokens < x.target_weight * total} >= {"small", "absent"}
    used = Counter((x.doc_id, x.repeat) for x in mixed)
    assert max(used.values()) == 1 and all(x.repeat <= report[x._key].max_repeats for x in mixed)
    assert total - 200 < sum(x.n_tokens for x in mixed) <= total and sum(x.mixed_tokens for x in report.values()) == sum(x.n_tokens for x in mixed)
    assert abs(report["big"].mixed_tokens / report["mid_one"].mixed_tokens - 0.6) < 0.1 and report["small"].passes == 4
    order = sorted(mixed, key=lambda x: (x.finish, x._key, x.doc_id, x.repeat))
    assert [x.position for x in order] == list(np.cumsum([x.n_tokens for x in order]))
    none, lines = mixing.mix(docs.limit(0), targets)
    assert none.count() == 0 and lines.count() == 5


def test_mix_of_one_source(spark):
    """A small weight and one very long source stretch the virtual times."""
    rows = [(k, "word " * (1 + k % 7), "big") for k in range(400)] + [(1000 + k, "tail " * 30, "rare") for k in range(5)]
    targets = spark.createDataFrame([("big", 0.999, 1), ("rare", 0.001, 3)], "source string, target_weight double, max_repeats int")
    mixed, report = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), targets)
    order = sorted(mixed.collect(), key=lambda x: (x.finish, x._key, x.doc_id, x.repeat))
    assert [x.position for x in order] == list(np.cumsum([x.n_tokens for x in order])) and report.count() == 2


# p8 --------------------------------------------------------------------------------------------------------
def test_cuts():
    assert reading.cuts_of([]) == []
    rows = [(1.0 + k / 100, 1.0) for k in range(10)] + [(2.0 + k / 100, 2.0) for k in range(10)] + [(2.05, 3.0)] + [(3.0, 3.0), (3.1, 3.0), (3.8, 4.0), (3.9, 4.0)]
    a, b, c = reading.cuts_of(rows)
    assert 1.09 < a < 2.0 and 2.09 < b < 3.0 and 3.1 < c < 3.8


def test_levels(spark):
    r = random.Random(6)
    words = {1: "cat dog sun run hat bed red".split(), 2: "coach river window market yellow bicycle".split(), 3: "committee decision audience building program village".split(), 4: "methodology calibration epistemological stratification variability".split()}
    rows, truth = [], {}
    for k in range(400):
        level = k % 4 + 1
        rows.append((k, "Note 3: " * (k % 3 == 0) + ". ".join(" ".join(["the", *r.choices(words[level], k=6), "and", "was"]) for _ in range(6)) + ".", ["en", "EN", "en-US", None][k % 4 if k % 7 else 3], "s"))
        truth[k] = level
    rows += [(2000 + k, t, None, "s") for k, t in enumerate(UNSEEN)]  # languages that no document is labelled with
    rows += [(1000, None, "en", "s"), (1001, "", "en", None), (1002, "Según el relato, el abuelo perdió la bicicleta en la plaza y no la encontró.", None, "s"), (1003, "El texto", "es", "s"), (1004, " \n ", "en", "s"), (1005, "methodology " * 20000, "en", "s")]
    labels = [(k, "r", truth[k] if r.random() > 0.05 else max(1, truth[k] - 1)) for k in range(0, 400, 5)] + [(0, "r2", 1), (0, "r", 1), (99999, "r", 4), (None, "r", 2), (5, "r", None)]
    docs = spoilt(spark, rows, "doc_id bigint, text string, lang string, source string", "score int, grade int, node int, level int")
    graded = spoilt(spark, labels, "doc_id bigint, rater string, level int", "text string")
    leveled = reading.levels(docs, graded)
    got = {x.doc_id: x.level for x in leveled.collect()}
    assert not set(got) & {1000, 1001, 1002, 1003, 1004, *range(2000, 2005)} and got[1005] == 4
    assert sum(got[k] == truth[k] for k in truth) >= 0.98 * len(truth)
    assert reading.profile(leveled, docs).first().n == 401
    moves = reading.harmonic(docs, graded)[1]
    assert moves[-1][1] <= reading.TOLERANCE < moves[0][1] and len(moves) < 20
    # the same where most nodes are too many to broadcast
    old, reading.HOT = reading.HOT, 9
    try:
        assert {x.doc_id: x.level for x in reading.levels(docs, graded).collect()} == got
    finally:
        reading.HOT = old
    assert reading.levels(docs, graded.limit(0)).where("level is not null").count() == 0
    assert reading.levels(docs.limit(0), graded).count() == 0


def test_every_language_document_counts(spark):
    """All documents in other languages are read, those without a Latin letter too, and all tell the language."""
    rows = [(k, f"el abuelo número {k} perdió la bicicleta", "es") for k in range(2500)] + [(5000, chr(0x43D) + chr(0x435) + chr(0x442), "ru"), (5001, chr(0xE9) + " " + chr(0xE9), "en"), (5002, None, "en"), (5003, "12", "en")]
    kinds = reading.graph(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).groupBy("kind").count().collect()
    assert {x.kind: x["count"] for x in kinds} == {"other": 2501, "en": 1}
    r = random.Random(8)
    for n in (2, 60, 300):
        told = [(round(r.random() ** 0.5, 2), "en") for _ in range(n)] + [(round(r.random() ** 2, 2), "other") for _ in range(n // 2)]
        s, yes = np.array([x[0] for x in told]), np.array([x[1] == "en" for x in told])
        places = np.unique(s)
        edges = (2 * places[:-1] + places[1:]) / 3
        wrong = [int((~yes).sum() * ((s < e) & yes).sum() + yes.sum() * ((s >= e) & ~yes).sum()) for e in edges]
        want = max(np.flatnonzero(np.array(wrong) == min(wrong)), key=lambda k: (places[k + 1] - places[k], -k))
        shares = spark.createDataFrame([*told, (0.99, "unknown")], "share double, kind string")
        assert reading._least_share(shares) == pytest.approx(edges[want])
    assert reading._least_share(spark.createDataFrame([(0.4, "en"), (0.4, "other")], "share double, kind string")) == 0.4
    assert reading._least_share(spark.createDataFrame([(0.4, "en"), (0.4, "unknown")], "share double, kind string")) == 0.5
