"""Functions against plain Python."""

import random
import re
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from variantloom.functions import alignment, edits, similarity as sim
from variantloom.functions import text as tx

TEXTS = ["", "a", "ab", "Hello, wörld's end!  ", "one two\tthree\n", "naïve café — déjà_vu 42", "  x ", "...", "x" * 3000, None, "The cat sat. The cat sat.", "日本語 テキスト", "🙂 ok"]
PAIRS = [(a, b) for a in TEXTS[:9] + TEXTS[10:] for b in ("", "the cat sat", "Hello wörld", "日本語")] + [(None, "x"), ("x", None), (None, None)]


def run(spark, rows, schema, **columns):
    return [r.asDict() for r in spark.createDataFrame(rows, schema).select("*", *(c.alias(n) for n, c in columns.items())).collect()]


def test_words(spark):
    for r in run(spark, [(t,) for t in TEXTS], "t string", n=tx.word_count("t"), s=tx.token_set("t"), p=tx.plain_words("t"), strip=tx.strip("t"), norm=tx.normalized("t")):
        t = r["t"] or ""
        assert r["n"] == len(re.findall(r"\b\S+\b", t))
        assert set(r["s"]) == {w.lower() for w in re.findall(r"\w+", t)}
        assert r["p"] == re.findall(r"[A-Za-z][A-Za-z']*", t)
        assert r["norm"] == " ".join(w.lower() for w in r["p"])
        if r["t"] is not None:
            assert r["strip"] == t.strip()


def test_similarity(spark):
    rows = spark.createDataFrame(PAIRS, "a string, b string")
    rows = sim.with_char_jaccard(rows, "a", "b", "grams").select("*", sim.token_jaccard("a", "b").alias("tokens"), sim.edit_distance("a", "b").alias("edits"), sim.length_ratio("a", "b").alias("length"), sim.exact("a", "b").alias("same"))

    def grams(t):
        t = t.lower()
        return {t} if len(t) < 3 else {t[i : i + 3] for i in range(len(t) - 2)}

    def jaccard(x, y):
        return 1.0 if not x | y else len(x & y) / len(x | y)

    for r in rows.collect():
        a, b = r.a or "", r.b or ""
        assert r.grams == jaccard(grams(a), grams(b))
        assert r.tokens == jaccard({w.lower() for w in re.findall(r"\w+", a)}, {w.lower() for w in re.findall(r"\w+", b)})
        assert r.length == (len(b) / len(a) if a else 0.0)
        assert r.same == (a.strip() == b.strip())


def test_edit_distances(spark):
    """Every length around a word of bits, groups of one and of many pairs, against the table of all prefixes and Spark's own."""

    def plain(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
            last = now
        return last[-1]

    r, pairs = random.Random(3), [("", ""), ("", "abc"), ("a" * 64, "a" * 65), ("ab" * 200, "ba" * 200), ("a\0b", "ab")]
    for _ in range(150):
        letters = r.choice(["ab", "abcdefgh é" + chr(0x1F600), "abc" + chr(0x4E00) + chr(0x4E01)])
        x = r.choices(letters, k=r.choice([0, 1, 5, 63, 64, 65, 127, 128, 129, 200]))
        y = list(x) if r.random() < 0.5 else r.choices(letters, k=r.choice([0, 1, 64, 65, 130]))
        for _ in range(r.choice([0, 1, 5, 30]) if y else 0):
            y[r.randrange(len(y))] = r.choice(letters)
        pairs.append(("".join(x), "".join(y[r.choice([0, 0, 3]) :])))
    a, b = zip(*pairs)
    want, old = [plain(x, y) for x, y in pairs], (edits.WORDS, edits.TABLE)
    try:
        for edits.WORDS, edits.TABLE in (old, (6, old[1]), (64, 40)):
            assert edits.distances(list(a), list(b)).tolist() == want and not len(edits.distances([], []))
    finally:
        edits.WORDS, edits.TABLE = old
    got = run(spark, [*pairs, (None, "x"), ("x", None), (None, None)], "a string, b string", new=sim.edit_distance("a", "b"), old=F.levenshtein(tx.text("a"), tx.text("b")))
    assert [g["new"] for g in got] == [g["old"] for g in got] == [*want, 1, 1, 0]


def test_rounded(spark):
    values = [p / q for q in range(1, 130) for p in range(q)] + [0.03125, 0.00015, 2.675]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(sim.rounded(F.col("v"))).collect()]
    assert got == [round(v, 4) for v in values]


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([], []), ([0.0], [1.0]), ([1.0], [1.0, 2.0]), (None, [1.0])]
    assert [r["c"] for r in run(spark, rows, "a array<double>, b array<double>", c=sim.cosine("a", "b"))] == [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]


def test_append_and_edits(spark):
    rows = [("a b c", "a b c d"), ("a b c", "a b c d e f g"), ("a b c", "x b c d"), ("a b", "A B!"), ("", "x")]
    assert [r["x"] for r in run(spark, rows, "a string, b string", x=sim.is_append("a", "b"))] == [True, False, False, False, True]
    assert [r["x"] for r in run(spark, [("cat", "cart"), ("cat", "dog"), (None, "a")], "a string, b string", x=sim.within_edits("a", "b", 1))] == [True, False, True]


def test_lists_and_markers(spark):
    r = run(spark, [(" a, ,b ,",), (None,), ("",)], "t string", x=tx.listed("t"))
    assert [x["x"] for x in r] == [["a", "b"], [], []]
    assert [x["m"] for x in run(spark, [("  Right?! ",), ("For   Sure.",), (None,)], "t string", m=tx.marker_form("t"))] == ["right", "for sure", ""]
    got = run(spark, [(["A -> b", "x", "a -> B", "c -> d -> e"],), (None,)], "t array<string>", p=tx.correction_pairs("t"))
    assert [tuple(x) for x in got[0]["p"]] == [("a", "b"), ("c", "d -> e")] and got[1]["p"] is None
    assert run(spark, [("x",)], "t string", x=tx.replaced("{A}-{B}", [("{A}", F.lit("{B}")), ("{B}", "t")]))[0]["x"] == "x-x"


def test_alignment_figures():
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}x".replace("w", "word") for k in range(50)]
    other = [*words[:20], "zzzz", *words[21:]]
    m = alignment.measured(" ".join(words), " ".join(other))
    assert (m["changed_words"], m["changed_chunks"], m["anchor_words"]) == (2, 1, 50)
    assert m["changed_words"] / m["anchor_words"] == 0.04
    assert alignment.measured("tide", "diet")["char_ratio"] == 0.25 and alignment.measured("diet", "tide")["char_ratio"] == 0.5
    assert alignment.measured(None, None)["char_ratio"] == 1.0


def test_corrections_and_repair():
    m = alignment.measured("the pationt then cam by snowmoble", "the patient then came by snowmobile")
    assert m["corrections"] == ["cam -> came", "pationt -> patient", "snowmoble -> snowmobile"]
    assert alignment.measured("I seen them", "I seen dem", allowed=["dem"])["corrections"] == []
    assert alignment.measured("a cat sat", "a dog sat", known=["cat"])["corrections"] == ["cat -> dog"]
    fixed = alignment.restored("Put it over ther now", "Put it over there now, right?", ["ther -> there"])
    assert fixed == {"text": "Put it over ther now, right?", "repairs": ["ther -> there"]}
    assert alignment.restored(None, None, []) == {"text": "", "repairs": []}


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_one_edit(a, b):
    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    assert alignment.one_edit_apart(a, b) == (distance(a, b) <= 1)


def test_align_column(spark):
    r = run(spark, [("a b", "a c"), (None, None)], "a string, b string", m=alignment.align(F.col("a"), F.col("b")))
    assert r[0]["m"]["char_ratio"] == pytest.approx(SequenceMatcher(None, "a b", "a c").ratio())
    assert r[1]["m"]["changed_words"] == 0
