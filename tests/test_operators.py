"""Operators on small fixtures, with nulls, ties, repeated rows and empty tables."""

import json
import os
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from variantloom.functions.alignment import Second
from variantloom.operators import anchors as an
from variantloom.operators import assign, audit, generate, order, records, repair, reports, trace, verdicts
from variantloom.operators.order import numbered, numbered_within
from variantloom.plans.fixture import FAMILIES, INVENTORY, PLAIN_TEMPLATE, offline_client
from variantloom.plans.workflow import Flow
from variantloom.sources import inventory as inv
from variantloom.sources import records as files


def test_numbering(spark):
    rows = spark.createDataFrame([("b", 2), ("a", 1), (None, 3), ("a", 0)], "g string, v int")
    assert sorted((r.v, r.n) for r in numbered(rows, ["v"], "n").collect()) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert sorted((r.v, r.n) for r in numbered_within(rows, ["g"], ["v"], "n").collect()) == [(0, 0), (1, 1), (2, 0), (3, 0)]
    assert numbered(rows.limit(0), ["v"]).count() == 0


def test_keys(spark):
    rows = spark.createDataFrame([(" ", "e1", None), ("a1", "e2", ""), (None, "e3", "x")], "anchor_id string, essay_id string, source_corpus string").withColumn("dataset", F.lit("d"))
    assert [tuple(r) for r in rows.select(an.identifier(rows), an.source(rows)).collect()] == [("e1", "d"), ("a1", "d"), ("e3", "x")]
    bad = spark.createDataFrame([(None,)], "anchor_id string")
    with pytest.raises(Exception, match="no anchor_id"):
        bad.select(an.identifier(bad)).collect()
    kept = an.last_of_each(spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "id string, v int"), F.col("id"), ["v"]).collect()
    assert [(r["_key"], r["_row"]["v"]) for r in kept] == [("a", 2)]
    r = spark.range(1).select(an.job_id(F.lit("a"), F.lit("X Y/Z"), F.lit(1)).alias("j"), an.trace_id(F.lit("a"), F.lit("X Y/Z")).alias("t"), trace.output_key(F.lit(" AAE ")).alias("k"), trace.output_key(F.lit("New X")).alias("o")).first()
    assert tuple(r) == ("a_X_Y/Z_1", "a_X_Y_Z_trace", "aae_output", "new_x_output")


def test_balanced_order(spark):
    rows = spark.createDataFrame([("A1", "s", "low", "d", 0), ("A2", "s", "low", "d", 1), ("B1", "s", "mid", "d", 2), ("C1", "s", "HIGH", "d", 3)], "anchor_id string, source_corpus string, score_band string, domain string, o int")
    got = assign.balanced(rows, ["x", "y"], ["o"]).orderBy("position").collect()
    assert [r.anchor_id for r in got] == ["A1", "B1", "C1", "A2"] and [r.dialect_family for r in got] == ["x", "y", "x", "y"]
    assert assign.greedy(rows, ["x"], ["o"], limit=2).count() == 2
    assert assign.greedy(rows.limit(0), ["x"], ["o"]).count() == 0
    with pytest.raises(ValueError):
        assign.greedy(rows, [], ["o"])


def test_jobs(spark):
    rows = spark.createDataFrame([("a", "old", None), ("a", "text {DIALECT_FAMILY}", " ")], "anchor_id string, text string, prompt string")
    asked = spark.createDataFrame([("a", FAMILIES[0], 2), ("zz", FAMILIES[0], 1), ("a", "unknown", 1)], "anchor_id string, dialect_family string, target_candidates int")
    made = assign.jobs(asked, rows, inv.family_table(spark, INVENTORY), PLAIN_TEMPLATE, "v", ["text"]).orderBy("job_id").collect()
    assert len(made) == 2 and made[0].generation_prompt == f"Question: [PROMPT NOT PROVIDED]\n\nText: text {FAMILIES[0]}\n\nVariety: {FAMILIES[0]}"
    assert [r.anchor_id for r in assign.unmatched(asked, rows, "anchor_id").collect()] == ["zz"]


def test_markers(spark):
    config = {"x": {"features": [
        {"id": "x_tag_right", "category": "discourse", "feature": "sentence-final right", "source_reference": "", "allowed_for_generation": True},
        {"id": "m", "category": "lexical", "feature": "mad", "source_reference": "", "allowed_for_generation": True, "detection_markers": ["pop", " pop "]},
        {"id": "no", "category": "lexical", "feature": "never", "source_reference": "", "allowed_for_generation": False},
        {"id": "aae_habitual_be", "category": "syntactic", "feature": "habitual be", "source_reference": "", "allowed_for_generation": True},
    ]}}
    assert inv.markers(config["x"]) == ["sentence-final right", "mad", "habitual be", "right", "pop"]
    rows = spark.createDataFrame([("Madison is popular, right?", "x"), ("They be working and kids always be playing", "x"), (None, "x"), ("right", "other")], "t string, f string")
    got = rows.select(verdicts.marker_hits(F.col("t"), F.col("f"), config).alias("h")).select(verdicts.detected(F.col("h")).alias("d"), verdicts.realizations(F.col("h")).alias("n")).collect()
    assert [(r.d, r.n) for r in got] == [(["right"], 1), (["habitual be"], 2), ([], 0), ([], 0)]


def test_prefilter_and_score(spark):
    anchor = "the pationt cam by with one two three four five six seven"
    rows = spark.createDataFrame(
        [("c1", anchor, anchor.replace("cam", "came"), FAMILIES[0], "ok", None), ("c2", anchor, anchor, FAMILIES[0], "api_error", ["old", "student_text_correction"]), ("c3", anchor, "fail", FAMILIES[0], None, None), ("c4", None, None, None, None, None)],
        "candidate_id string, anchor_response string, candidate_response string, dialect_family string, generation_status string, rejection_reasons array<string>",
    )
    early = {r.candidate_id: r for r in verdicts.prefilter(rows, INVENTORY).collect()}
    assert early["c1"].rejection_reasons == ["insufficient_approved_features", "student_text_correction"] and early["c1"].student_text_corrections == ["cam -> came"]
    assert "generation_failed" in early["c3"].rejection_reasons and early["c4"].length_delta == 1.0
    late = {r.candidate_id: r for r in verdicts.score(rows, INVENTORY).collect()}
    assert late["c2"].rejection_reasons == ["generation_failed", "generation_status:api_error", "insufficient_change", "old"]
    assert late["c1"].similarity_scores.difflib_ratio == round(SequenceMatcher(None, anchor, anchor.replace("cam", "came")).ratio(), 4)
    assert late["c4"].rejection_reasons == ["candidate_too_short", "insufficient_change"]


def _audited(spark, rows):
    return spark.createDataFrame(rows, "candidate_id string, anchor_id string, candidate_index int, dialect_family string, anchor_response string, candidate_response string, detected_features array<string>, feature_realization_count int, rejection_reasons array<string>, passed_quality_filter boolean, x_extra string")


def test_audit(spark):
    words = ["word" + chr(97 + k // 26) + chr(97 + k % 26) for k in range(100)]
    near = list(words)
    for k in (10, 40, 70, 90):
        near[k] = "other" + chr(97 + k % 26)
    a, b = " ".join(words), " ".join(near)
    rows = [
        ("c1", "a", 1, "X", a, b, ["y'all", "ope", "z"], 3, [], True, "e"), ("c2", "a", 2, "X", a, b, ["done"], 1, [], True, "e"), ("c3", "a", None, "Appalachian English", a, "It was, right ?", [], None, None, None, None),
        ("c4", "b", 1, "African American English (AAE)", a, "He done be there", ["Finna!"], 0, [], True, "e"), ("c5", "b", 2, None, None, "FAIL", ["right"], 0, [], True, "e"), (None, None, None, None, None, None, None, None, None, None, None),
    ]
    got = {r.candidate_id: r for r in audit.audit(_audited(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert got["c1"].rejection_reasons == ["anchor_near_duplicate"] and got["c1"].audit_changed_chunk_count == 4 and got["c1"].passed_quality_filter is False
    assert got["c2"].duplicate_of_candidate_id == "c1" and got["c2"].rejection_reasons == ["within_anchor_duplicate", "long_anchor_low_feature_count", "anchor_near_duplicate", "single_detected_feature", "common_feature_only"]
    assert got["c1"].max_pairwise_sibling_similarity == 1.0 and got["c1"].duplicate_of_candidate_id is None
    assert "cross_family_tag_right" in got["c3"].rejection_reasons
    assert got["c4"].aae_authenticity_notes == ["aae_done_be_stack"] and got["c5"].surface_change_ratio is None
    assert audit.audit(_audited(spark, [])).count() == 0


def test_sibling_pairs_are_exact(spark):
    import random

    random.seed(1)
    base = [[random.choice("abcdefgh") * random.randint(1, 5) for _ in range(30)] for _ in range(4)]
    texts = [" ".join(w if random.random() > 0.03 else "zz" for w in random.choice(base)) for _ in range(40)] + ["", ""]
    rows = spark.createDataFrame([(1, k, k, t, f"c{k}") for k, t in enumerate(texts)], "anchor_id int, _vl_row bigint, _vl_i bigint, _vl_text string, candidate_id string")
    old, audit.BLOCK = audit.BLOCK, 8
    try:
        for threshold in (0.985, 0.9, 0.0):
            got = {(r._left, r._right) for r in audit.sibling_pairs(rows, threshold).collect()}
            want = {(i, j) for i, j in combinations(range(len(texts)), 2) if max(SequenceMatcher(None, texts[i], texts[j]).ratio(), SequenceMatcher(None, texts[j], texts[i]).ratio()) >= threshold}
            assert got == want
    finally:
        audit.BLOCK = old


def test_sibling_maximum_is_over_all(spark):
    import random

    random.seed(3)
    base = ["".join(random.choice("abcdefghijklmnopq ") for _ in range(n)).strip() for n in (90, 133, 400)]
    part = base[0][: int(len(base[0]) * 0.6)] + "z" * (len(base[0]) - int(len(base[0]) * 0.6))
    close = base[1][:40] + "z" + base[1][41:90] + "z" + base[1][91:]
    rows = [(f"c{k}", a, k, "X", "", t, [], 0, [], True, "") for k, (a, t) in enumerate([("a", base[0]), ("a", part), ("b", base[1]), ("b", close), ("c", "alone")])]
    got = {r.candidate_id: r for r in audit.audit(_audited(spark, rows)).collect()}
    norm = lambda t: " ".join(t.split())
    ratio = lambda x, y: SequenceMatcher(None, norm(x), norm(y)).ratio()
    assert 0.55 < got["c0"].max_pairwise_sibling_similarity == round(ratio(base[0], part), 4) < 0.7 and got["c0"].pairwise_sibling_similarity is None
    assert got["c4"].max_pairwise_sibling_similarity == 0.0
    assert 0.98495 <= ratio(base[1], close) < 0.985 and got["c2"].sibling_similarity_over_threshold_count == 1 and got["c3"].duplicate_of_candidate_id is None
    listed = {r.candidate_id: r for r in audit.audit(_audited(spark, rows), at_least=0).collect()}
    assert [x.candidate_id for x in listed["c0"].pairwise_sibling_similarity] == ["c1"] and listed["c0"].sibling_similarity_over_threshold_count == 0
    shown = {r.candidate_id: r for r in audit.audit(_audited(spark, rows), at_least=0, texts=True).collect()}
    assert [tuple(x) for x in shown["c1"].sibling_candidate_responses] == [("c0", base[0])] and shown["c4"].sibling_candidate_responses is None

    # half of all rows share one text, another text is nearly the same: numbers, not lists
    many = [(f"m{k:02}", "m", k, "X", "", base[1] if k % 2 else f"{base[2]} q{k}", [], 0, [], True, "") for k in range(30)] + [("near", "m", 40, "X", "", close, [], 0, [], True, ""), ("same", "m", 41, "X", "", base[1] + " !", [], 0, [], True, "")]
    every = {r.candidate_id: r for r in audit.audit(_audited(spark, many)).collect()}
    assert every["m01"].duplicate_of_candidate_id is None and {every[f"m{k:02}"].duplicate_of_candidate_id for k in range(3, 30, 2)} == {"m01"} and every["same"].duplicate_of_candidate_id == "m01"
    assert every["m03"].sibling_similarity_over_threshold_count == 16 and every["m03"].pairwise_sibling_similarity is None and every["near"].sibling_similarity_over_threshold_count == 16
    listed = {r.candidate_id: r for r in audit.audit(_audited(spark, many), at_least=0.98).collect()}
    assert [x.candidate_id for x in listed["m03"].pairwise_sibling_similarity] == ["m01", *(f"m{k:02}" for k in range(5, 30, 2)), "near", "same"]

    words = ["".join(random.choice("abcdefgqz") for _ in range(random.randint(1, 7))) for _ in range(60)]
    texts = [" ".join(random.choice(words) for _ in range(random.choice((5, 30, 60, 90)))) for _ in range(40)] + ["", "", "a", "zq" * 150, "e" * 300]
    brute = [[SequenceMatcher(None, x, y).ratio() for y in texts] for x in texts]
    want = [max(brute[i][j] for j in range(len(texts)) if j != i) for i in range(len(texts))]
    assert audit._search(texts, [float(texts.count(t) > 1) for t in texts], texts, True) == want and [Second(y).ratio(x) for x in texts for y in texts if x or y] == [brute[i][j] for i, x in enumerate(texts) for j, y in enumerate(texts) if x or y]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "anchor_id int, _vl_row bigint, _vl_text string")
    old, audit.CLOSEST_BLOCK = audit.CLOSEST_BLOCK, 18
    try:
        assert {r._vl_row: r._vl_best for r in audit.closest(df).collect()} == dict(enumerate(want))
    finally:
        audit.CLOSEST_BLOCK = old


def test_marker_and_edit_queries_read_original_texts(spark, tmp_path):
    import re

    from variantloom.plans import queries

    def edits(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
            last = now
        return last[-1]

    dash, space, left, right = map(chr, (0x2014, 0xA0, 0x201C, 0x201D))
    source = f"caf{chr(0xE9)} {left}no{right}"
    texts = [f"He {left}finna{right} go{dash}finna{space}now", f"{chr(0xE9)}finna finna{chr(0xE9)} done", f"caf{chr(0xE8)} {right}no{left}", "", f"they be{space}going", None]
    spark.createDataFrame([("e1", None, source, "d", "low")], "essay_id string, anchor_id string, text string, dataset string, score_band string").write.parquet(f"{tmp_path}/anchors.parquet")
    spark.createDataFrame([(f"c{k}", "e1", FAMILIES[5], k, t) for k, t in enumerate(texts)], "candidate_id string, anchor_id string, dialect_family string, candidate_index int, candidate_response string").write.parquet(f"{tmp_path}/candidates.parquet")
    edge = lambda c: r"\b" if c.isalnum() else ""
    patterns = [(m, edge(m[0]) + re.escape(m.lower()) + edge(m[-1])) for m in inv.markers(INVENTORY[FAMILIES[5]])] + [("habitual be", inv.HABITUAL)]
    hits = [[(m, len(re.findall(p, (t or "").lower()))) for m, p in patterns] for t in texts]
    got = {r.candidate_id: (r.realizations, len(r.detected.split("|")) if r.detected else 0) for r in queries.QUERIES["marker_counts"](spark, str(tmp_path)).collect()}
    assert got == {f"c{k}": (sum(n for _, n in h), len({m for m, n in h if n})) for k, h in enumerate(hits)} and got["c0"] == (2, 1) and got["c4"] == (1, 1)
    got = {r.candidate_id: (r.edits, r.share) for r in queries.QUERIES["edit_distance"](spark, str(tmp_path)).collect()}
    assert got == {f"c{k}": (edits(source, t or ""), edits(source, t or "") / max(len(source), len(t or ""))) for k, t in enumerate(texts)} and got["c2"][0] == 3


def test_records(spark):
    rows = spark.createDataFrame([("a", "1", 0.5, True, ["x"]), ("a", "2", 0.5, True, None), ("a", "3", None, True, []), ("a", "4", 9.0, None, ["x", "y"]), (None, "5", 1.0, True, [])], "anchor_id string, candidate_id string, quality_score double, passed_quality_filter boolean, rejection_reasons array<string>")
    rows = rows.withColumn("candidate_index", F.lit(1))
    best = {r.candidate_id: r.selected_reason for r in records.best_of_each(rows, 2).collect()}
    assert best == {"1": "rank 1/3 for anchor a", "2": "rank 2/3 for anchor a", "5": "rank 1/1 for anchor "}
    assert [tuple(r) for r in records.reason_tally(rows).collect()] == [("x", 1), ("y", 1)]
    assert records.best_of_each(rows).count() == 4
    base = spark.createDataFrame([("1", "o", 1), ("1", "o", 2), (None, "o", 3), ("2", "o", 4)], "candidate_id string, v string, k int")
    new = spark.createDataFrame([("1", "m", True), ("1", "n", True), ("9", "n", True)], "candidate_id string, v string, extra boolean")
    got = sorted((str(r.candidate_id), r.v, r.k, r.extra) for r in records.upserted(base, new, order=["v"]).collect())
    assert got == [("1", "n", None, True), ("1", "n", None, True), ("2", "o", 4, None), ("9", "n", None, True), ("None", "o", 3, None)]
    assert sorted(r.candidate_id for r in records.to_retry(rows, ["x"], limit=5).collect()) == ["4"]
    assert records.to_retry(rows, ["x"], only="7, 8").count() == 0
    assert records.remaining(base, new, "candidate_id").count() == 2
    assert records.latest(base, "candidate_id", ["k"]).count() == 3


def test_generation(spark):
    jobs = spark.createDataFrame([("j1", "a", "f", 1, "v", "p")], "job_id string, anchor_id string, dialect_family string, candidate_index int, prompt_version string, generation_prompt string")
    made = generate.generate(jobs, offline_client, "m").first()
    assert made.candidate_id == "j1" and made.generation_status == "demo_unvalidated" and made.candidate_response.startswith("Answer")

    def broken():
        def call(prompt):
            raise RuntimeError("HTTP 500")

        return call

    assert generate.generate(jobs, broken, "m").first().generation_status == "api_error"

    def echo():
        return lambda prompt: {"id": "x", "text": prompt, "usage": json.dumps({"input_tokens": 5})}

    two = jobs.unionAll(jobs.withColumns({"job_id": F.lit("j2"), "candidate_index": F.lit(2)}))
    said = {r.candidate_id: r for r in generate.generate(two, echo, "m", total=4).collect()}
    assert said["j2"].candidate_response.startswith("p\n\nCandidate attempt: 2 of 4.\nIf more than one") and said["j1"].candidate_response != said["j2"].candidate_response
    assert (said["j1"].tokens_in, said["j1"].tokens_out) == (5, None)
    waits, calls = [], iter([RuntimeError("HTTP 429"), RuntimeError("Rate_Limit: Temporarily"), {"text": "x"}])

    def client(prompt):
        answer = next(calls)
        if isinstance(answer, Exception):
            raise answer
        return answer

    assert generate.called(client, "p", 4, 8.0, waits.append) == {"text": "x"} and waits == [8.0, 16.0]
    with pytest.raises(RuntimeError):
        generate.http_client("http://127.0.0.1:9/none", "k", "m", timeout=1)("p")
    usage = [(0, 7, 3, 0), (None, None, 3, None), (0, None, 5, None), (5, None, None, None), (None, 0, 4, 2), (None,) * 4]
    names = ("input_tokens", "prompt_tokens", "output_tokens", "completion_tokens")
    rows = spark.createDataFrame([(u,) for u in usage] + [(None,)], "usage struct<input_tokens:bigint,prompt_tokens:bigint,output_tokens:bigint,completion_tokens:bigint>")
    want = [generate.counted(dict(zip(names, u))) for u in usage] + [(None, None)]
    assert [tuple(r) for r in rows.select(*generate.token_counts()).collect()] == want == [(7, 3), (None, 3), (None, 5), (5, None), (0, 4), (None, None), (None, None)]
    odd = spark.createDataFrame([(("x", "4"),), (("3", "4"),)], "usage struct<input_tokens:string,output_tokens:string>")
    assert [tuple(r) for r in odd.select(*generate.token_counts(have=("input_tokens", "output_tokens"))).collect()] == [(None, None), (3, 4)]
    assert generate.counted({"input_tokens": "x", "output_tokens": 4}) == (None, None)
    out = spark.createDataFrame([(" x ", None), (None, [("m", [("output_text", "a"), ("other", "b"), ("output_text", "c")])])], "o string, p array<struct<type:string,content:array<struct<type:string,text:string>>>>")
    assert [r[0] for r in out.select(generate.output_text("o", "p")).collect()] == ["x", "a\nc"]


def test_trace(spark):
    good = json.dumps({"anchor": "x", "aae_output": "He finna go", "applied_features": [{"id": "f", "span_before": "is going to", "span_after": "Finna"}, 3], "rejected_candidates": "no", "notes": None})
    rows = spark.createDataFrame([("t1", "a", "He is going to go", "AAE", f"```json\n{good}\n```"), ("t2", "a", "cam", "AAE", "no json"), ("t3", "a", "pationt", "AAE", 'x {"aae_output": "patient"} y'), ("t4", "a", None, None, None)], "trace_id string, anchor_id string, anchor_text string, dialect_family string, raw_output string")
    done = trace.traced(rows)
    got = {r.trace_id: r for r in done.collect()}
    assert [got[k].generation_status for k in ("t1", "t2", "t3", "t4")] == ["ok", "parse_error", "needs_review_student_text_correction", "parse_error"]
    assert got["t1"].candidate_response == "He finna go" and len(got["t1"].parsed_output.applied) == 1 and got["t3"].detected_student_corrections == ["pationt -> patient"]
    assert tuple(trace.summary(done).first()) == (4, 3, 1, 1)
    lines = [r.line for r in reports.trace_report(done, trace.summary(done)).orderBy(*reports.ORDER).collect()]
    assert lines[0] == "# Trace comparison" and "- Status: `parse_error`" in lines


def test_traced_generation(spark):
    anchors = spark.createDataFrame([("a", "cam home"), ("b", "fine")], "essay_id string, text string")
    asked = spark.createDataFrame([("a", FAMILIES[0]), ("b", FAMILIES[1]), ("b", FAMILIES[1]), ("x", FAMILIES[0])], "anchor_id string, dialect_family string")
    flow = Flow(INVENTORY, "{ANCHOR_RESPONSE} {OUTPUT_KEY}", "v1", lambda: lambda p: {"id": "1", "text": json.dumps({p.split()[-1]: "came home"})}, "m", ["essay_id"])
    first = flow.traced(anchors, asked, limit=1)
    assert [(r.trace_id, r.candidate_response, r.generation_status) for r in first.collect()] == [("a_Southern_American_English_trace", "came home", "needs_review_student_text_correction")]
    both = flow.traced(anchors, asked, done=first)
    assert sorted(r.anchor_id for r in both.collect()) == ["a", "b"] and flow.traced(anchors, asked.limit(0)).count() == 0
    assert trace.read_answer("[1]")["error"] == "json_decode_error: parsed output is not an object" and trace.read_answer("x {y} z")["error"].startswith("json_decode_error after substring extraction: ")
    bare = trace.with_corrections(first.withColumn("detected_student_corrections", F.array().cast("array<string>")), ["cam"])
    assert bare.first().detected_student_corrections == ["cam -> came"]
    keys = spark.createDataFrame([("Gulf-Coast (South)",), ("AAE",)], "f string").select(trace.output_key("f"))
    assert [r[0] for r in keys.collect()] == ["gulf-coast_(south)_output", "aae_output"]


def test_ratios_of_long_runs():
    """Equal runs of 7 to 17 characters and more, at either end of a text or within, which eight characters at a time must not change."""
    assert hex(audit._eights(np.frombuffer(b"abc", dtype=np.uint8), 1)[0]) == "0x6362" and hex(audit._eights(np.frombuffer(b"abcdefghij", dtype=np.uint8), -1)[9]) == "0x6263646566676869"
    filler = "the tea on the table and then a tin on a hat " * 5
    for n in (*range(1, 20), 40):
        for run in ("q" + "ab" * n, "ab" * n + "q", ("ab" * n)[:n] + "qz" + ("ba" * n)[:n]):
            first = ["", run, run + filler, filler + run, filler[:90] + run + filler[90:], run + filler + run, "x" + run]
            for second in (filler + run, run + filler, filler[:50] + run + filler[50:]):
                assert audit.Firsts(first).ratios(audit.Second(second)).tolist() == [SequenceMatcher(None, x, second).ratio() for x in first]


def test_block_ratios(spark):
    """All alignments of two blocks are made in the JVM, equal to SequenceMatcher's, a million of long texts in seconds."""
    import random
    import time

    from variantloom.functions.compiled import block_ratios

    random.seed(7)

    def called(x, y, same, least):
        df = spark.createDataFrame([("\n".join(x), "\n".join(y))], "x string, y string")
        return df.select(block_ratios(spark, F.col("x"), F.col("y"), F.lit(same), least)).first()[0]

    for letters in ("abcdefghijklmnopq", "abczq'", "eeeeeettttaaaoooniisshhrrddlcumwfgypbvkxjqz"):
        words = ["".join(random.choice(letters) for _ in range(random.randint(1, 7))) for _ in range(50)]
        texts = [" ".join(random.choice(words) for _ in range(random.choice((3, 30, 60, 150)))) for _ in range(30)] + ["", "a", "zq" * 150, "e" * 300, "q" + "e" * 300]
        texts += [t[: len(t) // 3] + "q" + t[len(t) // 3 :] for t in texts[:6]] + [t[len(t) // 3 :] + t[: len(t) // 3] for t in texts[:6]]
        brute = [[SequenceMatcher(None, x, y).ratio() for y in texts] for x in texts]
        n = len(texts)
        for half in (n, n // 2):  # one block, two blocks
            first, second = texts[:half], texts[half:] or texts
            shift = 0 if half == n else half
            pairs = [(i, j) for i in range(half) for j in range(i + 1 if half == n else 0, len(second))]
            for least in (0.0, 0.3, 0.985, float("inf")):
                got = called(first, second, half == n, least)
                both = lambda i, j: (brute[i][j + shift], brute[j + shift][i])  # noqa: B023, E731
                assert got[:n] == [max(brute[i][j] for j in range(n) if j != i and (half == n or (i < half) != (j < half))) for i in range(n)]
                assert [tuple(got[k : k + 4]) for k in range(n, len(got), 4)] == [(i, j, *both(i, j)) for i, j in pairs if max(both(i, j)) >= least]
    assert called(["alone"], ["alone"], True, 0.0) == [-1.0] and called([""], ["a"], False, 0.0) == [0.0, 0.0, 0.0, 0.0, 0.0, 0.0]

    words = ["".join(random.choice("eeeeeettttaaaoooniisshhrrddlcumwfgypbvkxjqz") for _ in range(random.randint(1, 9))) for _ in range(900)]
    many = [" ".join(random.choice(words) for _ in range(110)) for _ in range(1000)]
    began = time.time()
    assert len(called(many, many, True, 0.985)) == 1000 and time.time() - began < 20


def test_audit_carries_what_is_asked_for(spark):
    from variantloom.session import spread

    rows = _audited(spark, [("c1", "a", 1, "X", "one two three", "one two four", ["z"], 1, ["old"], True, "e"), ("c2", "a", 2, "X", "one two three", "one two five", [], 0, None, True, "e")])
    whole, some = audit.audit(rows), audit.audit(rows, carried=["candidate_id", "rejection_reasons"])
    assert {*rows.columns} <= {*whole.columns} and {"x_extra", "anchor_response", "dialect_family"}.isdisjoint(some.columns)
    assert sorted(whole.select(*some.columns).collect()) == sorted(some.collect())

    # rows that were spread stay where they are; few partitions are not many
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(spread(spread(rows).withColumn("y", F.upper("x_extra")))).count("Repartition") == 1
    assert "Repartition" in plan(spread(rows.coalesce(10_000))) and ", true" in plan(spread(rows.coalesce(10_000)))


def test_hot_anchor_retries_and_order(spark):
    """One anchor holds half of all rows: numbers, selections and prompts stay right and prompts stay short."""
    rows = [(f"c{k:03}", "hot" if k % 2 else f"a{k}", k, "word " * 12 + str(k), ["r"] if k == 99 else [], k != 99, k / 200) for k in range(200)]
    df = spark.createDataFrame(rows, "candidate_id string, anchor_id string, candidate_index int, candidate_response string, rejection_reasons array<string>, passed_quality_filter boolean, quality_score double")
    df = df.withColumn("student_text_corrections", F.array().cast("array<string>"))
    jobs = df.select(F.col("candidate_id").alias("job_id"), "anchor_id", F.lit("f").alias("dialect_family"), "candidate_index", F.lit("v").alias("prompt_version"), F.lit("p").alias("generation_prompt"))
    todo = records.to_retry(df, ["r"])
    prompt = generate.retry_prompts(todo, jobs, df).first().generation_prompt
    assert [int(x.split()[-1]) for x in prompt.split("\n") if x.startswith("- ")] == [91, 93, 95, 97, 101, 103, 105, 107]
    assert generate.sibling_rows(todo, df).count() == 99
    best = records.best_of_each(df, 2).where("anchor_id = 'hot'").collect()
    assert sorted(r.selected_reason for r in best) == ["rank 1/99 for anchor hot", "rank 2/99 for anchor hot"] and {r.candidate_id for r in best} == {"c199", "c197"}
    placed = order.numbered_in_turn(df.repartition(7), ["anchor_id"], ["candidate_index"], "i", "n").collect()
    assert [r.n for r in sorted(placed, key=lambda r: r.candidate_index)] == list(range(200)) and sorted(r.i for r in placed if r.anchor_id == "hot") == list(range(100))
    ties = spark.createDataFrame([("1", ["z", "a"]), ("2", ["a", "z"])], "candidate_id string, rejection_reasons array<string>").withColumn("passed_quality_filter", F.lit(False))
    assert [tuple(r) for r in records.reason_tally(ties).collect()] == [("z", 2), ("a", 2)]


def test_workers_need_no_source_folder(tmp_path):
    """Spark started in another folder, with the package on the driver's path only."""
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from variantloom.functions.alignment import align
from variantloom.operators import audit, generate, trace
from variantloom.plans.fixture import offline_client
print(spark.createDataFrame([("a b", "a c")], "x string, y string").select(align(F.col("x"), F.col("y"))["changed_words"]).first()[0])
rows = spark.createDataFrame([("a", "c1", 1, "f", "one two", "one three"), ("a", "c2", 2, "f", "one two", "one four")], "anchor_id string, candidate_id string, candidate_index int, dialect_family string, anchor_response string, candidate_response string")
rows = rows.withColumns({{"detected_features": F.array().cast("array<string>"), "feature_realization_count": F.lit(0), "rejection_reasons": F.array().cast("array<string>"), "passed_quality_filter": F.lit(True)}})
print(audit.audit(rows).count(), trace.traced(spark.createDataFrame([("x", "f", "no")], "anchor_text string, dialect_family string, raw_output string")).first().generation_status)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=150)
    assert out.stdout.split() == ["2", "2", "parse_error"], out.stderr[-2000:]


def test_repair(spark):
    raw = spark.createDataFrame([("1", "over there now, right?", "x"), ("2", "fine", "fine")], "candidate_id string, candidate_response string, raw_output string")
    flags = spark.createDataFrame([("1", "over ther now", ["ther -> there"])], "candidate_id string, anchor_response string, student_text_corrections array<string>")
    got = {r.candidate_id: (r.candidate_response, r.mechanical_cleanup_repairs) for r in repair.repaired(raw, flags).collect()}
    assert got == {"1": ("over ther now, right?", ["ther -> there"]), "2": ("fine", [])}


def test_report(spark, tmp_path):
    rows = spark.createDataFrame([("b", "f", 2, "c2", "ok", "m", "two"), ("b", "f", 1, "c1", "ok", "m", None), ("a", "g", 1, "c3", None, "m", "x")], "anchor_id string, dialect_family string, candidate_index int, candidate_id string, generation_status string, model string, candidate_response string")
    about = spark.createDataFrame([("a", "text", "HIGH")], "anchor_id string, anchor_response string, score_band string")
    path = tmp_path / "r.md"
    files.write_lines(reports.candidate_report(rows, about), str(path), reports.ORDER, bom=True)
    lines = path.read_text(encoding="utf-8-sig").split("\n")
    assert path.read_bytes()[:3] == b"\xef\xbb\xbf"
    assert [x for x in lines if x.startswith("#")] == ["# Candidate review", "## Anchor a", "### Candidate 1 - g", "## Anchor b", "### Candidate 1 - f", "### Candidate 2 - f"]
    assert "- Score band: HIGH" in lines and lines.count("[EMPTY]") == 2


def test_flow(spark):
    rows = spark.createDataFrame([(f"a{k}", f"the text number {k} has some words in it for all to see and read", "low") for k in range(4)], "essay_id string, text string, score_band string")
    flow = Flow(INVENTORY, PLAIN_TEMPLATE, "v1", offline_client, "offline", ["essay_id"], candidates=2)
    out = flow.run(rows, top=1)
    assert out["jobs"].count() == out["raw"].count() == out["scored"].count() == 8
    again = flow.generated(out["jobs"], out["raw"].limit(3))
    assert again.count() == 8
    failed = out["raw"].withColumn("candidate_response", F.when(F.col("candidate_index") == 1, "FAIL").otherwise(F.col("candidate_response")))
    flow.failure_note, flow.make_client = "Try once more.", lambda: lambda p: {"id": None, "text": "noted" if "Try once more." in p else "plain", "usage": None}
    assert {r.candidate_response for r in flow.generated(out["jobs"], failed).where("candidate_index = 1").collect()} == {"noted"}
    flow.make_client = offline_client
    brought = out["raw"].withColumn("anchor_response", F.when(F.col("candidate_index") == 1, "its own text"))
    assert {r.anchor_response == "its own text" for r in flow.judged(rows, brought).where("candidate_index = 1").collect()} == {True} and flow.judged(rows, brought).where("anchor_response like 'the text%'").count() == 4
    after = flow.retry(rows, out["jobs"], out["raw"], out["scored"], limit=2)
    assert after["raw"].count() == 8 and after["raw"].where("retry_of_candidate_id is not null").count() == 2
