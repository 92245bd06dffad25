"""Files in and out, inventories, streams, queries and SQL."""

import json

import pytest

from variantloom.sources import inventory as inv
from variantloom.sources import records as files
from variantloom.streaming import ingest


def test_csv(spark, tmp_path):
    path = tmp_path / "a.CSV"
    path.write_bytes('﻿id,text,n\n1,"two\nlines, ""quoted""",\n2,,3\n'.encode())
    rows = files.read_records(spark, str(path)).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", 'two\nlines, "quoted"', ""), ("2", "", "3")]


def test_jsonl(spark, tmp_path):
    rows = spark.createDataFrame([("é", 1, None)], "b string, a int, c string")
    files.write_jsonl(rows, str(tmp_path / "o"))
    line = "".join(p.read_text() for p in (tmp_path / "o").glob("part*"))
    assert line.isascii() and list(json.loads(line)) == ["a", "b", "c"]
    (tmp_path / "in.jsonl").write_text('﻿{"a": 1}\n\n{"a": 2}\n')
    assert files.read_jsonl(spark, str(tmp_path / "in.jsonl"), "a int").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\nnot json\n')
    assert [(r.number, r.line) for r in files.bad_lines(spark, str(tmp_path / "bad.jsonl")).collect()] == [(2, "not json")]
    with pytest.raises(ValueError, match="line 2"):
        files.read_checked_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int")
    assert files.read_checked_jsonl(spark, str(tmp_path / "in.jsonl"), "a int").count() == 2
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    assert files.page(spark.range(5).toDF("id"), 2, 2)[0].id == 2


def test_env(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# x\nVL_A='one'\nVL_B=two\nbad\n")
    monkeypatch.setenv("VL_B", "kept")
    monkeypatch.delenv("VL_A", raising=False)
    assert files.load_env(str(tmp_path / ".env")) == {"VL_A": "one"} and files.load_env(str(tmp_path / "none")) == {}


def test_small_sources(spark, tmp_path, monkeypatch):
    monkeypatch.delenv("VL_KEY", raising=False)
    (tmp_path / ".env").write_text("VL_KEY=abc\n")
    with pytest.raises(ValueError):
        files.required_key("VL_KEY")
    assert files.required_key("VL_KEY", str(tmp_path / ".env")) == "abc"
    (tmp_path / "empty.jsonl").write_text("\n")
    with pytest.raises(ValueError):
        files.browsed(spark, str(tmp_path / "empty.jsonl"), "a int")
    (tmp_path / "t.txt").write_bytes("\ufeffA {PROMPT}".encode())
    assert files.read_template(str(tmp_path / "t.txt")) == "A {PROMPT}"
    assert inv.marker_table(spark, {"X": {"features": [{"id": "x_double_modal", "feature": "two", "allowed_for_generation": True}]}}).count() == 4


def test_inventory(spark, tmp_path):
    feature = {"id": "f", "category": "lexical", "feature": "y'all", "description": "you", "blocked_context": "none", "source_reference": "s", "allowed_for_generation": True}
    (tmp_path / "x.json").write_text(json.dumps({"dialect_family": "X", "review_status": "draft", "features": [feature], "disallowed_features": ["d"], "safety_notes": ["n"]}))
    (tmp_path / "f.index.json").write_text(json.dumps({"X": "x.json"}))
    got = inv.load(str(tmp_path / "f.index.json"))
    assert inv.described(got["X"]) == "Lexical features: y'all (you) Avoid: none\nReview status: draft"
    assert inv.warned(got["X"]).startswith("Disallowed features: d\nSafety notes: n\nDraft status: draft")
    old = {b: [] for b in inv.buckets()} | {"allowed_lexical_features": ["a", "b"], "usage_notes": ["u"], "needs_linguist_review": True}
    assert inv.labels(old) == ["a", "b"] and inv.described(old) == "Lexical features: a; b\nUsage notes: u"
    for bad in ({"features": 3}, {"features": [{"id": "x"}]}, {"features": [{**feature, "category": "other"}]}, {"allowed_lexical_features": []}):
        with pytest.raises(ValueError):
            inv.check("X", bad)
    (tmp_path / "g.index.json").write_text(json.dumps({"Y": "x.json"}))
    with pytest.raises(ValueError):
        inv.load(str(tmp_path / "g.index.json"))
    rows = spark.createDataFrame([("a", "odd", "f", True)], "id string, category string, feature string, allowed_for_generation boolean")
    with pytest.raises(Exception):
        inv.checked(rows).collect()


def test_stream(spark, tmp_path):
    schema = "candidate_id string, finished_at string, v int"
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for k in range(2):
        (source / f"{k}.json").write_text("\n".join(json.dumps({"candidate_id": i, "finished_at": "2031-01-01T00:00:00Z", "v": k}) for i in ("a", "b", None)))
    for _ in range(2):
        stream = ingest.arriving(spark, str(source), schema, files_per_trigger=1)
        ingest.into(ingest.once(stream, "candidate_id", "finished_at"), target, str(tmp_path / "ck"), lambda b: b.select("candidate_id", "v")).awaitTermination(120)
    assert sorted(r.candidate_id for r in spark.read.parquet(target).collect()) == ["a", "b"]


def test_queries_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    import os

    import __spark_entry__

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)
    for name in sql:
        rows = queries[name](spark, folder)
        got = con.execute(sql[name])
        columns = [c[0] for c in got.description]
        assert sorted(columns) == sorted(rows.columns), name
        want = sorted(repr(tuple(r[columns.index(c)] for c in sorted(columns))) for r in got.fetchall())
        assert sorted(repr(tuple(r[c] for c in sorted(columns))) for r in rows.collect()) == want, name
    assert __spark_entry__.entry(spark).count() > 0
