"""Traced generation: prompts that ask for JSON, and the answers read back."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variantloom.functions.alignment import align
from variantloom.functions.text import first_filled, replaced, strip, text
from variantloom.operators.anchors import anchor_text, identifier, last_of_each, trace_id
from variantloom.operators.generate import asked
from variantloom.operators.records import head, remaining
from variantloom.session import cut, ship, spread

# Key under which a family's text stands in a traced answer, by full and short names.
OUTPUT_KEYS = {
    "southern": "southern_output", "southern american english": "southern_output",
    "midwestern": "midwestern_output", "midwestern/north central": "midwestern_output",
    "northeastern": "northeastern_output", "northeastern/new england": "northeastern_output",
    "western": "western_output", "western american english": "western_output",
    "appalachian": "appalachian_output", "appalachian english": "appalachian_output",
    "aae": "aae_output", "african american english (aae)": "aae_output",
}
PARSED = "struct<ok:boolean,error:string,members:int,output:map<string,string>,applied:array<struct<id:string,span_before:string,span_after:string>>,rejected:array<struct<id:string,reason:string>>,notes:string>"
_FENCE = re.compile(r"^```(?:json)?\s*|\s*```$", re.I)
TRACED = "trace_id string, raw_output string, openai_response_id string, usage string, error string, started_at string, finished_at string"


def output_key(family: str | Column) -> Column:
    """The family's key; an unknown family gives its trimmed name in lower case, spaces and slashes as ``_``, and ``_output``."""
    low = strip(F.lower(text(family)))
    table = F.create_map(*(F.lit(x) for kv in OUTPUT_KEYS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, low), F.concat(F.translate(low, " /", "__"), F.lit("_output")))


def trace_prompt(template: str, anchor: str | Column, family: str | Column, inventory_json: str | Column) -> Column:
    return replaced(template, [("{ANCHOR_RESPONSE}", anchor), ("{DIALECT_FAMILY}", family), ("{OUTPUT_KEY}", output_key(family)), ("{FEATURE_INVENTORY_JSON}", inventory_json)])


def parsed(raw: str | Column) -> Column:
    """A traced answer read strictly: a struct of :data:`PARSED`.

    Fences around the answer are taken off; if it is no JSON then, the widest ``{...}`` in it is tried. What
    is no object gives an error. Members of other types are kept as JSON text; those that are not lists or
    objects where such are due count as empty.
    """
    ship()
    return F.pandas_udf(lambda s: pd.DataFrame([read_answer(x) for x in s], columns=["ok", "error", "members", "output", "applied", "rejected", "notes"]), PARSED)(F.col(raw) if isinstance(raw, str) else raw)


def read_answer(raw: str | None) -> dict:
    bare = _FENCE.sub("", (raw or "").strip()).strip()
    value, error = None, None
    try:
        value = json.loads(bare)
    except ValueError as first:
        inner = re.search(r"\{.*\}", bare, re.S)
        if inner is None:
            error = f"json_decode_error: {first}"
        else:
            try:
                value = json.loads(inner.group())
            except ValueError as second:
                error = f"json_decode_error after substring extraction: {second}"
    if error is None and not isinstance(value, dict):
        error = "json_decode_error: parsed output is not an object"
    if error is not None:
        return {"ok": False, "error": error, "members": 0, "output": {}, "applied": [], "rejected": [], "notes": ""}
    shown = lambda v: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    listed = lambda k, names: [{n: (None if x.get(n) is None else shown(x[n])) for n in names} for x in (value.get(k) if isinstance(value.get(k), list) else []) if isinstance(x, dict)]
    return {
        "ok": True, "error": None, "members": len(value), "output": {str(k): v for k, v in value.items() if isinstance(v, str)},
        "applied": listed("applied_features", ("id", "span_before", "span_after")), "rejected": listed("rejected_candidates", ("id", "reason")), "notes": shown(value.get("notes") or ""),
    }


def spans(applied: str | Column) -> Column:
    """Distinct spans (before and after) of applied features, lower case and trimmed."""
    a = F.col(applied) if isinstance(applied, str) else applied
    both = F.flatten(F.transform(a, lambda x: F.array(x["span_before"], x["span_after"])))
    return F.array_distinct(F.filter(F.transform(both, lambda s: strip(F.lower(s))), lambda s: s.isNotNull() & (s != "")))


def traced_text(parsed_output: str, family: str | Column, *fallback: str) -> Column:
    """The family's text of a traced answer, else the first filled fallback; trimmed."""
    return strip(text(F.coalesce(F.try_element_at(F.col(f"{parsed_output}.output"), output_key(family)), first_filled(*fallback, F.lit("")))))


def traced(answers: DataFrame, known: list[str] = ()) -> DataFrame:
    """Adds ``parsed_output``, ``candidate_response``, ``detected_student_corrections``, ``generation_status`` and ``parse_error``.

    ``answers`` has ``anchor_text``, ``dialect_family`` and ``raw_output``. Respellings are looked for only in
    answers that could be read and have a member; with known forms only those count.
    """
    rows = spread(answers).withColumn("parsed_output", parsed("raw_output"))
    rows = rows.withColumn("candidate_response", traced_text("parsed_output", "dialect_family", "raw_output"))
    found = align(F.col("anchor_text"), F.col("candidate_response"), spans=spans("parsed_output.applied"), known=F.array(*map(F.lit, known)).cast("array<string>"), chars="none")["corrections"]
    rows = rows.withColumn("detected_student_corrections", F.when(F.col("parsed_output.members") > 0, found).otherwise(F.array().cast("array<string>")))
    status = F.when(~F.col("parsed_output.ok"), "parse_error").when(F.size("detected_student_corrections") > 0, "needs_review_student_text_correction").otherwise("ok")
    return rows.withColumns({"generation_status": status, "parse_error": F.col("parsed_output.error")})


def jobs(assignments: DataFrame, anchors: DataFrame, families: DataFrame, template: str, version: str, order: list[str], limit: int | None = None, done: DataFrame | None = None) -> DataFrame:
    """What is left to trace: ``trace_id``, ``anchor_id``, ``dialect_family``, ``output_key``, ``prompt_version``, ``anchor_text``, ``prompt``.

    The first ``limit`` assignments in ``order`` count, before those whose trace ``done`` holds are taken out.
    Of repeated anchors the last in the order of all their columns counts. Assignments whose anchor or family
    is unknown give none; see :func:`variantloom.operators.assign.unmatched`.
    """
    first = head(assignments.where("anchor_id is not null and dialect_family is not null"), limit, order)
    first = first.select("anchor_id", "dialect_family", trace_id(F.col("anchor_id"), F.col("dialect_family")).alias("trace_id")).distinct()
    left = first if done is None else remaining(first, done, "trace_id")
    kept = last_of_each(anchors, identifier(anchors, strict=False), sorted(anchors.columns)).select("_key", "_row.*")
    about = kept.select(F.col("_key").alias("anchor_id"), anchor_text(kept).alias("anchor_text"))
    rows = left.join(about, "anchor_id").join(families.select("dialect_family", "inventory_json"), "dialect_family")
    return rows.select("trace_id", "anchor_id", "dialect_family", output_key("dialect_family").alias("output_key"), F.lit(version).alias("prompt_version"), "anchor_text", trace_prompt(template, "anchor_text", "dialect_family", "inventory_json").alias("prompt"))


def generate(
    todo: DataFrame, make_client: Callable[[], Callable[[str], dict]], model: str, known: list[str] = (), done: DataFrame | None = None, attempts: int = 1, wait: float = 0.0, pause: float = 0.0,
) -> DataFrame:
    """Traced records of :func:`jobs`, after those of ``done``. Calls are made once, as their result is written before it is read."""
    ship(todo.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            rows = []
            for job in batch.itertuples(index=False):
                said, answer, error, begun, ended = asked(client, job.prompt, attempts, wait)
                rows.append((job.trace_id, said, answer.get("id"), answer.get("usage"), error, begun, ended))
                if pause > 0:
                    time.sleep(pause)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TRACED.split(", ")])

    todo = cut(todo)
    said = cut(todo.select("trace_id", "prompt").mapInPandas(run, TRACED))
    made = traced(todo.drop("prompt").withColumn("model", F.lit(model)).join(said, "trace_id"), known)
    made = made.withColumn("generation_status", F.when(F.col("error").isNotNull(), F.lit("api_error")).otherwise(F.col("generation_status")))
    return made if done is None else done.unionByName(made, allowMissingColumns=True)


def with_corrections(rows: DataFrame, known: list[str] = ()) -> DataFrame:
    """``rows`` whose ``detected_student_corrections`` are the stored ones, or where there are none and known forms are given, those found anew."""
    stored = F.coalesce("detected_student_corrections", F.array().cast("array<string>")) if "detected_student_corrections" in rows.columns else F.array().cast("array<string>")
    if not known:
        return rows.withColumn("detected_student_corrections", stored)
    found = align(F.col("anchor_text"), traced_text("parsed_output", "dialect_family", "candidate_response", "raw_output"), spans=spans("parsed_output.applied"), known=F.array(*map(F.lit, known)), chars="none")["corrections"]
    return rows.withColumn("detected_student_corrections", F.when(F.size(stored) > 0, stored).otherwise(found))


def summary(rows: DataFrame) -> DataFrame:
    """One row: ``records``, ``changed``, ``applied_features`` and ``with_corrections`` of traced rows."""
    changed = strip(text("candidate_response")) != strip(text("anchor_text"))
    return rows.agg(F.count("*").alias("records"), F.count_if(changed).alias("changed"), F.coalesce(F.sum(F.size("parsed_output.applied")), F.lit(0)).alias("applied_features"), F.count_if(F.size("detected_student_corrections") > 0).alias("with_corrections"))
