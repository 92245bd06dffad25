"""Generation behind an injected client, and what comes back: texts, token counts, records, retries."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variantloom.functions.text import first_filled, strip, text
from variantloom.operators.anchors import candidate_id
from variantloom.operators.order import numbered_within
from variantloom.session import ship

RECORD = "candidate_id string, anchor_id string, dialect_family string, candidate_index int, prompt_version string, model string, generation_status string, candidate_response string, raw_output string, openai_response_id string, tokens_in bigint, tokens_out bigint, usage string, error string, started_at string, finished_at string, source_job_id string"
# Parts of an error message after which a call is worth repeating.
PASSING_TROUBLE = ("429", "rate_limit", "temporarily")


def output_text(output: str | Column, parts: str | Column) -> Column:
    """Text of a model's answer: ``output_text`` where it is filled, else the ``output_text`` parts of ``output[].content[]``, a line each; trimmed."""
    o, p = (F.col(c) if isinstance(c, str) else c for c in (output, parts))
    pieces = F.flatten(F.transform(p, lambda x: F.coalesce(x["content"], F.array().cast("array<struct<type:string,text:string>>"))))
    said = F.transform(F.filter(pieces, lambda x: (x["type"] == "output_text") & (F.coalesce(x["text"], F.lit("")) != "")), lambda x: x["text"])
    return strip(F.coalesce(first_filled(o), F.array_join(said, "\n"), F.lit("")))


def token_counts(usage: str = "usage", names: tuple[str, ...] = ("input_tokens", "prompt_tokens", "output_tokens", "completion_tokens"), have: tuple[str, ...] | None = None) -> tuple[Column, Column]:
    """Tokens in and out of a usage struct.

    A missing count or a 0 falls through to the other name, and is null where that is missing too (a 0 of the
    other name stays); one count may be there without the other. Both are null if one of them is no integer.
    """
    there = have or names
    raw = lambda n: F.expr(f"CAST({usage}.{n} AS string)") if n in there else F.lit(None).cast("string")
    whole = lambda c: c.try_cast("double").cast("bigint")
    void = lambda c: F.coalesce(c.try_cast("double") == 0, c == "", F.lit(False))
    told = lambda a, b: F.when(raw(a).isNull() | void(raw(a)), raw(b)).otherwise(raw(a))
    into, out = told(names[0], names[1]), told(names[2], names[3])
    good = F.coalesce(whole(into).isNotNull() | into.isNull(), F.lit(False)) & F.coalesce(whole(out).isNotNull() | out.isNull(), F.lit(False))
    return F.when(good, whole(into)), F.when(good, whole(out))


def counted(usage: dict | None) -> tuple[int | None, int | None]:
    """The same of a usage that was read from JSON."""
    usage = usage if isinstance(usage, dict) else {}
    told = [usage.get(a) or usage.get(b) for a, b in (("input_tokens", "prompt_tokens"), ("output_tokens", "completion_tokens"))]
    try:
        into, out = (None if v is None else int(v) for v in told)
    except (TypeError, ValueError):
        return None, None
    return into, out


# The note on attempts that follows a job's prompt.
ATTEMPT = "\n\nCandidate attempt: {} of {}.\n"
ANOTHER = "If more than one valid rewrite is possible, choose a natural rewrite that is not identical to the other attempts, while still following every rule above."


def attempt_prompt(prompt: str | Column, index: str | Column, total: int | Column | None = 3) -> Column:
    """The prompt with a note which of how many candidates this is. A null or zero total counts as 3, a null index as 1."""
    n = total if isinstance(total, Column) else F.lit(total)
    i = F.coalesce(F.col(index) if isinstance(index, str) else index, F.lit(1))
    before, between, after = ATTEMPT.split("{}")
    return F.concat(text(prompt), F.lit(before), i.cast("string"), F.lit(between), F.coalesce(F.nullif(n.cast("int"), F.lit(0)), F.lit(3)).cast("string"), F.lit(after + ANOTHER))


def noted(prompt: str | Column, condition: Column, note: str) -> Column:
    """The prompt, with a note where the condition holds."""
    return F.when(F.coalesce(condition, F.lit(False)), F.concat(text(prompt), F.lit("\n\n" + note))).otherwise(text(prompt))


def http_client(url: str, key: str, model: str, timeout: float = 120.0, **options) -> Callable[[str], dict]:
    """A client that posts ``{"model", "input", **options}`` as JSON; whatever goes wrong on the way is a RuntimeError with the answer's text.

    For use in ``make_client``, so that the key is read where the task runs: ``lambda: http_client(url, os.environ["KEY"], model)``.
    """

    def post(prompt: str) -> dict:
        body = json.dumps({"model": model, "input": prompt} | {k: v for k, v in options.items() if v is not None}).encode()
        request = urllib.request.Request(url, body, {"Authorization": f"Bearer {key}", "Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as reply:
                answer = json.loads(reply.read())
        except urllib.error.HTTPError as error:
            raise RuntimeError(f"HTTP {error.code}: {error.read().decode(errors='replace')}") from error
        except (urllib.error.URLError, TimeoutError, ValueError) as error:
            raise RuntimeError(str(error)) from error
        said = answer.get("output_text") or "\n".join(p.get("text", "") for o in answer.get("output") or [] for p in o.get("content") or [] if p.get("type") == "output_text")
        return {"id": answer.get("id"), "text": said, "usage": json.dumps(answer.get("usage"))}

    return post


def called(client: Callable[[str], dict], prompt: str, attempts: int = 1, wait: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The client's answer; passing trouble is waited out, ``wait`` times the attempt's number. The last error is raised."""
    for k in range(1, attempts + 1):
        try:
            return client(prompt)
        except RuntimeError as error:
            if k == attempts or not any(part in str(error).lower() for part in PASSING_TROUBLE):
                raise
            sleep(wait * k)
    raise ValueError("attempts must be 1 at least")


def generate(
    jobs: DataFrame, make_client: Callable[[], Callable[[str], dict]], model: str, status: str = "demo_unvalidated", attempts: int = 1, wait: float = 0.0, pause: float = 0.0, total: int | None = None,
) -> DataFrame:
    """A record for each job (``job_id``, ``anchor_id``, ..., ``generation_prompt``).

    The client is sent the job's prompt with the note of :func:`attempt_prompt`; ``total`` is the number of
    candidates, by default the job's ``target_candidates``, else 3. ``make_client`` is called once a task and
    gives a function from a prompt to ``{"id", "text", "usage"}`` (usage as JSON). A call that fails for good
    gives a record of status ``api_error`` instead of ending the job. The result should be written before it
    is used, as calls differ from time to time and cost money.
    """
    ship(jobs.sparkSession)
    many = F.lit(total) if total else (F.col("target_candidates") if "target_candidates" in jobs.columns else F.lit(3))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            rows = []
            for job in batch.itertuples(index=False):
                said, answer, error, begun, ended = asked(client, job.sent, attempts, wait)
                into, out = counted(json.loads(answer.get("usage") or "null"))
                rows.append((job.made_id, job.anchor_id, job.dialect_family, job.candidate_index, job.prompt_version, model, "api_error" if error else status, said, said, answer.get("id"), into, out, answer.get("usage"), error, begun, ended, job.job_id))
                if pause > 0:
                    time.sleep(pause)
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])
            yield frame.astype({"tokens_in": "Int64", "tokens_out": "Int64"})

    made_id = candidate_id(jobs)
    sent = jobs.select(made_id.alias("made_id"), "job_id", "anchor_id", "dialect_family", F.coalesce("candidate_index", F.lit(1)).cast("int").alias("candidate_index"), text("prompt_version").alias("prompt_version"), attempt_prompt("generation_prompt", "candidate_index", many).alias("sent"))
    return sent.mapInPandas(run, RECORD)


def asked(client: Callable[[str], dict], prompt: str, attempts: int, wait: float) -> tuple[str, dict, str | None, str, str]:
    """Text, answer, error and the times before and after of one call."""
    now = lambda: datetime.now(timezone.utc).isoformat()
    begun, error, answer = now(), None, {}
    try:
        answer = called(client, prompt, attempts, wait)
    except RuntimeError as e:
        error = str(e)
    return (answer.get("text") or "").strip(), answer, error, begun, now()


#: Other answers of its anchor that a retry's prompt shows, those next to it in the order of candidates.
NEAREST = 8


def retry_prompts(todo: DataFrame, jobs: DataFrame, scored: DataFrame, guidance: dict[str, str] | None = None, nearest: int = NEAREST, order: list[str] = ("candidate_index", "candidate_id")) -> DataFrame:
    """Prompts for records to be made anew: the job's prompt, the rejected text, its reasons, respellings and siblings, and guidance by reason.

    A prompt shows ``nearest`` siblings, half of them before and half after the record in its anchor's order;
    :func:`sibling_rows` gives all of them as rows. Each record meets its neighbours by their places, so the
    texts carried grow with the records, not with the square of an anchor. Of repeated ids in ``scored`` one
    row counts. Records without a job are left out; :func:`variantloom.operators.assign.unmatched` names them.
    """
    why = F.coalesce("rejection_reasons", F.array().cast("array<string>"))
    respelt = F.coalesce("student_text_corrections", F.array().cast("array<string>"))
    rows = scored.select("candidate_id", "anchor_id", text("candidate_response").alias("_said"), why.alias("_why"), respelt.alias("_respelt"))
    wanted = todo.select("candidate_id").distinct().join(rows, "candidate_id").dropDuplicates(["candidate_id"])
    order = [c for c in order if c in scored.columns]
    places = numbered_within(scored.select("anchor_id", *dict.fromkeys(["candidate_id", *order])).where("anchor_id is not null and candidate_id is not null"), ["anchor_id"], list(order), "_place").select("anchor_id", "candidate_id", "_place")
    steps = [k for k in range(-(nearest // 2), nearest - nearest // 2 + 1) if k]
    near = wanted.select("candidate_id").join(places, "candidate_id").select("candidate_id", "anchor_id", F.explode(F.array(*(F.col("_place") + k for k in steps)) if steps else F.array().cast("array<bigint>")).alias("_place"))
    near = near.join(places.withColumnRenamed("candidate_id", "_other"), ["anchor_id", "_place"]).where("candidate_id != _other")
    told = rows.select(F.col("candidate_id").alias("_other"), F.col("_said").alias("_also")).dropDuplicates(["_other"])
    near = near.join(told, "_other").groupBy("candidate_id").agg(F.sort_array(F.collect_list(F.struct("_place", "_also"))).alias("_near"))
    whole = wanted.drop("anchor_id").join(near, "candidate_id", "left").join(jobs, F.col("candidate_id") == F.col("job_id"))
    parts = [
        F.col("generation_prompt"), F.lit("The earlier answer was rejected:"), F.col("_said"), F.concat(F.lit("Reasons: "), F.array_join("_why", ", ")),
        F.when(F.size("_respelt") > 0, F.concat(F.lit("Respelt: "), F.array_join("_respelt", "; "))),
        F.when(F.size("_near") > 0, F.concat(F.lit("Other answers to stay apart from:\n"), F.array_join(F.transform("_near", lambda x: F.concat(F.lit("- "), x["_also"])), "\n"))),
        *(F.when(F.array_contains("_why", reason), F.lit(note)) for reason, note in (guidance or {}).items()),
    ]
    return whole.select("job_id", "anchor_id", "dialect_family", "candidate_index", "prompt_version", F.concat_ws("\n\n", *parts).alias("generation_prompt"), F.col("_why").alias("retry_rejection_reasons"), F.col("_respelt").alias("retry_student_text_corrections"))


def sibling_rows(todo: DataFrame, scored: DataFrame) -> DataFrame:
    """``candidate_id`` and ``sibling_id`` of all siblings of the records to be made anew, a row each."""
    rows = scored.select("candidate_id", "anchor_id").where("candidate_id is not null").distinct()
    other = rows.withColumnRenamed("candidate_id", "sibling_id")
    return todo.select("candidate_id").distinct().join(rows, "candidate_id").join(other, "anchor_id").where("candidate_id != sibling_id").select("candidate_id", "sibling_id")


def tagged(made: DataFrame, prompts: DataFrame) -> DataFrame:
    """New records with what they replace and why."""
    why = prompts.select(F.col("job_id").alias("_job"), "retry_rejection_reasons", "retry_student_text_corrections")
    return made.join(why, F.col("source_job_id") == F.col("_job"), "left").drop("_job").withColumn("retry_of_candidate_id", F.col("candidate_id"))
