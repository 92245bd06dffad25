"""Queries of the core on the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variantloom.functions import alignment
from variantloom.functions import similarity as sim
from variantloom.functions import text as tx
from variantloom.operators import anchors as an
from variantloom.operators import assign, audit, generate, records, repair, reports, trace, verdicts
from variantloom.plans import oracle
from variantloom.operators.order import numbered_within
from variantloom.plans.fixture import FAMILIES, INVENTORY, PLAIN_TEMPLATE, TEMPLATE, offline_client
from variantloom.plans.workflow import Flow
from variantloom.session import cut, spread
from variantloom.sources.inventory import CATEGORIES, HABITUAL, family_table, labels, markers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# views -------------------------------------------------------------------------------------------------------
ORDER = ["dataset", "score_band", "text"]


def known_anchors(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Anchors by id, the last of repeated ones, with the columns asked for."""
    rows = table(spark, folder, "anchors")
    return an.last_of_each(rows, an.identifier(rows, strict=False), ORDER, list(columns) or None).select(F.col("_key").alias("key"), "_row.*")


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct candidates with their text."""
    return table(spark, folder, "candidates").select("candidate_id", "anchor_id", "dialect_family", "candidate_index", "candidate_response").distinct()


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates with the text of their anchor ('' without one)."""
    about = known_anchors(spark, folder, "text").select(F.col("key").alias("anchor_id"), F.col("text").alias("anchor_response"))
    return answers(spark, folder).join(about, "anchor_id", "left").withColumn("anchor_response", tx.text("anchor_response"))


_KNOWN = """known AS (SELECT * EXCLUDE (rn), coalesce(nullif(CASE WHEN trim(anchor_id) <> '' THEN anchor_id END, ''), essay_id) AS key FROM (
 SELECT *, row_number() OVER (PARTITION BY coalesce(CASE WHEN trim(anchor_id) <> '' THEN anchor_id END, essay_id)
 ORDER BY dataset DESC NULLS LAST, score_band DESC NULLS LAST, text DESC NULLS LAST) AS rn FROM anchors) WHERE rn = 1)"""
_PAIRS = f"""{_KNOWN}, answers AS (SELECT DISTINCT candidate_id, anchor_id, dialect_family, candidate_index, candidate_response FROM candidates),
pairs AS (SELECT a.*, coalesce(k.text, '') AS anchor_response, coalesce(a.candidate_response, '') AS said FROM answers a LEFT JOIN known k ON a.anchor_id = k.key)"""


def _words(c: str) -> str:
    return rf"len(regexp_extract_all({c}, '\S*[\p{{L}}\p{{N}}_]\S*'))"


def _tokens(c: str) -> str:
    return rf"list_distinct(list_transform(regexp_extract_all({c}, '[\p{{L}}\p{{N}}_]+'), lambda x: lower(x)))"


def _jaccard(a: str, b: str) -> str:
    both = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {both} = 0 THEN 1.0 ELSE len(list_intersect({a}, {b})) / {both} END"


# assignment --------------------------------------------------------------------------------------------------
@query(f"WITH {_KNOWN} SELECT key AS anchor_id, nullif(dataset, '') AS source_corpus, length(coalesce(text, '')) AS n_chars FROM known")
def anchor_keys(spark, folder):
    rows = known_anchors(spark, folder)
    return rows.select(F.col("key").alias("anchor_id"), an.source(rows).alias("source_corpus"), F.length(an.anchor_text(rows)).alias("n_chars"))


_FAMILY_LIST = "[" + ", ".join("'" + f.replace("'", "''") + "'" for f in FAMILIES) + "]"


@query(f"""WITH {_KNOWN}, n AS (SELECT *, row_number() OVER (ORDER BY key) - 1 AS i FROM known)
SELECT key AS anchor_id, {_FAMILY_LIST}[(i % 6 + 1)::INT] AS dialect_family, 3 AS target_candidates, 'greedy' AS assignment_strategy, nullif(dataset, '') AS source_corpus, score_band, domain, i AS position FROM n""")
def assign_greedy(spark, folder):
    rows = known_anchors(spark, folder).withColumn("anchor_id", F.col("key"))
    return assign.greedy(rows, FAMILIES, ["key"])


@query(f"""WITH {_KNOWN}, seen AS (SELECT *, row_number() OVER (ORDER BY key) AS s FROM known),
turn AS (SELECT *, row_number() OVER (PARTITION BY score_band, domain ORDER BY s) AS t, min(s) OVER (PARTITION BY score_band, domain) AS first FROM seen),
n AS (SELECT *, row_number() OVER (ORDER BY t, CASE lower(score_band) WHEN 'low' THEN 0 WHEN 'mid' THEN 1 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 99 END, coalesce(domain, 'None'), first) - 1 AS i FROM turn)
SELECT key AS anchor_id, {_FAMILY_LIST}[(i % 6 + 1)::INT] AS dialect_family, 3 AS target_candidates, 'balanced' AS assignment_strategy, nullif(dataset, '') AS source_corpus, score_band, domain, i AS position FROM n""")
def assign_balanced(spark, folder):
    rows = known_anchors(spark, folder).withColumn("anchor_id", F.col("key"))
    return assign.balanced(rows, FAMILIES, ["key"])


@query("""SELECT DISTINCT anchor_id || '_' || replace(dialect_family, ' ', '_') || '_' || i AS job_id, anchor_id || '_' || replace(replace(dialect_family, ' ', '_'), '/', '_') || '_trace' AS trace_id
FROM (SELECT anchor_id, dialect_family, unnest(range(1, target_candidates + 1)) AS i FROM assignments)""")
def job_ids(spark, folder):
    rows = table(spark, folder, "assignments").where("target_candidates > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("target_candidates"))))
    return rows.select(an.job_id(F.col("anchor_id"), F.col("dialect_family"), F.col("i")).alias("job_id"), an.trace_id(F.col("anchor_id"), F.col("dialect_family")).alias("trace_id")).distinct()


@query(f"""WITH {_KNOWN}, a AS (SELECT DISTINCT anchor_id, dialect_family, coalesce(target_candidates, 3) AS n FROM assignments WHERE dialect_family IN (SELECT unnest({_FAMILY_LIST})))
SELECT a.anchor_id || '_' || replace(dialect_family, ' ', '_') || '_' || i AS job_id, i AS candidate_index,
 md5('Question: ' || CASE WHEN trim(coalesce(prompt, '')) = '' THEN '[PROMPT NOT PROVIDED]' ELSE prompt END || chr(10) || chr(10) || 'Text: ' || coalesce(text, '') || chr(10) || chr(10) || 'Variety: ' || dialect_family) AS prompt_md5
FROM a JOIN known ON a.anchor_id = key, unnest(range(1, n + 1)) AS u(i)""")
def job_prompts(spark, folder):
    families = family_table(spark, INVENTORY).withColumns({"inventory_text": F.lit(""), "notes_text": F.lit("")})
    asked = table(spark, folder, "assignments").select("anchor_id", "dialect_family", "target_candidates").distinct()
    made = assign.jobs(asked, table(spark, folder, "anchors"), families, PLAIN_TEMPLATE, "own_v1", ORDER)
    return made.select("job_id", F.col("candidate_index").cast("bigint").alias("candidate_index"), F.md5("generation_prompt").alias("prompt_md5"))


@query("SELECT DISTINCT anchor_id FROM assignments WHERE anchor_id NOT IN (SELECT essay_id FROM anchors WHERE essay_id IS NOT NULL)")
def unmatched_assignments(spark, folder):
    return assign.unmatched(table(spark, folder, "assignments"), known_anchors(spark, folder, "essay_id").select(F.col("key").alias("anchor_id")), "anchor_id")


# records -----------------------------------------------------------------------------------------------------
@query("SELECT job_id, prompt_version FROM prompt_jobs WHERE job_id NOT IN (SELECT candidate_id FROM candidates WHERE candidate_id IS NOT NULL)")
def jobs_to_run(spark, folder):
    return records.remaining(table(spark, folder, "prompt_jobs"), table(spark, folder, "candidates"), "job_id", "candidate_id").select("job_id", "prompt_version")


_FAILED = r"""(regexp_replace(coalesce(candidate_response, ''), '^\s+|\s+$', '', 'g') = 'FAIL' OR regexp_replace(coalesce(raw_output, ''), '^\s+|\s+$', '', 'g') = 'FAIL'
 OR trim(lower(coalesce(generation_status, ''))) IN ('failed', 'model_fail', 'api_error'))"""


@query(f"SELECT DISTINCT candidate_id FROM candidates WHERE {_FAILED}")
def failed_candidates(spark, folder):
    rows = table(spark, folder, "candidates")
    return records.ids(rows.where(verdicts.is_failed(rows)))


@query(f"SELECT count(*) AS n FROM candidates WHERE candidate_id NOT IN (SELECT candidate_id FROM candidates WHERE {_FAILED})")
def without_failed(spark, folder):
    rows = table(spark, folder, "candidates")
    return records.without(rows, rows.where(verdicts.is_failed(rows)), "candidate_id").agg(F.count("*").alias("n"))


@query("""SELECT coalesce(j.job_id, c.candidate_id) AS candidate_id, coalesce(c.model, j.prompt_version) AS what
FROM prompt_jobs j FULL JOIN (SELECT candidate_id, min(model) AS model FROM candidates WHERE candidate_id IS NOT NULL GROUP BY 1) c ON j.job_id = c.candidate_id""")
def upserted_records(spark, folder):
    base = table(spark, folder, "prompt_jobs").select(F.col("job_id").alias("candidate_id"), F.col("prompt_version").alias("what"))
    new = table(spark, folder, "candidates").where("candidate_id is not null").groupBy("candidate_id").agg(F.min("model").alias("what"))
    return records.upserted(base, new)


@query("SELECT candidate_id, max(finished_at) AS finished_at FROM candidates WHERE candidate_id IS NOT NULL GROUP BY 1")
def latest_records(spark, folder):
    rows = table(spark, folder, "candidates").where("candidate_id is not null").select("candidate_id", "finished_at")
    return records.latest(rows, "candidate_id", ["finished_at"])


@query("SELECT dialect_family, count(*) AS n FROM candidates GROUP BY 1")
def counts_by_family(spark, folder):
    return records.counts_by(table(spark, folder, "candidates"), "dialect_family")


@query("SELECT dataset, score_band, count(*) AS n, GROUPING(dataset, score_band)::INT AS level FROM anchors GROUP BY ROLLUP (dataset, score_band)")
def anchors_rolled_up(spark, folder):
    return records.rolled_up(table(spark, folder, "anchors"), "dataset", "score_band")


@query("SELECT anchor_id, string_agg(f, '|' ORDER BY f) AS families FROM (SELECT DISTINCT anchor_id, dialect_family AS f FROM candidates WHERE dialect_family IS NOT NULL) GROUP BY 1")
def families_by_anchor(spark, folder):
    rows = table(spark, folder, "candidates").where("dialect_family is not null")
    return records.lists_by(rows, "anchor_id", "dialect_family").select("anchor_id", F.array_join("dialect_family_list", "|").alias("families"))


@query("SELECT candidate_id, row_number() OVER (PARTITION BY anchor_id ORDER BY coalesce(candidate_index, 0), candidate_id) - 1 AS place FROM (SELECT DISTINCT candidate_id, anchor_id, candidate_index FROM candidates)")
def sibling_order(spark, folder):
    rows = table(spark, folder, "candidates").select("candidate_id", "anchor_id", F.coalesce("candidate_index", F.lit(0)).alias("i")).distinct()
    return numbered_within(rows, ["anchor_id"], ["i", "candidate_id"], "place").select("candidate_id", "place")


@query("""SELECT coalesce(model, '') AS model, sum(i) AS tokens_in, sum(o) AS tokens_out, count(i) AS n, count(o) AS n_out FROM (SELECT model, CASE WHEN usage.input_tokens <> 0 THEN usage.input_tokens END AS i, CASE WHEN usage.output_tokens <> 0 THEN usage.output_tokens END AS o FROM candidates) GROUP BY 1""")
def token_totals(spark, folder):
    i, o = generate.token_counts("usage", have=("input_tokens", "output_tokens"))
    return table(spark, folder, "candidates").select(tx.text("model").alias("model"), i.alias("i"), o.alias("o")).groupBy("model").agg(F.sum("i").alias("tokens_in"), F.sum("o").alias("tokens_out"), F.count("i").alias("n"), F.count("o").alias("n_out"))


# text --------------------------------------------------------------------------------------------------------
@query(rf"""SELECT doc_id, {_words("coalesce(text, '')")}::INT AS words, len({_tokens("coalesce(text, '')")})::INT AS tokens, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z'']*'))::INT AS plain FROM documents""")
def word_counts(spark, folder):
    return table(spark, folder, "documents").select("doc_id", tx.word_count("text").alias("words"), F.size(tx.token_set("text")).alias("tokens"), F.size(tx.plain_words("text")).alias("plain"))


@query(rf"""SELECT DISTINCT dialect_family, regexp_replace(regexp_replace(trim(lower(dialect_family)), '^[.,!?;:]+|[.,!?;:]+$', '', 'g'), '\s+', ' ', 'g') AS marker FROM assignments WHERE dialect_family IS NOT NULL""")
def marker_forms(spark, folder):
    return table(spark, folder, "assignments").where("dialect_family is not null").select("dialect_family", tx.marker_form("dialect_family").alias("marker")).distinct()


_KEYS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in trace.OUTPUT_KEYS.items())


@query(rf"""SELECT DISTINCT dialect_family, CASE k {_KEYS} ELSE replace(replace(k, ' ', '_'), '/', '_') || '_output' END AS output_key
FROM (SELECT dialect_family, {oracle.strip("lower(coalesce(dialect_family, ''))")} AS k FROM (SELECT dialect_family FROM assignments UNION ALL SELECT dialect_family || ' -(x)/.' FROM assignments))""")
def output_keys(spark, folder):
    rows = table(spark, folder, "assignments").select("dialect_family")
    rows = rows.unionAll(rows.select(F.concat("dialect_family", F.lit(" -(x)/."))))  # names that the table of keys lacks
    return rows.select("dialect_family", trace.output_key("dialect_family").alias("output_key")).distinct()


@query(f"WITH {_PAIRS} SELECT candidate_id, {_jaccard(_tokens('anchor_response'), _tokens('said'))} AS token_jaccard FROM pairs")
def token_jaccard(spark, folder):
    return pairs(spark, folder).select("candidate_id", sim.token_jaccard("anchor_response", "candidate_response").alias("token_jaccard"))


def _grams(c: str) -> str:
    return f"CASE WHEN length({c}) < 3 THEN [lower({c})] ELSE list_distinct(list_transform(range(1, length({c}) - 1), lambda i: substr(lower({c}), i, 3))) END"


@query(f"WITH {_PAIRS}, g AS (SELECT candidate_id, {_grams('anchor_response')} AS x, {_grams('said')} AS y FROM pairs) SELECT candidate_id, {_jaccard('x', 'y')} AS char_jaccard FROM g")
def char_jaccard(spark, folder):
    return sim.with_char_jaccard(spread(pairs(spark, folder)), "anchor_response", "candidate_response", "char_jaccard").select("candidate_id", "char_jaccard")


def _coded(c: str) -> str:
    """A text with each of its pair's distinct characters as one byte, as DuckDB counts edits in bytes; for pairs of at most 127 of them."""
    return f"coalesce(array_to_string(list_transform(string_split({c}, ''), lambda e: chr(list_position(d, e)::INT)), ''), '')"


@query(rf"""WITH {_PAIRS}, l AS (SELECT candidate_id, anchor_response AS x, said AS y, list_distinct(string_split(anchor_response || said, '')) AS d FROM pairs),
e AS (SELECT candidate_id, x, y, CASE WHEN len(d) < 128 THEN levenshtein({_coded('x')}, {_coded('y')}) ELSE error('over 127 characters') END::INT AS edits FROM l)
SELECT candidate_id, edits, CASE WHEN greatest(length(x), length(y)) = 0 THEN 0.0 ELSE edits / greatest(length(x), length(y)) END AS share FROM e""")
def edit_distance(spark, folder):
    rows = spread(pairs(spark, folder))
    return rows.select("candidate_id", sim.edit_distance("anchor_response", "candidate_response").alias("edits"), sim.edit_share("anchor_response", "candidate_response").alias("share"))


@query(f"WITH {_PAIRS} SELECT candidate_id, CASE WHEN length(anchor_response) = 0 THEN 0.0 ELSE length(said) / length(anchor_response) END AS length_ratio, trim(anchor_response, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) = trim(said, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS same FROM pairs")
def length_ratios(spark, folder):
    return pairs(spark, folder).select("candidate_id", sim.length_ratio("anchor_response", "candidate_response").alias("length_ratio"), sim.exact("anchor_response", "candidate_response").alias("same"))


_PLAIN = "list_transform(regexp_extract_all({}, '[A-Za-z][A-Za-z'']*'), lambda x: lower(x))"


@query(f"""WITH {_PAIRS}, w AS (SELECT candidate_id, {_PLAIN.format('anchor_response')} AS x, {_PLAIN.format('said')} AS y FROM pairs)
SELECT candidate_id, len(y) - len(x) BETWEEN 1 AND 3 AND y[1:len(x)] = x AS appended FROM w""")
def tiny_appends(spark, folder):
    return pairs(spark, folder).select("candidate_id", sim.is_append("anchor_response", "candidate_response").alias("appended"))


@query("""SELECT a.vec_id AS vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosines(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return rows.join(after, "vec_id").select("vec_id", F.round(sim.cosine("embedding", "next"), 6).alias("cosine"))


# verdicts ----------------------------------------------------------------------------------------------------
#: Lower-case text in which letters and digits outside ASCII are ``z`` and the rest ``#``, so that word edges of ASCII are those of Unicode; and the same with other white space as a space.
_EDGED = r"""regexp_replace(regexp_replace(lower({}), '[^\x00-\x7F\P{{L}}]|[^\x00-\x7F\P{{N}}]', 'z', 'g'), '[^\x00-\x7F]', '#', 'g')"""
_SPACED = r"""regexp_replace({}, '[\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]', ' ', 'g')"""


def _re2(marker: str) -> str:
    edge = lambda c: r"\b" if c.isalnum() else ""
    low = marker.lower()
    return edge(low[0]) + re.escape(low).replace("'", "''") + edge(low[-1])


def _hits_sql(c: str) -> str:
    """A list of marker and number for each family; markers once, then features that stand for a pattern."""
    cases, low, spaced = [], _EDGED.format(c), _EDGED.format(_SPACED.format(c))
    for family, config in INVENTORY.items():
        found = [(m, low, _re2(m)) for m in markers(config)] + [(f["feature"], spaced, HABITUAL) for f in config["features"] if f["id"] == "aae_habitual_be"]
        cases.append(f"WHEN '{family}' THEN [" + ", ".join("{'m': '" + m.replace("'", "''") + f"', 'n': len(regexp_extract_all({t}, '{p}'))}}" for m, t, p in found) + "]")
    return f"list_filter(CASE dialect_family {' '.join(cases)} ELSE [] END, lambda h: h.n > 0)"


_COUNTS = "coalesce(list_sum(list_transform(hits, lambda h: h.n)), 0)::INT"
_NAMES = "list_filter(list_transform(hits, lambda h: h.m), lambda m, k: list_position(list_transform(hits, lambda h: h.m), m) = k)"


@query(f"WITH {_PAIRS}, l AS (SELECT candidate_id, {_hits_sql('said')} AS hits FROM pairs) SELECT candidate_id, {_COUNTS} AS realizations, {oracle.joined(_NAMES)} AS detected FROM l")
def marker_counts(spark, folder):
    rows = pairs(spark, folder).withColumn("hits", verdicts.marker_hits(F.col("candidate_response"), F.col("dialect_family"), INVENTORY))
    return rows.select("candidate_id", verdicts.realizations(F.col("hits")).alias("realizations"), F.array_join(verdicts.detected(F.col("hits")), "|").alias("detected"))


_RULES = f"""{_PAIRS}, counted AS (SELECT *, {_words('anchor_response')} AS a, {_words('said')} AS c, {_jaccard(_tokens('anchor_response'), _tokens('said'))} AS jac FROM pairs),
ruled AS (SELECT *, a > 0 AND c > 0 AND abs(c - a) / a > 0.2 AS outside, c < 10 AS short FROM counted)"""


def ruled(spark: SparkSession, folder: str) -> DataFrame:
    rows = pairs(spark, folder)
    rows = rows.withColumns({"rejection_reasons": verdicts.rule_reasons(F.col("anchor_response"), F.col("candidate_response")), "quality_score": sim.token_jaccard("anchor_response", "candidate_response")})
    return rows.withColumn("passed_quality_filter", F.size("rejection_reasons") == 0)


@query(f"WITH {_RULES} SELECT dialect_family, count(*) AS n, sum(outside::INT)::BIGINT AS outside, sum(short::INT)::BIGINT AS short, sum((NOT outside AND NOT short)::INT)::BIGINT AS passed FROM ruled GROUP BY 1")
def verdicts_by_family(spark, folder):
    has = lambda r: F.count_if(F.array_contains("rejection_reasons", r))
    return ruled(spark, folder).groupBy("dialect_family").agg(F.count("*").alias("n"), has("length_outside_tolerance").alias("outside"), has("candidate_too_short").alias("short"), F.count_if("passed_quality_filter").alias("passed"))


@query(f"WITH {_RULES} SELECT reason, count(*) AS n FROM (SELECT 'length_outside_tolerance' AS reason FROM ruled WHERE outside UNION ALL SELECT 'candidate_too_short' FROM ruled WHERE short) GROUP BY 1")
def reason_tally(spark, folder):
    return records.reason_tally(ruled(spark, folder), top=12)


@query(f"WITH {_RULES} SELECT count(*) AS n, sum((NOT outside AND NOT short)::INT)::BIGINT AS passed, sum((outside OR short)::INT)::BIGINT AS rejected, 0::BIGINT AS respelt FROM ruled")
def verdict_counts(spark, folder):
    return records.verdict_counts(ruled(spark, folder))


@query(f"""WITH {_RULES}, r AS (SELECT candidate_id, anchor_id, row_number() OVER (PARTITION BY anchor_id ORDER BY jac DESC, candidate_index, candidate_id) AS k, count(*) OVER (PARTITION BY anchor_id) AS total FROM ruled WHERE NOT outside AND NOT short)
SELECT candidate_id, 'rank ' || k || '/' || total || ' for anchor ' || anchor_id AS selected_reason FROM r WHERE k <= 2""")
def best_two(spark, folder):
    return records.best_of_each(ruled(spark, folder), 2).select("candidate_id", "selected_reason")


@query(f"WITH {_RULES} SELECT DISTINCT candidate_id FROM ruled WHERE short AND candidate_id IS NOT NULL ORDER BY 1 LIMIT 50")
def first_retries(spark, folder):
    return records.to_retry(ruled(spark, folder), ["candidate_too_short"], limit=50)


def entry(spark: SparkSession, folder: str) -> DataFrame:
    return verdicts_by_family(spark, folder)


# alignment and what follows from it ---------------------------------------------------------------------------
def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _by_family(of) -> str:
    return "CASE dialect_family " + " ".join(f"WHEN '{f}' THEN {_list(v.lower() for v in of(c))}" for f, c in INVENTORY.items()) + " ELSE [] END"


#: Candidates once, with the status and raw output of their last record, and their anchor's text.
_ONCE = f"""{_KNOWN}, once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY finished_at DESC NULLS LAST, generation_status DESC NULLS LAST, raw_output DESC NULLS LAST) AS nth FROM candidates WHERE candidate_id IS NOT NULL) WHERE nth = 1),
full_pairs AS MATERIALIZED (SELECT o.candidate_id AS id, o.anchor_id, o.dialect_family, o.candidate_index, o.generation_status, o.model, coalesce(o.candidate_response, '') AS response, coalesce(nullif(o.candidate_response, ''), {oracle.strip("coalesce(o.raw_output, '')")}) AS y, coalesce(o.raw_output, '') AS raw, coalesce(k.text, '') AS x, {_by_family(labels)} AS excused,
 {_by_family(markers)} AS shown FROM once o LEFT JOIN known k ON o.anchor_id = k.key)"""


def whole_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates once, with the status and raw output of their last record, and their anchor's text."""
    rows = table(spark, folder, "candidates").where("candidate_id is not null").select("candidate_id", "anchor_id", "dialect_family", "candidate_index", "generation_status", "model", "candidate_response", "raw_output", "finished_at")
    last = records.latest(rows, "candidate_id", ["finished_at", "generation_status", "raw_output"]).drop("finished_at")
    about = known_anchors(spark, folder, "text").select(F.col("key").alias("anchor_id"), F.col("text").alias("anchor_response"))
    return last.join(about, "anchor_id", "left").withColumn("anchor_response", tx.text("anchor_response"))


_WORDWISE = f"wsrc AS (SELECT id, {oracle.LOWER.format('x')} AS a, {oracle.LOWER.format('y')} AS b FROM full_pairs), {oracle.matched('w', 'wsrc')}, {oracle.ratios('w')}, {oracle.gaps('w')}"
_CHARWISE = f"csrc AS (SELECT id, string_split(x, '') AS a, string_split(y, '') AS b FROM full_pairs), {oracle.matched('c', 'csrc')}, {oracle.ratios('c')}"
_NORMWISE = f"nsrc AS (SELECT id, string_split(array_to_string({oracle.LOWER.format('x')}, ' '), '') AS a, string_split(array_to_string({oracle.LOWER.format('y')}, ' '), '') AS b FROM full_pairs), {oracle.matched('n', 'nsrc')}, {oracle.ratios('n')}"
_PLAIN_FIX = oracle.corrections("w", "(SELECT id, x, y, []::VARCHAR[] AS excused FROM full_pairs)")
_LABEL_FIX = oracle.corrections("w", "full_pairs")


@query(f"""WITH RECURSIVE {_ONCE}, {_WORDWISE}, {_CHARWISE}, {_NORMWISE}, {_PLAIN_FIX}, chunks AS (SELECT id, count(*)::INT AS n FROM w_gap GROUP BY id)
SELECT p.id AS candidate_id, c.ratio AS char_ratio, n.ratio AS norm_ratio, w.ratio AS word_ratio, w.unmatched AS changed_words, coalesce(chunks.n, 0)::INT AS changed_chunks, len({oracle.WORDS.format('x')})::INT AS anchor_words, {oracle.joined('fixes')} AS corrections
FROM full_pairs p JOIN c_ratio c USING (id) JOIN n_ratio n USING (id) JOIN w_ratio w USING (id) LEFT JOIN chunks USING (id) LEFT JOIN w_fix USING (id)""")
def alignments(spark, folder):
    rows = spread(whole_pairs(spark, folder))
    rows = rows.withColumn("m", alignment.align(F.col("anchor_response"), an.candidate_text(rows, "score")))
    return rows.select("candidate_id", "m.*").withColumn("corrections", F.array_join("corrections", "|"))


_DELTA = f"abs({_words('y')} - greatest({_words('x')}, 1)) / greatest({_words('x')}, 1)"
_FAIL = f"upper({oracle.strip('y')}) = 'FAIL'"
_FILTERED = f"""{_ONCE}, {_WORDWISE}, {_LABEL_FIX}, hit AS (SELECT *, {_hits_sql('y')} AS hits, {_DELTA} AS delta FROM full_pairs),
filtered AS MATERIALIZED (SELECT hit.*, {_COUNTS} AS realized, {_NAMES} AS detected, coalesce(fixes, []) AS fixes, {oracle.reasons(('length_outside_tolerance', 'delta > 0.2'), ('insufficient_approved_features', f'{_COUNTS} < 2'), ('generation_failed', _FAIL), ('student_text_correction', 'fixes IS NOT NULL'))} AS why
 FROM hit LEFT JOIN w_fix USING (id))"""


def filtered_rows(spark: SparkSession, folder: str) -> DataFrame:
    return verdicts.prefilter(whole_pairs(spark, folder), INVENTORY)


@query(f"""WITH RECURSIVE {_FILTERED} SELECT id AS candidate_id, {oracle.rounded('delta')} AS length_delta, {oracle.joined('detected')} AS detected_features, realized AS feature_realization_count,
{oracle.joined('fixes')} AS corrections, {oracle.joined('why')} AS reasons, len(why) = 0 AS passed_prefilter FROM filtered""")
def prefiltered(spark, folder):
    rows = filtered_rows(spark, folder)
    return rows.select("candidate_id", "length_delta", F.array_join("detected_features", "|").alias("detected_features"), "feature_realization_count", F.array_join("student_text_corrections", "|").alias("corrections"), F.array_join("rejection_reasons", "|").alias("reasons"), "passed_prefilter")


_STATUS = oracle.strip("lower(coalesce(generation_status, ''))")
_MARKER_FIX = oracle.corrections("w", "(SELECT id, x, y, shown AS excused FROM full_pairs)").replace("w_chg", "m_chg").replace("w_odd", "m_odd").replace("w_pairs", "m_pairs").replace("ws_", "ms_").replace("w_respelt", "m_respelt").replace("w_fix", "m_fix")
_SCORED = f"""{_FILTERED}, {_CHARWISE}, {_MARKER_FIX},
measured AS (SELECT f.*, c.ratio AS seq, coalesce(m.fixes, []) AS again, {oracle.strip('x')} = {oracle.strip('y')} AS same, CASE WHEN length(x) = 0 THEN 0.0 ELSE length(y) / length(x) END AS lr, {_words('x')} AS a, {_words('y')} AS n,
 list_distinct(string_split(x || y, '')) AS d, {_jaccard(_tokens('x'), _tokens('y'))} AS tj, {_grams('x')} AS gx, {_grams('y')} AS gy FROM filtered f JOIN c_ratio c USING (id) LEFT JOIN m_fix m USING (id)),
counted AS (SELECT *, {_jaccard('gx', 'gy')} AS cj, CASE WHEN len(d) < 128 THEN levenshtein({_coded('x')}, {_coded('y')}) ELSE error('over 127 characters') END::INT AS edits, {oracle.rounded(f"1 - {oracle.rounded('seq')}")} AS change, {_STATUS} AS status FROM measured),
scored AS MATERIALIZED (SELECT *, {oracle.rounded(f"change * {oracle.rounded('tj')}")} AS quality, list_sort(list_distinct(list_concat(list_filter(why, lambda r: r <> 'student_text_correction'),
 CASE WHEN status <> '' AND status NOT IN ('ok', 'demo_unvalidated', 'generated', 'scored') THEN ['generation_status:' || status] ELSE [] END,
 {oracle.reasons(('generation_failed', f"{_FAIL} OR {oracle.strip('raw')} = 'FAIL' OR status IN ('failed', 'model_fail', 'api_error')"), ('student_text_correction', 'len(again) > 0'), ('length_outside_tolerance', 'a > 0 AND n > 0 AND abs(n - a) / a > 0.2'), ('candidate_too_short', 'n < 10'), ('insufficient_change', 'change < 0.005'))}))) AS all_why FROM counted)"""


def scored_rows(spark: SparkSession, folder: str) -> DataFrame:
    return verdicts.score(filtered_rows(spark, folder), INVENTORY)


@query(f"""WITH RECURSIVE {_SCORED} SELECT id AS candidate_id, same AS exact_match, {oracle.rounded('lr')} AS length_ratio, edits AS levenshtein_distance, {oracle.rounded("CASE WHEN greatest(length(x), length(y)) = 0 THEN 0.0 ELSE edits / greatest(length(x), length(y)) END")} AS levenshtein_normalized,
{oracle.rounded('tj')} AS token_jaccard, {oracle.rounded('cj')} AS char_3gram_jaccard, {oracle.rounded('seq')} AS difflib_ratio, a::INT AS anchor_word_count, n::INT AS candidate_word_count, change AS composite_change_score, quality AS quality_score,
{oracle.joined('again')} AS corrections, {oracle.joined('all_why')} AS reasons, len(all_why) = 0 AS passed_quality_filter FROM scored""")
def scored(spark, folder):
    rows = scored_rows(spark, folder)
    return rows.select("candidate_id", "similarity_scores.*", "anchor_word_count", "candidate_word_count", "composite_change_score", "quality_score", F.array_join("student_text_corrections", "|").alias("corrections"), F.array_join("rejection_reasons", "|").alias("reasons"), "passed_quality_filter")


@query(f"""WITH RECURSIVE {_SCORED}, r AS (SELECT id, anchor_id, row_number() OVER (PARTITION BY anchor_id ORDER BY quality DESC, candidate_index, id) AS k, count(*) OVER (PARTITION BY anchor_id) AS total FROM scored WHERE len(all_why) = 0)
SELECT id AS candidate_id, 'rank ' || k || '/' || total || ' for anchor ' || anchor_id AS selected_reason FROM r WHERE k <= 2""")
def curated(spark, folder):
    """The two best passing candidates of each anchor by their quality score."""
    return records.best_of_each(cut(scored_rows(spark, folder).select("candidate_id", "anchor_id", "candidate_index", "quality_score", "passed_quality_filter")), 2).select("candidate_id", "selected_reason")


@query(f"WITH RECURSIVE {_SCORED}" + """, told AS (SELECT id, unnest(all_why) AS reason, generate_subscripts(all_why, 1) AS place FROM scored)
SELECT reason, count(*) AS n FROM told GROUP BY 1 ORDER BY n DESC, min({'id': id, 'place': place}), reason LIMIT 8""")
def rejected_reasons(spark, folder):
    """The eight most frequent reasons of scored candidates; ties stand as first seen."""
    return records.reason_tally(scored_rows(spark, folder), top=8)


@query(f"WITH RECURSIVE {_SCORED} SELECT count(*) AS n, count(*) FILTER (len(all_why) = 0) AS passed, count(*) FILTER (len(all_why) > 0) AS rejected, count(*) FILTER (list_contains(all_why, 'student_text_correction')) AS respelt FROM scored")
def scored_counts(spark, folder):
    return records.verdict_counts(scored_rows(spark, folder))


@query(f"""WITH RECURSIVE {_FILTERED}, flagged AS (SELECT id, g.b0, g.b1, array_to_string(list_slice({oracle.WORDS.format('x')}, a0 + 1, a1), ' ') AS before, array_to_string(list_slice({oracle.WORDS.format('y')}, b0 + 1, b1), ' ') AS after, fixes FROM w_gap g JOIN filtered USING (id) WHERE len(fixes) > 0 AND a0 < a1 AND b0 < b1),
put AS MATERIALIZED (SELECT * FROM flagged WHERE list_contains(list_transform(fixes, lambda f: lower(f)), lower(before || ' -> ' || after))),
word AS (SELECT id, unnest({oracle.WORDS.format('y')}) AS w, unnest(regexp_split_to_array(y, '[A-Za-z][A-Za-z'']*')) AS gap, generate_subscripts(regexp_split_to_array(y, '[A-Za-z][A-Za-z'']*'), 1) - 1 AS k FROM filtered WHERE id IN (SELECT id FROM put)),
made AS (SELECT id, string_agg(CASE WHEN b0 IS NULL THEN gap || coalesce(w, '') WHEN k = b0 THEN gap || before ELSE '' END, '' ORDER BY k) AS made FROM word LEFT JOIN put ON word.id = put.id AND k >= b0 AND k < b1 GROUP BY ALL),
done AS (SELECT id, string_agg(before || ' -> ' || after, '|' ORDER BY b0) AS repairs FROM put GROUP BY id)
SELECT p.id AS candidate_id, coalesce(made, response) AS candidate_response, coalesce(made, raw) AS raw_output, coalesce(repairs, '') AS repairs FROM full_pairs p LEFT JOIN made USING (id) LEFT JOIN done USING (id)""".replace("SELECT id, string_agg(CASE WHEN b0", "SELECT word.id AS id, string_agg(CASE WHEN b0").replace("b1 GROUP BY ALL", "b1 GROUP BY word.id"))
def repaired(spark, folder):
    rows = cut(filtered_rows(spark, folder).select("candidate_id", "anchor_response", "student_text_corrections"))
    raw = whole_pairs(spark, folder).select("candidate_id", tx.text("candidate_response").alias("candidate_response"), tx.text("raw_output").alias("raw_output"))
    return repair.repaired(raw, rows).select("candidate_id", "candidate_response", "raw_output", F.array_join("mechanical_cleanup_repairs", "|").alias("repairs"))


@query(f"WITH {_KNOWN}, plan AS (SELECT DISTINCT anchor_id, dialect_family, assignment_strategy AS demo_reason FROM assignments) SELECT plan.anchor_id, plan.dialect_family, 3 AS target_candidates, 'curated_demo' AS assignment_strategy, nullif(dataset, '') AS source_corpus, score_band, nullif(domain, '') AS domain, demo_reason FROM plan JOIN known ON plan.anchor_id = key")
def demo_assignments(spark, folder):
    """Assignments of a given plan."""
    plan = table(spark, folder, "assignments").select(F.col("anchor_id").alias("essay_id"), "dialect_family", F.col("assignment_strategy").alias("demo_reason")).distinct()
    return assign.planned(table(spark, folder, "anchors"), plan, ORDER)


@query("SELECT candidate_id, what FROM (SELECT job_id AS candidate_id, prompt_version AS what, NULL AS model FROM prompt_jobs UNION ALL SELECT candidate_id, NULL, model FROM candidates)")
def appended_records(spark, folder):
    """Jobs, then all records, with the columns of both."""
    jobs = table(spark, folder, "prompt_jobs").select(F.col("job_id").alias("candidate_id"), F.col("prompt_version").alias("what"))
    return records.appended(jobs, table(spark, folder, "candidates").select("candidate_id", "model")).select("candidate_id", "what")


@query(f"WITH {_RULES} SELECT DISTINCT candidate_id FROM ruled WHERE outside AND candidate_id NOT IN (SELECT candidate_id FROM candidates WHERE {_FAILED} AND candidate_id IS NOT NULL)")
def retries_left(spark, folder):
    """Records to be made anew for their length, without those whose retry is done (here: those that failed)."""
    made = table(spark, folder, "candidates")
    done = made.where(verdicts.is_failed(made)).select(F.col("candidate_id").alias("retry_of_candidate_id"))
    return records.to_retry(ruled(spark, folder), ["length_outside_tolerance"], done)


@query(f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), ','), lambda x: {oracle.strip('x')}), lambda x: x <> ''), '|') AS parts FROM documents".replace("array_to_string(list_filter", "coalesce(array_to_string(list_filter").replace("'|') AS parts", "'|'), '') AS parts"))
def comma_lists(spark, folder):
    """Texts read as comma-separated lists."""
    return table(spark, folder, "documents").select("doc_id", F.array_join(tx.listed("text"), "|").alias("parts"))


# audit ---------------------------------------------------------------------------------------------------------
_NORM = f"array_to_string({oracle.LOWER.format('y')}, ' ')"
_LOW_LABELS = f"list_filter(list_transform(detected, lambda m: regexp_replace(regexp_replace({oracle.strip('lower(m)')}, '^[.,!?;:]+|[.,!?;:]+$', '', 'g'), '\\s+', ' ', 'g')), lambda m: m <> '')"
_AUDITED = f"""{_FILTERED}, {_NORMWISE}, chunks AS (SELECT id, count(*)::INT AS n FROM w_gap GROUP BY id),
normal AS MATERIALIZED (SELECT id, anchor_id, coalesce({_NORM}, '') AS t, row_number() OVER (PARTITION BY anchor_id ORDER BY coalesce(candidate_index, 0), id) AS place FROM filtered),
texts AS MATERIALIZED (SELECT anchor_id, t, count(*) AS n FROM normal GROUP BY ALL), named AS MATERIALIZED (SELECT *, row_number() OVER () AS nr FROM texts),
met AS MATERIALIZED (SELECT p.nr || '~' || q.nr AS id, p.nr AS p, q.nr AS q, p.anchor_id, p.t AS s, q.t AS t, string_split(p.t, '') AS a, string_split(q.t, '') AS b FROM named p JOIN named q ON p.anchor_id = q.anchor_id AND p.nr <> q.nr),
{oracle.matched('s', 'met')}, {oracle.ratios('s')},
close AS MATERIALIZED (SELECT anchor_id, s, t, ratio FROM s_ratio JOIN met USING (id) UNION ALL SELECT anchor_id, t, t, 1.0 FROM texts WHERE n > 1),
best AS (SELECT anchor_id, s, max({oracle.rounded('ratio')}) AS most FROM close GROUP BY ALL),
many AS (SELECT l.id, count(*) AS n FROM normal l JOIN close c ON l.anchor_id = c.anchor_id AND l.t = c.s JOIN normal r ON r.anchor_id = c.anchor_id AND r.t = c.t AND r.id <> l.id WHERE {oracle.rounded('ratio')} >= 0.985 GROUP BY l.id),
prior AS (SELECT l.id, arg_min(r.id, r.place) AS twin, arg_min(ratio, r.place) AS twin_ratio FROM normal l JOIN close c ON l.anchor_id = c.anchor_id AND l.t = c.t JOIN normal r ON r.anchor_id = c.anchor_id AND r.t = c.s AND r.place < l.place WHERE ratio >= 0.985 GROUP BY l.id),
looked AS (SELECT f.*, w.ratio AS wr, w.unmatched AS changed, coalesce(chunks.n, 0)::INT AS chunks, nr.ratio AS nratio, {oracle.LOWER.format('x')} AS xs, {oracle.LOWER.format('y')} AS ys, coalesce(most, 0.0) AS most, coalesce(many.n, 0) AS many, twin, twin_ratio, {_FAIL} AS fail,
 {_LOW_LABELS} AS forms, CASE WHEN realized = 0 THEN len(detected) ELSE realized END::INT AS filled FROM filtered f JOIN w_ratio w USING (id) JOIN n_ratio nr USING (id) JOIN normal USING (id) LEFT JOIN chunks USING (id)
 LEFT JOIN best ON best.anchor_id = f.anchor_id AND best.s = normal.t LEFT JOIN many ON many.id = f.id LEFT JOIN prior ON prior.id = f.id),
noted AS (SELECT *, len(xs) AS nx, changed / greatest(len(xs), 1) AS share, CASE WHEN contains(lower(dialect_family), 'african american') THEN list_concat(CASE WHEN regexp_matches(lower(y), '\\bdone\\s+be\\b') THEN ['aae_done_be_stack'] ELSE [] END,
 CASE WHEN len(stack) >= 2 THEN ['aae_marker_pileup:' || array_to_string(stack, '+')] ELSE [] END) ELSE [] END AS notes
 FROM (SELECT *, {oracle.reasons(('finna', "regexp_matches(lower(y), '\\bfinna\\b')"), ("ain''t", "regexp_matches(lower(y), '\\bain[''’]?t\\b')"), ('gonna', "regexp_matches(lower(y), '\\bgonna\\b')"))} AS stack FROM looked)),
judged AS (SELECT *, list_concat(why, list_filter({oracle.reasons(('within_anchor_duplicate', 'twin IS NOT NULL'), ('surface_change_below_minimum', 'NOT fail AND share < 0.05'), ('surface_change_above_upper_bound', 'NOT fail AND share > 0.25'),
 ('long_anchor_low_feature_count', 'NOT fail AND nx >= 80 AND filled < 3'), ('anchor_near_duplicate', 'NOT fail AND nx >= 80 AND wr >= 0.94 AND share < 0.1 AND chunks <= 4'),
 ('weak_minimal_edit_or_append', '(len(ys) - len(xs) BETWEEN 1 AND 3 AND ys[1:len(xs)] = xs) OR (changed <= 2 AND len(detected) <= 1) OR nratio >= 0.996'),
 ('cross_family_tag_right', "contains(lower(dialect_family), 'appalachian') AND regexp_matches(lower(y), '\\bright\\s*\\?')"),
 ('single_detected_feature', 'NOT fail AND len(forms) > 0 AND CASE WHEN filled = 0 THEN len(forms) ELSE filled END < 2'),
 ('common_feature_only', f"NOT fail AND len(forms) > 0 AND len(forms) <= 2 AND len(list_filter(forms, lambda m: NOT list_contains({_list(audit.COMMON)}, m))) = 0"),
 ('aae_authenticity_review', 'len(notes) > 0'))}, lambda r: NOT list_contains(why, r))) AS every FROM noted)"""


@query(f"""WITH RECURSIVE {_AUDITED} SELECT id AS candidate_id, most AS max_pairwise_sibling_similarity, many AS sibling_similarity_over_threshold_count, twin AS duplicate_of_candidate_id, {oracle.rounded('twin_ratio')} AS duplicate_similarity,
CASE WHEN NOT fail THEN {oracle.rounded('share')} END AS surface_change_ratio, CASE WHEN NOT fail THEN nx END::INT AS audit_anchor_word_count, CASE WHEN NOT fail THEN changed END::INT AS audit_changed_word_count, CASE WHEN NOT fail THEN {oracle.rounded('wr')} END AS anchor_similarity_ratio,
CASE WHEN NOT fail THEN chunks END::INT AS audit_changed_chunk_count, {oracle.joined('notes')} AS notes, {oracle.joined('every')} AS reasons, len(every) = 0 AS passed_quality_filter FROM judged""")
def audited(spark, folder):
    """Audit of pre-filtered candidates; siblings are compared in both directions, all with all."""
    rows = filtered_rows(spark, folder).withColumnRenamed("passed_prefilter", "passed_quality_filter")
    rows = audit.audit(rows, carried=["candidate_id", "rejection_reasons", "passed_quality_filter"])
    return rows.select(
        "candidate_id", "max_pairwise_sibling_similarity", "sibling_similarity_over_threshold_count", "duplicate_of_candidate_id", "duplicate_similarity", "surface_change_ratio", "audit_anchor_word_count", "audit_changed_word_count", "anchor_similarity_ratio",
        "audit_changed_chunk_count", F.coalesce(F.array_join("aae_authenticity_notes", "|"), F.lit("")).alias("notes"), F.array_join("rejection_reasons", "|").alias("reasons"), "passed_quality_filter",
    )


# prompts and generation ----------------------------------------------------------------------------------------
def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _family_sql() -> str:
    """``fam``: of each family its name, inventory as JSON text, and the texts for prompts, made from that JSON."""
    rows = ", ".join(f"({k}, {_text(f)}, {_text(json.dumps(c, ensure_ascii=False, indent=2))})" for k, (f, c) in enumerate(INVENTORY.items()))
    heads = ", ".join(f"({k}, '{c}', '{h}')" for k, (c, h) in enumerate(CATEGORIES.items()))
    return f"""fam0(nr, dialect_family, inventory_json) AS (VALUES {rows}), heads(k, category, heading) AS (VALUES {heads}),
feature AS (SELECT nr, generate_subscripts(fs, 1) AS at_nr, unnest(fs) AS f FROM (SELECT nr, (inventory_json::JSON)->'$.features[*]' AS fs FROM fam0)),
told AS (SELECT nr, k, heading || ': ' || string_agg((f->>'feature') || coalesce(' (' || (f->>'description') || ')', '') || coalesce(' Avoid: ' || (f->>'blocked_context'), ''), '; ' ORDER BY at_nr) AS line FROM feature JOIN heads ON f->>'category' = category WHERE (f->>'allowed_for_generation') = 'true' GROUP BY nr, k, heading),
fam AS (SELECT nr, dialect_family, inventory_json, (SELECT string_agg(line, chr(10) ORDER BY k) FROM told t WHERE t.nr = fam0.nr) || chr(10) || 'Review status: ' || (inventory_json::JSON->>'review_status') AS inventory_text,
 concat_ws(chr(10), 'Disallowed features: ' || nullif(array_to_string(inventory_json::JSON->>'$.disallowed_features[*]', '; '), ''), 'Safety notes: ' || nullif(array_to_string(inventory_json::JSON->>'$.safety_notes[*]', ' '), ''),
  CASE WHEN inventory_json::JSON->>'review_status' <> 'approved' THEN 'Draft status: ' || (inventory_json::JSON->>'review_status') || ' requires team and/or linguist review before final benchmark use.'
   WHEN inventory_json::JSON->>'needs_linguist_review' = 'true' THEN 'Draft status: this inventory requires team and/or linguist review before final benchmark use.' END) AS notes_text FROM fam0)"""


@query(f"WITH {_family_sql()} SELECT dialect_family, inventory_text, notes_text, inventory_json FROM fam")
def inventory_texts(spark, folder):
    return family_table(spark, INVENTORY).select("dialect_family", "inventory_text", "notes_text", "inventory_json")


def _render(template: str, *values: tuple[str, str]) -> str:
    out = _text(template)
    for name, value in values:
        out = f"replace({out}, '{{{name}}}', {value})"
    return out


_PROMPT = _render(TEMPLATE, ("PROMPT", "CASE WHEN trim(coalesce(prompt, '')) = '' THEN '[PROMPT NOT PROVIDED]' ELSE prompt END"), ("ANCHOR_RESPONSE", "coalesce(text, '')"), ("DIALECT_FAMILY", "fam.dialect_family"), ("FEATURE_INVENTORY", "inventory_text"), ("DISALLOWED_FEATURES_AND_NOTES", "notes_text"))


@query(f"""WITH {_KNOWN}, {_family_sql()}, a AS (SELECT DISTINCT anchor_id, dialect_family, coalesce(target_candidates, 3) AS n FROM assignments)
SELECT a.anchor_id || '_' || replace(a.dialect_family, ' ', '_') || '_' || i AS job_id, i AS candidate_index, {_PROMPT} AS generation_prompt FROM a JOIN known ON a.anchor_id = key JOIN fam USING (dialect_family), unnest(range(1, n + 1)) AS u(i)""")
def whole_prompts(spark, folder):
    """Jobs with all five places of the template filled."""
    asked = table(spark, folder, "assignments").select("anchor_id", "dialect_family", "target_candidates").distinct()
    made = assign.jobs(asked, table(spark, folder, "anchors"), family_table(spark, INVENTORY), TEMPLATE, "own_v1", ORDER)
    return made.select("job_id", F.col("candidate_index").cast("bigint").alias("candidate_index"), "generation_prompt")


_ATTEMPT = "coalesce(generation_prompt, '') || chr(10) || chr(10) || 'Candidate attempt: ' || coalesce(candidate_index, 1) || ' of 3.' || chr(10) || 'If more than one valid rewrite is possible, choose a natural rewrite that is not identical to the other attempts, while still following every rule above.'"
_SPLIT = rf"len(regexp_extract_all(sent, '[^\s\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+'))".replace("\\\\", "\\")


@query(f"""WITH sent AS (SELECT *, {_ATTEMPT} AS sent FROM prompt_jobs WHERE job_id NOT IN (SELECT candidate_id FROM candidates WHERE candidate_id IS NOT NULL))
SELECT job_id AS candidate_id, anchor_id, dialect_family, coalesce(candidate_index, 1) AS candidate_index, coalesce(prompt_version, '') AS prompt_version, 'offline' AS model, 'demo_unvalidated' AS generation_status,
'Answer ' || substr(sha256(sent), 1, 12) || ' to ' || length(sent) || ' characters.' AS candidate_response, 'own_' || substr(sha256(sent), 1, 12) AS openai_response_id, {_SPLIT}::BIGINT AS tokens_in, 6::BIGINT AS tokens_out, job_id AS source_job_id FROM sent""")
def generated(spark, folder):
    left = records.remaining(table(spark, folder, "prompt_jobs"), table(spark, folder, "candidates"), "job_id", "candidate_id")
    made = generate.generate(left, offline_client, "offline")
    return made.select("candidate_id", "anchor_id", "dialect_family", "candidate_index", "prompt_version", "model", "generation_status", "candidate_response", "openai_response_id", "tokens_in", "tokens_out", "source_job_id")


@query(f"""WITH {_KNOWN}, {_family_sql()}, n AS (SELECT *, row_number() OVER (ORDER BY key) - 1 AS i FROM known), a AS (SELECT n.*, {_FAMILY_LIST}[(i % 6 + 1)::INT] AS family FROM n),
jobs AS (SELECT key || '_' || replace(family, ' ', '_') || '_' || u.k AS job_id, u.k AS candidate_index, {_PROMPT} AS generation_prompt FROM a JOIN fam ON fam.dialect_family = family, unnest(range(1, 4)) AS u(k)), sent AS (SELECT job_id, {_ATTEMPT} AS sent FROM jobs)
SELECT job_id AS candidate_id, 'Answer ' || substr(sha256(sent), 1, 12) || ' to ' || length(sent) || ' characters.' AS candidate_response FROM sent""")
def flow_records(spark, folder):
    """Assignments, jobs and records of a whole flow over all anchors."""
    rows = known_anchors(spark, folder).withColumn("anchor_id", F.col("key"))
    flow = Flow(INVENTORY, TEMPLATE, "own_v1", offline_client, "offline", ["key"])
    return flow.generated(flow.jobs(rows, cut(flow.assignments(rows)))).select("candidate_id", "candidate_response")


_RETRIES = f"""{_RULES}, place AS (SELECT candidate_id, anchor_id, said, row_number() OVER (PARTITION BY anchor_id ORDER BY candidate_index, candidate_id) AS i FROM pairs WHERE candidate_id IS NOT NULL),
near AS (SELECT p.candidate_id, string_agg('- ' || q.said, chr(10) ORDER BY q.i) AS also FROM place p JOIN place q ON p.anchor_id = q.anchor_id AND q.i <> p.i AND q.i BETWEEN p.i - 4 AND p.i + 4 GROUP BY 1),
again AS (SELECT job_id, j.candidate_index, concat_ws(chr(10) || chr(10), generation_prompt, 'The earlier answer was rejected:', r.said, 'Reasons: ' || concat_ws(', ', CASE WHEN outside THEN 'length_outside_tolerance' END, 'candidate_too_short'), 'Other answers to stay apart from:' || chr(10) || also, 'Write a whole answer.') AS generation_prompt
 FROM ruled r JOIN prompt_jobs j ON r.candidate_id = j.job_id LEFT JOIN near ON near.candidate_id = r.candidate_id WHERE short)"""


def _retries(spark: SparkSession, folder: str) -> DataFrame:
    rows = ruled(spark, folder).withColumn("student_text_corrections", F.array().cast("array<string>"))
    rows = cut(rows.select("candidate_id", "anchor_id", "candidate_index", "candidate_response", "rejection_reasons", "student_text_corrections", "passed_quality_filter"))
    return generate.retry_prompts(records.to_retry(rows, ["candidate_too_short"]), table(spark, folder, "prompt_jobs"), rows, {"candidate_too_short": "Write a whole answer."})


@query(f"WITH {_RETRIES} SELECT job_id, generation_prompt FROM again")
def retry_prompts(spark, folder):
    return _retries(spark, folder).select("job_id", "generation_prompt")


@query(f"""WITH {_RETRIES}, made AS (SELECT job_id, 'Answer ' || substr(sha256(sent), 1, 12) || ' to ' || length(sent) || ' characters.' AS answer FROM (SELECT job_id, {_ATTEMPT} AS sent FROM again))
SELECT candidate_id, CASE WHEN job_id IS NULL THEN candidate_response ELSE answer END AS candidate_response, job_id AS retry_of_candidate_id FROM candidates LEFT JOIN made ON candidate_id = job_id""")
def retried(spark, folder):
    """The round of retries: prompts, new records, every copy of a record replaced by the new one of its id."""
    prompts = cut(_retries(spark, folder))
    made = cut(generate.tagged(generate.generate(prompts, offline_client, "offline", attempts=4, wait=8.0), prompts))
    return records.upserted(table(spark, folder, "candidates").select("candidate_id", "candidate_response"), made.select("candidate_id", "candidate_response", "retry_of_candidate_id"))


# traces --------------------------------------------------------------------------------------------------------
_KEY_SQL = f"CASE k {_KEYS} ELSE replace(replace(k, ' ', '_'), '/', '_') || '_output' END"


def _said_as_json(rows: DataFrame) -> DataFrame:
    """Answers as a traced model gives them: by the candidate's index, JSON in a fence, JSON among other words, or the raw output as it is."""
    span = F.struct(F.lit("f1").alias("id"), F.lit("it").alias("span_before"), F.lit("It").alias("span_after"))
    whole = F.to_json(F.struct(F.array(span).alias("applied_features"), F.array(F.struct(F.lit("f2").alias("id"), F.lit("none").alias("reason"))).alias("rejected_candidates"), F.lit("noted").alias("notes")))
    own = F.concat(F.lit('{"'), trace.output_key("dialect_family"), F.lit('": '), F.to_json(F.array(tx.text("candidate_response"))).substr(F.lit(2), F.length(F.to_json(F.array(tx.text("candidate_response")))) - 2), F.lit(", "), F.expr("substring(whole, 2)"))
    rows = rows.withColumn("whole", whole).withColumn("own", own)
    turn = F.coalesce("candidate_index", F.lit(0)) % 3
    return rows.withColumn("raw_output", F.when(turn == 1, F.concat(F.lit("```json\n"), "own", F.lit("\n```"))).when(turn == 2, F.concat(F.lit("Here it is: "), "own", F.lit(" as asked."))).otherwise(tx.text("raw_output"))).drop("whole", "own")


_TRACED = f"""{_ONCE}, answered AS MATERIALIZED (SELECT id, anchor_id, dialect_family, x, response AS said, raw, coalesce(candidate_index, 0) % 3 AS turn, {oracle.strip("regexp_replace(" + oracle.strip('raw') + ", '^```(?:json)?\\s*|\\s*```$', '', 'gi')")} AS bare, {oracle.strip("lower(coalesce(dialect_family, ''))")} AS k FROM full_pairs),
tried AS MATERIALIZED (SELECT *, CASE WHEN json_valid(bare) THEN bare WHEN json_valid(regexp_extract(bare, '(?s)\\{{.*\\}}')) THEN regexp_extract(bare, '(?s)\\{{.*\\}}') ELSE 'null' END AS inside FROM answered),
read AS MATERIALIZED (SELECT *, turn IN (1, 2) AS made, turn IN (1, 2) OR json_type(inside) = 'OBJECT' AS ok FROM tried),
voiced AS MATERIALIZED (SELECT id, anchor_id, dialect_family, x, {oracle.strip("CASE WHEN made THEN said WHEN ok AND json_type(inside, '$.' || " + _KEY_SQL + ") = 'VARCHAR' THEN json_extract_string(inside, '$.' || " + _KEY_SQL + ") ELSE raw END")} AS y, made, ok, CASE WHEN made THEN ['it'] ELSE []::VARCHAR[] END AS excused,
 made OR (ok AND len(json_keys(inside)) > 0) AS full FROM read),
tsrc AS (SELECT id, {oracle.LOWER.format('x')} AS a, {oracle.LOWER.format('y')} AS b FROM voiced), {oracle.matched('t', 'tsrc')}, {oracle.gaps('t')}, {oracle.corrections('t', 'voiced')},
traced AS MATERIALIZED (SELECT v.*, CASE WHEN "full" THEN coalesce(fixes, []) ELSE [] END AS fixes FROM voiced v LEFT JOIN t_fix USING (id))""".replace(" AS full FROM read", ' AS "full" FROM read')


def traced_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = _said_as_json(whole_pairs(spark, folder)).select("candidate_id", "anchor_id", "dialect_family", F.col("anchor_response").alias("anchor_text"), "raw_output")
    return trace.traced(rows)


@query(f"""WITH RECURSIVE {_TRACED} SELECT id AS candidate_id, ok, y AS candidate_response, {oracle.joined('fixes')} AS corrections, made::INT AS applied, CASE WHEN NOT ok THEN 'parse_error' WHEN len(fixes) > 0 THEN 'needs_review_student_text_correction' ELSE 'ok' END AS generation_status FROM traced""")
def traced(spark, folder):
    rows = traced_rows(spark, folder)
    return rows.select("candidate_id", F.col("parsed_output.ok").alias("ok"), "candidate_response", F.array_join("detected_student_corrections", "|").alias("corrections"), F.size("parsed_output.applied").alias("applied"), "generation_status")


@query(f"""WITH RECURSIVE {_TRACED} SELECT count(*) AS records, count(*) FILTER ({oracle.strip('y')} <> {oracle.strip('x')}) AS changed, sum(made::INT)::BIGINT AS applied_features, count(*) FILTER (len(fixes) > 0) AS with_corrections FROM traced""")
def trace_totals(spark, folder):
    return trace.summary(traced_rows(spark, folder))


@query(f"""WITH RECURSIVE {_ONCE}, {_WORDWISE}, {_PLAIN_FIX} SELECT id AS candidate_id, string_agg(DISTINCT lower(before) || '>' || lower(after), '|' ORDER BY lower(before) || '>' || lower(after)) AS forms
FROM (SELECT id, string_split(f, ' -> ')[1] AS before, string_split(f, ' -> ')[2] AS after FROM (SELECT id, unnest(fixes) AS f FROM w_fix)) GROUP BY 1""")
def correction_forms(spark, folder):
    """Corrections read back as pairs of forms."""
    rows = spread(whole_pairs(spark, folder))
    rows = rows.select("candidate_id", alignment.align(F.col("anchor_response"), an.candidate_text(rows, "score"), chars="none")["corrections"].alias("fixes")).where("size(fixes) > 0")
    return rows.select("candidate_id", F.array_join(F.array_sort(F.transform(tx.correction_pairs("fixes"), lambda p: F.concat(p["before"], F.lit(">"), p["after"]))), "|").alias("forms"))


@query(f"""WITH {_KNOWN}, {_family_sql()}, a AS (SELECT DISTINCT anchor_id, dialect_family FROM assignments), n AS (SELECT *, {oracle.strip('lower(dialect_family)')} AS k FROM a)
SELECT n.anchor_id || '_' || replace(replace(n.dialect_family, ' ', '_'), '/', '_') || '_trace' AS trace_id, {_render(TEMPLATE + chr(10) + '{OUTPUT_KEY}' + chr(10) + '{FEATURE_INVENTORY_JSON}', ('ANCHOR_RESPONSE', "coalesce(text, '')"), ('DIALECT_FAMILY', 'n.dialect_family'), ('OUTPUT_KEY', _KEY_SQL), ('FEATURE_INVENTORY_JSON', 'inventory_json'))} AS prompt
FROM n JOIN known ON n.anchor_id = key JOIN fam USING (dialect_family)""")
def trace_prompts(spark, folder):
    rows = known_anchors(spark, folder, "text").select(F.col("key").alias("anchor_id"), "text").join(table(spark, folder, "assignments").select("anchor_id", "dialect_family").distinct(), "anchor_id").join(family_table(spark, INVENTORY), "dialect_family")
    return rows.select(an.trace_id(F.col("anchor_id"), F.col("dialect_family")).alias("trace_id"), trace.trace_prompt(TEMPLATE + "\n{OUTPUT_KEY}\n{FEATURE_INVENTORY_JSON}", "text", "dialect_family", "inventory_json").alias("prompt"))


_DONE_TRACES = "SELECT DISTINCT anchor_id || '_' || replace(replace(dialect_family, ' ', '_'), '/', '_') || '_trace' AS trace_id FROM candidates WHERE candidate_index = 3"


@query(f"""WITH {_KNOWN}, {_family_sql()}, a AS (SELECT DISTINCT anchor_id, dialect_family, anchor_id || '_' || replace(replace(dialect_family, ' ', '_'), '/', '_') || '_trace' AS trace_id, {oracle.strip('lower(dialect_family)')} AS k FROM assignments),
todo AS (SELECT a.*, coalesce(text, '') AS anchor_text, 'T ' || coalesce(text, '') || ' ' || {_KEY_SQL} AS prompt FROM a JOIN known ON a.anchor_id = key JOIN fam USING (dialect_family) WHERE trace_id NOT IN ({_DONE_TRACES}))
SELECT trace_id, {_KEY_SQL} AS output_key, 'own_v1' AS prompt_version, anchor_text, 'Answer ' || substr(sha256(prompt), 1, 12) || ' to ' || length(prompt) || ' characters.' AS raw_output, 'parse_error' AS generation_status FROM todo""")
def traces_made(spark, folder):
    """Traced generation of the assignments that have no trace yet (traces are at hand for anchors and families of third candidates)."""
    done = table(spark, folder, "candidates").where("candidate_index = 3").select(an.trace_id(F.col("anchor_id"), F.col("dialect_family")).alias("trace_id")).distinct()
    anchors = known_anchors(spark, folder, "text").select(F.col("key").alias("essay_id"), "text")
    todo = trace.jobs(table(spark, folder, "assignments"), anchors, family_table(spark, INVENTORY), "T {ANCHOR_RESPONSE} {OUTPUT_KEY}", "own_v1", ["anchor_id", "dialect_family"], done=done)
    return trace.generate(todo, offline_client, "offline").select("trace_id", "output_key", "prompt_version", "anchor_text", "raw_output", "generation_status")


# reports -------------------------------------------------------------------------------------------------------
def _block_sql(title: str, c: str) -> str:
    return f"'{title}', '', '```text', coalesce(nullif({oracle.strip(c)}, ''), '[EMPTY]'), '```', ''"


def _lines_sql(lines: str, k1: str, k2: str, k3: str, k4: str, source: str) -> str:
    return f"SELECT * FROM (SELECT {k1}::INT AS k1, {k2} AS k2, {k3} AS k3, {k4}::BIGINT AS k4, generate_subscripts(l, 1) - 1 AS k5, unnest(l) AS line FROM (SELECT *, [{lines}] AS l FROM {source})) WHERE line IS NOT NULL"


@query(f"""WITH {_KNOWN}, rows AS (SELECT DISTINCT candidate_id, anchor_id, dialect_family, candidate_index, generation_status, model, candidate_response FROM candidates),
total AS (SELECT count(DISTINCT anchor_id) AS a, count(*) AS n FROM rows),
heads AS (SELECT r.anchor_id, families, text, score_band, normalized_score FROM (SELECT anchor_id, string_agg(DISTINCT coalesce(dialect_family, ''), ', ' ORDER BY coalesce(dialect_family, '')) AS families FROM rows GROUP BY 1) r LEFT JOIN known ON r.anchor_id = key)
SELECT * REPLACE (k5::INT AS k5) FROM ({_lines_sql("'# Candidate review', '', 'Total anchors with candidates: ' || a, 'Total candidate records: ' || n, ''", '0', "''", "''", '0', 'total')}
UNION ALL {_lines_sql("'## Anchor ' || anchor_id, '- Dialect family: ' || families, '- Score band: ' || nullif(score_band, ''), '- Normalized score: ' || nullif(normalized_score, ''), '', " + _block_sql('Original anchor response:', "coalesce(text, '')"), '1', 'anchor_id', "''", '-1', 'heads')}
UNION ALL {_lines_sql("'### Candidate ' || coalesce(candidate_index, 0) || ' - ' || coalesce(dialect_family, ''), '- Candidate ID: `' || candidate_id || '`', '- Status: `' || coalesce(generation_status, '') || '`', '- Model: `' || coalesce(model, '') || '`', '', " + _block_sql('Candidate response:', "coalesce(candidate_response, '')"), '1', 'anchor_id', "coalesce(dialect_family, '')", 'coalesce(candidate_index, 0)', 'rows')})""")
def review_lines(spark, folder):
    about = known_anchors(spark, folder, "text", "score_band", "normalized_score").select(F.col("key").alias("anchor_id"), F.col("text").alias("anchor_response"), "score_band", "normalized_score")
    rows = table(spark, folder, "candidates").select("candidate_id", "anchor_id", "dialect_family", "candidate_index", "generation_status", "model", "candidate_response").distinct()
    return reports.candidate_report(rows, about)


@query(f"""WITH RECURSIVE {_TRACED}, told AS (SELECT *, {oracle.strip('y')} <> {oracle.strip('x')} AS changed, CASE WHEN NOT ok THEN 'parse_error' WHEN len(fixes) > 0 THEN 'needs_review_student_text_correction' ELSE 'ok' END AS status FROM traced),
total AS (SELECT count(*) AS n, count(*) FILTER (changed) AS c, sum(made::INT) AS a, count(*) FILTER (len(fixes) > 0) AS f FROM told)
SELECT * REPLACE (k5::INT AS k5) FROM ({_lines_sql("'# Trace comparison', '', 'Total trace records: ' || n, 'Records with changed output: ' || c, 'Applied feature count: ' || a, 'Records with possible student-text corrections: ' || f, ''", '0', "''", "''", '0', 'total')}
UNION ALL {_lines_sql("'## Anchor ' || anchor_id, '- Dialect family: `' || coalesce(dialect_family, '') || '`', '- Status: `' || status || '`', '- Changed output: `' || changed || '`', '- Applied features: `' || made::INT || '`', '- Possible student-text corrections: `' || len(fixes) || '`', '', " + _block_sql('Anchor:', 'x') + ', ' + _block_sql('Trace output:', 'y') + ", CASE WHEN made THEN 'Applied feature trace:' || chr(10) || '- `f1`: `it` -> `It`' || chr(10) END, CASE WHEN made THEN 'Rejected feature trace:' || chr(10) || '- `f2`: none' || chr(10) END, CASE WHEN len(fixes) > 0 THEN 'Possible student-text corrections:' || chr(10) || array_to_string(list_transform(fixes, lambda f: '- `' || f || '`'), chr(10)) || chr(10) END, CASE WHEN made THEN 'Trace note: noted' || chr(10) END", '1', 'anchor_id', 'id', '0', 'told')})""")
def trace_lines(spark, folder):
    return reports.trace_report(cut(traced_rows(spark, folder).withColumn("trace_id", F.col("candidate_id"))))
