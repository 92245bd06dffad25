"""Record files: CSV with string fields, JSON lines, whole JSON documents, and line reports."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header: every field a string, '' for an empty one; a byte-order mark and quoted line ends are fine."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"', encoding="UTF-8").fillna("")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped, a bad line fails when it is read. With a schema nothing is inferred."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_records(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """By suffix: ``.csv`` in any case is CSV, anything else JSON lines."""
    return read_csv(spark, path) if path.lower().endswith(".csv") else read_jsonl(spark, path, schema)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``number`` (from 1) and ``line`` (text) of lines that are no JSON object; blank lines are fine.

    Files may be read in blocks: a line's number is its place in its block and the lines of the blocks before.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"), F.regexp_replace("value", "^" + chr(0xFEFF), "").alias("line"),
    )
    blocks = lines.groupBy("_path", "_block").agg(F.min("_at").alias("_least"), F.count("*").alias("_size"))
    before = Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = blocks.select("_path", "_block", "_least", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_first"))
    bad = lines.where((F.trim("line") != "") & (F.try_parse_json("line").isNull() | ~F.trim("line").startswith("{")))
    return bad.join(firsts, ["_path", "_block"]).select("file", (F.col("_at") - F.col("_least") + F.col("_first") + 1).alias("number"), "line")


def read_checked_jsonl(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """:func:`read_jsonl`, after a pass over the lines; a bad one is a ValueError that names its file and number."""
    first = bad_lines(spark, path).orderBy("file", "number").limit(1).collect()
    if first:
        raise ValueError(f"no JSON object on line {first[0].number} of {first[0].file}")
    return read_jsonl(spark, path, schema)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with sorted keys, ASCII only, nulls written; replaces what is there."""
    out = df.select(*sorted(df.columns))
    out.write.mode("overwrite").option("writeNonAsciiCharacterAsCodePoint", "true").option("ignoreNullFields", "false").json(path)


def read_json(path: str):
    """One JSON document of a small configuration file, read by the driver; a byte-order mark is fine."""
    return json.loads(Path(path).read_text(encoding="utf-8-sig"))


def read_template(path: str) -> str:
    return Path(path).read_text(encoding="utf-8-sig")


def write_lines(lines: DataFrame, path: str, order: list[str], bom: bool = False) -> None:
    """A text file of the column ``line`` in the given order. Lines come to the driver a partition at a time."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with target.open("w", encoding="utf-8-sig" if bom else "utf-8", newline="\n") as f:
        for k, row in enumerate(lines.orderBy(*order).select("line").toLocalIterator()):
            f.write("\n" * (k > 0) + (row[0] or ""))


def load_env(path: str) -> dict[str, str]:
    """Set ``KEY=VALUE`` lines that the environment does not have yet; returns those set. A missing file sets none."""
    target, out = Path(path), {}
    if not target.exists():
        return out
    for raw in target.read_text(encoding="utf-8-sig").splitlines():
        name, eq, value = raw.partition("=")
        name = name.strip()
        if not eq or name.startswith("#") or not name or name in os.environ:
            continue
        out[name] = os.environ[name] = value.strip().strip("\"'")
    return out


def page(df: DataFrame, n: int, size: int = 1, order: list[str] | None = None) -> list:
    """Rows of page ``n`` (from 1) in a stable order."""
    keys = order or df.columns
    return df.orderBy(*keys).offset(max(0, n - 1) * size).limit(size).collect()


def browsed(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Records to page through; a ValueError if there is none."""
    rows = read_jsonl(spark, path, schema)
    if rows.isEmpty():
        raise ValueError(f"no record in {path}")
    return rows


def required_key(name: str, env_file: str | None = None) -> str:
    """An environment variable, or the one of an ``.env`` file; a ValueError if it is missing or empty."""
    if env_file:
        load_env(env_file)
    key = os.environ.get(name, "").strip()
    if not key:
        raise ValueError(f"{name} is not set")
    return key
