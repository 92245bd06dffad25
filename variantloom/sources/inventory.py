"""Feature inventories: one entry per group of speakers, with features, their markers and notes."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variantloom.sources.records import read_json

# Categories of features, with their headings, and the keys every feature must have.
CATEGORIES = {"lexical": "Lexical features", "syntactic": "Syntactic features", "orthographic": "Orthographic features", "discourse": "Discourse features"}
REQUIRED = ("id", "category", "feature", "source_reference", "allowed_for_generation")
# Markers that a feature implies by a part of its id, or by its whole name.
IMPLIED_BY_ID = {
    "tag_right": ["right"], "right_intensifier": ["right"], "perfective_done": ["done"], "double_modal": ["might could", "might can", "may could"],
    "needs_cleaned": ["needs"], "wants_fixed": ["wants"], "midwestern_alls": ["alls"], "a_prefixing": ["a-"], "demonstrative_them": ["them"],
}
IMPLIED_BY_NAME = {"tag question right": ["right"], "right as intensifier": ["right"], "alls construction": ["alls"], "'em": ["'em"]}
# Patterns that stand for a feature, by id or name.
HABITUAL = (
    r"\b(?:i|you|he|she|it|we|they|people|students?|kids?|children|cowboys|computers?|[a-z]+s)\s+"
    r"(?:also\s+|always\s+|usually\s+|often\s+)?be\s+[a-z]+ing\b"
)
PATTERNS = {"aae_habitual_be": HABITUAL, "habitual be": HABITUAL}

MARKER_SCHEMA = "dialect_family string, position int, marker string, pattern string"


def buckets() -> list[str]:
    return [f"allowed_{c}_features" for c in CATEGORIES]


def check(family: str, config: dict) -> dict:
    """The entry itself; ValueError where it is not well formed."""
    if "features" not in config:
        missing = [b for b in buckets() if b not in config]
        if missing:
            raise ValueError(f"inventory of {family} lacks {', '.join(missing)}")
        return config
    if not isinstance(config["features"], list):
        raise ValueError(f"inventory of {family}: features is no list")
    for feature in config["features"]:
        lacking = [k for k in REQUIRED if k not in feature]
        if lacking:
            raise ValueError(f"inventory of {family}: a feature lacks {', '.join(lacking)}")
        if feature["category"] not in CATEGORIES:
            raise ValueError(f"inventory of {family}: unknown category {feature['category']}")
    return config


def load(path: str) -> dict[str, dict]:
    """All entries, from an index (``*.index.json``: a file for each family) or one combined file."""
    data = read_json(path)
    if not isinstance(data, dict) or not all(isinstance(v, (dict, str)) for v in data.values()):
        raise ValueError("an inventory is an object with an entry for each family")
    if not path.endswith(".index.json"):
        return {family: check(family, config) for family, config in data.items()}
    out = {}
    for family, part in data.items():
        config = read_json(str(Path(path).parent / part))
        if config.get("dialect_family") != family:
            raise ValueError(f"{part} does not say it is {family}")
        out[family] = check(family, config)
    return out


def _allowed(config: dict) -> list[dict]:
    return [f for f in config.get("features") or [] if isinstance(f, dict) and f.get("allowed_for_generation")]


def labels(config: dict) -> list[str]:
    """Names of allowed features, in order."""
    if "features" in config:
        names = [str(f.get("feature", "")) for f in _allowed(config)]
    else:
        names = [str(v.get("feature", "") if isinstance(v, dict) else v) for b in buckets() for v in config.get(b) or []]
    return [n.strip() for n in names if n.strip()]


def markers(config: dict) -> list[str]:
    """What shows a feature in a text: names, listed markers and implied ones; trimmed, each once, in order."""
    out = labels(config)
    for f in _allowed(config):
        ident, name = str(f.get("id", "")).lower(), str(f.get("feature", "")).lower()
        out += [str(m) for m in f.get("detection_markers") or []]
        out += [m for part, implied in IMPLIED_BY_ID.items() if part in ident for m in implied]
        out += IMPLIED_BY_NAME.get(name, [])
    return list(dict.fromkeys(m.strip() for m in out if m.strip()))


def marker_pattern(marker: str) -> str:
    """A pattern for lower-case text that finds the marker itself; no letter, digit or ``_`` of any script may touch an end that is one."""
    low = marker.lower().strip()
    quoted = re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", low)
    return (r"(?<![\p{L}\p{N}_])" if low[:1].isalnum() else "") + quoted + (r"(?![\p{L}\p{N}_])" if low[-1:].isalnum() else "")


def marker_rows(inventory: dict[str, dict]) -> list[tuple[str, int, str, str]]:
    rows = []
    for family, config in inventory.items():
        found = [(m, marker_pattern(m)) for m in markers(config)]
        for f in _allowed(config):
            pattern = PATTERNS.get(str(f.get("id", "")).lower()) or PATTERNS.get(str(f.get("feature", "")).lower())
            name = str(f.get("feature") or f.get("id") or "").strip()
            if pattern and name:
                found.append((name, "(?U)" + pattern))  # word edges and white space of any script
        rows += [(family, k, m, p) for k, (m, p) in enumerate(found)]
    return rows


def marker_table(spark: SparkSession, inventory: dict[str, dict]) -> DataFrame:
    """A row for each family and marker: ``dialect_family``, ``position``, ``marker``, ``pattern``."""
    return spark.createDataFrame(marker_rows(inventory), MARKER_SCHEMA)


def family_table(spark: SparkSession, inventory: dict[str, dict]) -> DataFrame:
    """A row for each family: its markers as one array, its labels, and its texts for prompts."""
    by: dict[str, list] = {family: [] for family in inventory}
    for family, _, marker, pattern in marker_rows(inventory):
        by[family].append((marker, pattern))
    rows = [(f, by[f], labels(c), described(c), warned(c), json.dumps(c, ensure_ascii=False, indent=2)) for f, c in inventory.items()]
    return spark.createDataFrame(rows, "dialect_family string, markers array<struct<marker string, pattern string>>, labels array<string>, inventory_text string, notes_text string, inventory_json string")


# The sentences of notes on an inventory that is not approved yet.
DRAFT = "Draft status: {} requires team and/or linguist review before final benchmark use."


def _section(heading: str, values: list, glue: str) -> list[str]:
    return [f"{heading}: {glue.join(map(str, values))}"] if values else []


def _named(feature: dict) -> str:
    extras = [(" ({})", feature.get("description")), (" Avoid: {}", feature.get("blocked_context"))]
    return str(feature["feature"]) + "".join(form.format(value) for form, value in extras if value)


def described(config: dict) -> str:
    """The allowed features by category, as lines for a prompt; a section without entries is left out."""
    new = "features" in config
    by = {c: [_named(f) for f in _allowed(config) if f.get("category") == c] if new else config.get(f"allowed_{c}_features") or [] for c in CATEGORIES}
    sections = [(heading, by[c], "; ") for c, heading in CATEGORIES.items()]
    status = config.get("review_status")
    sections.append(("Review status", [status] if status else [], "") if new else ("Usage notes", config.get("usage_notes") or [], " "))
    return "\n".join(line for section in sections for line in _section(*section))


def warned(config: dict) -> str:
    """Disallowed features and notes, as lines for a prompt."""
    sections = [("Disallowed features", config.get("disallowed_features") or [], "; "), ("Safety notes", config.get("safety_notes") or [], " ")]
    lines = [line for section in sections for line in _section(*section)]
    status = config.get("review_status")
    open_review = status if status and status != "approved" else "this inventory" if config.get("needs_linguist_review") else None
    return "\n".join(lines + [DRAFT.format(open_review)] * bool(open_review))


def checked(features: DataFrame) -> DataFrame:
    """Exploded features with a failing check where one is not well formed (for inventories kept as tables)."""
    good = F.col("category").isin(list(CATEGORIES)) & F.col("id").isNotNull() & F.col("feature").isNotNull() & F.col("allowed_for_generation").isNotNull()
    return features.where(F.coalesce(good, F.lit(False)) | F.raise_error(F.concat(F.lit("bad feature "), F.coalesce("id", F.lit("without id")))).isNotNull())
