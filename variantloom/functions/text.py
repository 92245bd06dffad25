"""Text expressions that stay in the JVM, with one tokenizer for each purpose.

Null texts count as empty ones unless a function says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``str.strip`` and ``str.split`` see it (a fixed set), for a regular expression.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A character of a word in the sense of Unicode letters, numbers and the underscore.
WORD_CHAR = r"[\p{L}\p{N}_]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: str | Column) -> Column:
    """The text, '' for null."""
    return F.coalesce(col(c), F.lit(""))


def strip(c: str | Column) -> Column:
    """Without Unicode white space at either end; null stays null."""
    return F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+$", "")


def is_blank(c: str | Column) -> Column:
    """True for null, empty and white-space texts."""
    return F.coalesce(strip(c) == "", F.lit(True))


def first_filled(*columns: str | Column, blank: bool = False) -> Column:
    """The first value that is neither null nor empty (with ``blank``, nor white space); null if there is none."""
    empty = is_blank if blank else (lambda c: F.coalesce(col(c) == "", F.lit(True)))
    return F.coalesce(*(F.when(~empty(c), col(c)) for c in columns))


def word_count(c: str | Column) -> Column:
    """Chunks between white space that hold a letter, number or underscore."""
    return F.regexp_count(text(c), F.lit(rf"\S*{WORD_CHAR}\S*"))


def token_set(c: str | Column) -> Column:
    """Distinct lower-case words (Unicode letters, numbers, underscore)."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text(c), F.lit(f"({WORD_CHAR}+)"), F.lit(1)), lambda x: F.lower(x)))


def plain_words(c: str | Column) -> Column:
    """ASCII words with inner apostrophes, case kept."""
    return F.regexp_extract_all(text(c), F.lit(r"([A-Za-z][A-Za-z']*)"), F.lit(1))


def lower_words(c: str | Column) -> Column:
    """ASCII words in lower case."""
    return F.transform(plain_words(c), lambda x: F.lower(x))


def normalized(c: str | Column) -> Column:
    """Lower-case ASCII words, one space between."""
    return F.array_join(lower_words(c), " ")


def marker_form(c: str | Column) -> Column:
    """A marker in the form verdicts compare: lower case, trimmed of white space and of ``.,!?;:``, single spaces."""
    trimmed = F.regexp_replace(strip(F.lower(text(c))), r"^[.,!?;:]+|[.,!?;:]+$", "")
    return F.regexp_replace(trimmed, f"{SPACE}+", " ")


def listed(c: str | Column, separator: str = ",") -> Column:
    """Trimmed non-empty parts of a separated list; null and '' give the empty list."""
    return F.filter(F.transform(F.split(text(c), separator), lambda x: strip(x)), lambda x: x != "")


def replaced(template: str | Column, values: list[tuple[str, str | Column]]) -> Column:
    """Placeholders replaced one after the other, so that a value may hold a later placeholder."""
    start = F.lit(template) if isinstance(template, str) else template
    return reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), text(kv[1])), values, start)


def reasons(*pairs: tuple[str, Column]) -> Column:
    """The names whose condition holds, in order; a null condition does not hold."""
    return F.filter(F.array(*(F.when(cond, F.lit(name)) for name, cond in pairs)), lambda x: x.isNotNull())


def correction_pairs(c: str | Column) -> Column:
    """``before -> after`` strings as an array of structs in lower case; strings without an arrow are left out."""
    parts = F.transform(F.filter(col(c), lambda x: F.contains(x, F.lit(" -> "))), lambda x: F.split(F.lower(x), " -> ", 2))
    return F.array_distinct(F.transform(parts, lambda p: F.struct(p[0].alias("before"), p[1].alias("after"))))
