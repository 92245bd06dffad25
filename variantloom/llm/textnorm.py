"""One consistent form for text that looks the same but is written with different characters.

The form of a text, in this order:

1. invisible characters go (soft hyphen, zero-width space, word joiner, byte-order mark, direction marks);
   a zero-width joiner inside an emoji sequence stays, as do joiners between letters of scripts that need
   them;
2. special spaces become U+0020, line and paragraph separators a line feed, special hyphens ``-``;
3. compatibility forms and separate accents are composed (NFKC);
4. look-alike letters: the dominant script of a token decides. In a token that mixes scripts, letters of the
   others are replaced by look-alikes of the dominant script (Latin, Cyrillic, Greek or Armenian) when the
   result is a word of the corpus; else the token's next script is tried. Only tokens of one script are
   corpus words. A token wholly of another script than the words on both its sides is no mixed token: it is
   left alone as a quotation, unless it is one letter that looks like a word of one Latin letter, or the
   same text also has it in Latin letters.

Ordinary accented letters, curly quotes, dashes, emoji and ASCII white space are left alone; so are texts
wholly in another script. A null text stays null, an empty one stays empty.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variantloom.session import cut, ship

ZWNJ, ZWJ = chr(0x200C), chr(0x200D)


def _text(*codes) -> str:
    return "".join(chr(c) for part in codes for c in part)


def _class(*spans: tuple[int, int]) -> str:
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in spans) + "]"


# Characters without a glyph of their own.
INVISIBLE = _text((0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E), range(0x200B, 0x2010), range(0x202A, 0x202F), range(0x2060, 0x2065), range(0x2066, 0x2070), (0x3164, 0xFEFF, 0xFFA0))
# Space characters other than U+0020, and hyphens other than U+002D.
SPACES = _text((0xA0, 0x1680), range(0x2000, 0x200B), (0x202F, 0x205F, 0x3000))
HYPHENS = _text((0x2010, 0x2011, 0xFE63, 0xFF0D))
SEPARATORS = _text((0x85, 0x2028, 0x2029))
# Cyrillic and Greek letters and the Latin letters they look like (several where doubtful).
CYRILLIC = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ү": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "Ӏ": "I", "М": "M",
    "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Ү": "Y", "Х": "X", "Ԝ": "W", "Ԛ": "Q", "Ѵ": "V",
    "ё": "ë", "Ё": "Ë", "ї": "ï", "Ї": "Ï",
}
GREEK = {
    "α": "a", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "γ": "y", "ω": "w", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ά": "á", "έ": "é", "ί": "í", "ό": "ó", "ύ": "ú",
}
# Letters of other blocks.
OTHERS = {"օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "ı": "i", "ɑ": "a", "ɡ": "g"}

LOOKALIKES = {**CYRILLIC, **GREEK, **OTHERS}
FOLD = {ord(k): v for k, v in LOOKALIKES.items()}
_FIRST = {ord(c): None for c in INVISIBLE if c not in (ZWNJ, ZWJ)} | {ord(c): " " for c in SPACES} | {ord(c): "\n" for c in SEPARATORS} | {ord(c): "-" for c in HYPHENS}
#: Control characters that are no white space of ASCII.
_FIRST |= {c: None for c in [*range(0, 9), *range(14, 32), *range(127, 160)] if c not in (0x85, 0x1C, 0x1D, 0x1E, 0x1F)}
_JOINERS = re.compile(f"[{ZWNJ}{ZWJ}]")
#: Scripts whose spelling needs joiners: Arabic, Syriac, the Indic blocks up to Sinhala, Myanmar, Khmer, Mongolian.
_NEEDS = re.compile(_class((0x600, 0x8FF), (0x900, 0xDFF), (0x1000, 0x109F), (0x1780, 0x18AF)))
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_FOREIGN = re.compile("[" + "".join(LOOKALIKES) + "]")
#: Letters outside Latin, Greek, Cyrillic and Armenian never take part in look-alike repair.
_SCRIPTS = {
    "Latin": re.compile("[A-Za-z" + _class((0xC0, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF))[1:]), "Greek": re.compile(_class((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    "Cyrillic": re.compile(_class((0x400, 0x52F))), "Armenian": re.compile(_class((0x530, 0x58F))),
}
_LATIN = _SCRIPTS["Latin"]
_OTHER_LETTER = re.compile(_class((0x370, 0x58F), (0x1F00, 0x1FFF)))
#: Of each script but Latin, its letter for a Latin one; the first that the tables name.
_INTO = {name: {v: k for k, v in reversed(table.items())} for name, table in (("Cyrillic", CYRILLIC), ("Greek", GREEK), ("Armenian", {k: v for k, v in OTHERS.items() if "\u0530" <= k <= "\u058f"}))}
# Greek letters that resemble a Latin one without looking the same; alone they stay.
_UNLIKE = set("αεηικντυχγωρ")
_OPEN, _CLOSE = set("\"'«“‘„([<*_`"), set("\"'»”’“)]>*_`")


def _joiner(m: re.Match) -> str:
    text, at = m.string, m.start()
    before, after = text[at - 1 : at], text[at + 1 : at + 2]
    if before and after:
        if _NEEDS.match(before) and _NEEDS.match(after):
            return m.group()
        emoji = lambda c: ord(c) >= 0x2190 and unicodedata.category(c) in ("So", "Sk", "Mn", "Me")
        if m.group() == ZWJ and emoji(before) and emoji(after):
            return m.group()
    return ""


def base_form(text: str) -> str:
    """Steps 1 to 3, which need no vocabulary."""
    if text.isascii():
        return text.translate(_FIRST) if _CONTROL.search(text) else text
    if _ODD.search(text):  # a search is far cheaper than translate, which few texts need
        text = text.translate(_FIRST)
    if ZWJ in text or ZWNJ in text:
        text = _JOINERS.sub(_joiner, text)
    return text if unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)


_ODD = re.compile("[" + re.escape("".join(map(chr, _FIRST))) + "]")
_CONTROL = re.compile("[\x00-\x08\x0e-\x1b\x7f]")


def _script(c: str) -> str | None:
    return next((name for name, letters in _SCRIPTS.items() if letters.match(c)), None)


def _written_in(token: str, script: str) -> str | None:
    """The token with every letter in one script; None if a letter has no look-alike there."""
    out = []
    for c in token:
        if not c.isalpha() or _script(c) == script and not (script == "Latin" and c in FOLD_LATIN):
            out.append(c)
            continue
        latin = LOOKALIKES.get(c, c)
        other = latin if script == "Latin" else _INTO[script].get(latin)
        if other is None or script == "Latin" and not _LATIN.match(other):
            return None
        out.append(other)
    return "".join(out)


#: Letters of Latin blocks that are look-alikes of others.
FOLD_LATIN = {c for c in OTHERS if _LATIN.match(c)}


def suspects(text: str) -> list[tuple[int, int, list[str]]]:
    """Start, end and readings, the likeliest first, of each token of a base form whose look-alikes may have to be replaced."""
    if text.isascii() or not _FOREIGN.search(text):
        return []
    tokens, out = list(_TOKEN.finditer(text)), []
    plain = None
    for k, m in enumerate(tokens):
        token = m.group()
        if token.isascii() or not _FOREIGN.search(token):
            continue
        count = Counter("lookalike" if c in FOLD_LATIN else _script(c) for c in token if c.isalpha())
        if None in count:
            continue
        if len(count) > 1:
            order = sorted((name for name in count if name != "lookalike"), key=lambda n: (-count[n], n != "Latin"))
            readings = [r for r in (_written_in(token, name) for name in order) if r and r != token]
        else:
            if text[m.start() - 1 : m.start()] in _OPEN and text[m.end() : m.end() + 1] in _CLOSE and m.start() and m.end() < len(text):
                continue  # in marks of its own
            if "lookalike" not in count and not all(t is None or _LATIN.match(t.group()[0]) for t in (tokens[k - 1] if k else None, tokens[k + 1] if k + 1 < len(tokens) else None)):
                continue
            readings = [r for r in [_written_in(token, "Latin")] if r]
            if len(token) == 1 and "lookalike" not in count:
                readings = [] if token in _UNLIKE or len(tokens) < 2 else readings
            elif readings:
                plain = plain if plain is not None else {t.group().lower() for t in tokens if t.group().isascii()}
                readings = [r for r in readings if r.lower() in plain]
        if readings:
            out.append((m.start(), m.end(), readings))
    return out


def repaired(text: str, words: set[str]) -> str:
    """Step 4 on a base form; ``words`` holds the lower-case readings that are corpus words."""
    for start, end, readings in reversed(suspects(text)):
        read = next((r for r in readings if r.lower() in words), None)
        if read:
            text = text[:start] + read + text[end:]
    return text


_KEY = re.compile(r"[^\W_]+")


#: ASCII characters that part words, as spaces.
_PARTS = {c: " " for c in range(128) if not chr(c).isalnum()}


def plain_words(low: str) -> list[str]:
    """Runs of letters and digits of a lower-case ASCII text; several times faster than the pattern."""
    return low.translate(_PARTS).split()


def folded(text: str) -> str:
    """Every look-alike letter as its Latin reading."""
    if text.isascii():
        return text
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return text.translate(FOLD) if _FOREIGN.search(text) else text


def comparison_words(text: str) -> list[str]:
    """Lower-case runs of letters and digits under which look-alikes and invisible characters make no difference."""
    if text.isascii() and not _CONTROL.search(text):
        return plain_words(text.lower())
    return _KEY.findall(folded(base_form(text).lower()))


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base form and readings of suspect tokens of each text."""
    for batch in batches:
        base = [None if t is None else base_form(t) for t in batch.column("_t").to_pylist()]
        words = [sorted({r.lower() for x in suspects(b) for r in x[2]}) if b else [] for b in base]
        yield pa.RecordBatch.from_arrays([batch.column("_k"), batch.column("_t"), pa.array(base, pa.string()), pa.array(words, pa.list_(pa.string()))], names=["_k", "_t", "_b", "_w"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a partition with their counts, handed on whenever there are many."""
    count: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["_word", "_n"])
        count.clear()
        return out

    for batch in batches:
        for t in batch.column(0).to_pylist():
            if t:
                count.update(_TOKEN.findall(t.lower()) if t.isascii() else [w for w in _TOKEN.findall(t.lower()) if w.isascii() or len({_script(c) for c in w if c.isalpha()}) == 1])
        if len(count) > 200_000:
            yield flush()
    yield flush()


def consistent_form(df: DataFrame, key: str = "candidate_id", text: str = "candidate_response", min_count: int = 1) -> DataFrame:
    """The consistent form of every row's text.

    Returns ``key``, ``text`` (as given), ``consistent`` and ``changed`` (false for null and empty texts);
    one row per input row, other columns are not carried. ``min_count`` is how often a word must occur in
    the whole corpus to be vocabulary.

    Texts of as many bytes as characters are ASCII and never leave the JVM for their form. Words of the
    corpus are counted over all rows, a partition at a time before they are shuffled, and meet only the
    readings of suspect tokens in a join; the few rows with suspect tokens then get their own accepted
    readings. Nothing is gathered in one place.
    """
    ship(df.sparkSession)
    base = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    odd = (F.length("_t") != F.octet_length("_t")) | F.col("_t").rlike("[" + r"\x00-\x08\x0e-\x1b\x7f" + "]")
    plain = base.where(F.col("_t").isNull() | ~odd).select("_k", "_t", F.col("_t").alias("_c"))
    kind = df.schema[key].dataType.simpleString()
    formed = base.where(odd).mapInArrow(_forms, f"_k {kind}, _t string, _b string, _w array<string>")
    easy = formed.where(F.size("_w") == 0).select("_k", "_t", F.col("_b").alias("_c"))
    hard = cut(formed.where(F.size("_w") > 0).withColumn("_row", F.xxhash64("_k", "_t")))
    words = hard.select("_row", F.explode("_w").alias("_word")).distinct()
    vocabulary = base.select("_t").mapInArrow(_word_counts, "_word string, _n bigint").groupBy("_word").agg(F.sum("_n").alias("_n")).where(F.col("_n") >= min_count).select("_word")
    known = words.select("_word").distinct().join(vocabulary, "_word", "left_semi")
    accepted = words.join(known, "_word", "left_semi").groupBy("_row").agg(F.collect_set("_word").alias("_known"))
    mend = F.pandas_udf(lambda b, k: pd.Series([repaired(x, set() if y is None else set(y)) for x, y in zip(b, k)]), "string")
    mended = hard.join(accepted, "_row", "left").select("_k", "_t", mend("_b", "_known").alias("_c"))
    out = plain.unionByName(easy).unionByName(mended)
    return out.select(F.col("_k").alias(key), F.col("_t").alias(text), F.col("_c").alias("consistent"), F.coalesce(~F.col("_t").eqNullSafe(F.col("_c")), F.lit(False)).alias("changed"))
