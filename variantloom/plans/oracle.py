"""SQL of sequence alignment and of the rules upon it, for DuckDB, written from the definitions and not from the operators.

The longest matching block of two sequences, the one that starts first in the first and then in the second,
splits them in two windows, and so on: a recursive query holds a row for each window. Blocks are found among
diagonal runs of equal elements, cut to the window. Where the second sequence has 200 elements or more, those
that make up over 1 % of it start no block, but lengthen one.
"""

from __future__ import annotations

WORDS = "regexp_extract_all({}, '[A-Za-z][A-Za-z'']*')"
LOWER = "list_transform(" + WORDS + ", lambda x: lower(x))"
#: White space of any script at either end.
_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def rounded(c: str, digits: int = 4) -> str:
    """Correctly rounded from the binary value."""
    return f"format('{{:.{digits}f}}', {c})::DOUBLE"


def matched(p: str, source: str) -> str:
    """CTEs ``<p>_w`` (a block ``i``, ``j``, ``k`` for each window) and ``<p>_seq`` of ``source``: ``id`` and lists ``a``, ``b``."""
    reach = "coalesce(list_position(list_transform(range(1, {m} + 1), lambda x: s.a[{a}] = s.b[{b}]), false) - 1, {m})"
    left = reach.format(m="least(t.i - alo, t.j - blo)", a="t.i - x + 1", b="t.j - x + 1")
    right = reach.format(m="least(ahi - t.i - k, bhi - t.j - k)", a="t.i + k + x", b="t.j + k + x")
    skip, size = "greatest(0, alo - r.i, blo - r.j)", "least(r.n, ahi - r.i, bhi - r.j) - greatest(0, alo - r.i, blo - r.j)"
    return f"""{p}_seq AS MATERIALIZED (SELECT id, a, b, len(a) AS na, len(b) AS nb FROM {source}),
{p}_a AS (SELECT id, unnest(a) AS e, generate_subscripts(a, 1) - 1 AS i FROM {p}_seq),
{p}_b AS (SELECT id, nb, unnest(b) AS e, generate_subscripts(b, 1) - 1 AS j FROM {p}_seq),
{p}_seed AS (SELECT id, e, j FROM (SELECT *, count(*) OVER (PARTITION BY id, e) AS c FROM {p}_b) WHERE NOT (nb >= 200 AND c > nb // 100 + 1)),
{p}_cell AS (SELECT id, i, j FROM {p}_a JOIN {p}_seed USING (id, e)),
{p}_run AS MATERIALIZED (SELECT id, min(i) AS i, min(j) AS j, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY id, j - i ORDER BY i) AS island FROM {p}_cell) GROUP BY id, j - i, island),
{p}_w AS (SELECT id, 0::BIGINT AS alo, na AS ahi, 0::BIGINT AS blo, nb AS bhi, na AS i, nb AS j, 0::BIGINT AS k FROM {p}_seq
 UNION ALL SELECT id, alo, ahi, blo, bhi, i - l AS i, j - l AS j, k + l + r AS k FROM (
  SELECT t.*, CASE WHEN t.nb < 200 THEN 0 ELSE {left} END AS l, CASE WHEN t.nb < 200 THEN 0 ELSE {right} END AS r
  FROM (SELECT id, alo, ahi, blo, bhi, max(nb) AS nb, CASE WHEN max(c.n) > 0 THEN -max(c).i ELSE alo END AS i, CASE WHEN max(c.n) > 0 THEN -max(c).j ELSE blo END AS j, coalesce(max(c.n), 0) AS k
   FROM (SELECT v.*, s.nb, CASE WHEN {size} > 0 THEN {{'n': {size}, 'i': -(r.i + {skip}), 'j': -(r.j + {skip})}} END AS c
    FROM (SELECT id, alo, i AS ahi, blo, j AS bhi FROM {p}_w WHERE alo < i AND blo < j UNION ALL SELECT id, i + k, ahi, j + k, bhi FROM {p}_w WHERE k > 0 AND i + k < ahi AND j + k < bhi) v
    JOIN {p}_seq s USING (id) LEFT JOIN {p}_run r ON r.id = v.id) GROUP BY id, alo, ahi, blo, bhi) t JOIN {p}_seq s USING (id)))"""


def ratios(p: str) -> str:
    """CTE ``<p>_ratio``: ``id``, ``ratio`` and ``unmatched`` (elements of either that no block holds)."""
    return f"{p}_ratio AS MATERIALIZED (SELECT id, CASE WHEN na + nb = 0 THEN 1.0 ELSE 2.0 * m / (na + nb) END AS ratio, (na + nb - 2 * m)::INT AS unmatched FROM {p}_seq JOIN (SELECT id, sum(k)::BIGINT AS m FROM {p}_w GROUP BY id) USING (id))"


def gaps(p: str) -> str:
    """CTE ``<p>_gap``: what lies between blocks, ``a0`` to ``a1`` and ``b0`` to ``b1`` (from 0, the end not in it)."""
    return f"""{p}_block AS (SELECT id, i, j, k FROM {p}_w WHERE k > 0 UNION ALL SELECT id, na, nb, 0 FROM {p}_seq),
{p}_gap AS MATERIALIZED (SELECT * FROM (SELECT id, coalesce(lag(i + k) OVER o, 0) AS a0, i AS a1, coalesce(lag(j + k) OVER o, 0) AS b0, j AS b1 FROM {p}_block WINDOW o AS (PARTITION BY id ORDER BY i, j, k DESC)) WHERE a0 < a1 OR b0 < b1)"""


def corrections(p: str, source: str) -> str:
    """CTE ``<p>_fix``: ``id`` and ``fixes`` (sorted ``before -> after``), for alignment ``p`` of the words of ``source``: ``id``, texts ``x`` and ``y``, lower-case ``excused``."""
    return f"""{p}_chg AS MATERIALIZED (SELECT id, array_to_string(list_slice({WORDS.format('x')}, a0 + 1, a1), ' ') AS before, array_to_string(list_slice({WORDS.format('y')}, b0 + 1, b1), ' ') AS after, excused FROM {p}_gap JOIN {source} USING (id) WHERE a0 < a1 AND b0 < b1),
{p}_odd AS (SELECT DISTINCT lower(before) AS u, lower(after) AS v FROM {p}_chg WHERE before NOT LIKE '% %' AND after NOT LIKE '% %' AND lower(before) <> lower(after) AND length(before) >= 3 AND length(after) >= 3),
{p}_pairs AS (SELECT u || ' ' || v AS id, string_split(u, '') AS a, string_split(v, '') AS b FROM {p}_odd),
{matched(p + 's', p + '_pairs')}, {ratios(p + 's')},
{p}_respelt AS (SELECT u, v FROM {p}_odd JOIN {p}s_ratio ON id = u || ' ' || v WHERE ratio >= 0.74 OR levenshtein(u, v) <= 1),
{p}_fix AS MATERIALIZED (SELECT id, list_sort(list_distinct(list(before || ' -> ' || after))) AS fixes FROM {p}_chg JOIN {p}_respelt ON lower(before) = u AND lower(after) = v WHERE NOT list_contains(excused, u) AND NOT list_contains(excused, v) GROUP BY id)"""


def joined(c: str) -> str:
    return f"coalesce(array_to_string({c}, '|'), '')"


def reasons(*pairs: tuple[str, str]) -> str:
    """List of the names whose condition holds, in order."""
    return "list_filter([" + ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in pairs) + "], lambda x: x IS NOT NULL)"
