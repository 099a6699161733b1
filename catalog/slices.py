"""The splitting rules as DuckDB SQL: one delimiter level a step downwards, one packing level a step upwards."""

from __future__ import annotations

from catalog.retrieval import BLANK_SQL
from quire.schema import MAX_CHARACTERS, MAX_TOKENS, OVERLAP_TOKENS, PROSE_DELIMITERS, TABLE_DELIMITERS

TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x0B\x1c-\x1f\x85]"


def _tokens(text: str) -> str:
    return f"len(regexp_extract_all({text}, '{TOKEN}'))"


def _strip(text: str) -> str:
    return f"trim({text}, {BLANK_SQL})"


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("\n", "' || chr(10) || '") + "'" for v in values) + "]"


def _large(text: str) -> str:
    return f"(length({text}) > {MAX_CHARACTERS} OR {_tokens(text)} > {MAX_TOKENS})"


def _level(text: str, first: str) -> str:
    """Number of the first delimiter from `first` on that the text has."""
    return f"list_filter(range({first}, len(delims) + 1), lambda i: contains({text}, delims[i]))[1]"


WIDTH = max(1, min(MAX_CHARACTERS, MAX_TOKENS * 3))
STRIDE = max(1, WIDTH - OVERLAP_TOKENS * 3)


def _pack(depth: int) -> str:
    """The packed slices of the large texts of one depth, from the parts one depth below."""
    below = f"""
  UNION ALL SELECT key, list_slice(path, 1, {depth}) AS path, path[{depth} + 1] AS idx, n, text FROM packed{depth + 1}"""
    n = depth
    return f"""
parts{n} AS (
  SELECT key, list_slice(path, 1, {n}) AS path, path[{n} + 1] AS idx, 0 AS n, text FROM nodes WHERE depth = {n + 1} AND NOT large{below if n < len(TABLE_DELIMITERS) else ""}),
units{n} AS (
  SELECT p.key, p.path, p.text, delims[lv] AS sep, row_number() OVER w AS u,
    sum({_tokens("p.text")} + {_tokens("delims[lv]")}) OVER w AS s, sum(length(p.text) + length(delims[lv])) OVER w AS z
  FROM parts{n} p JOIN nodes o ON o.key = p.key AND o.path = p.path AND o.depth = {n} WINDOW w AS (PARTITION BY p.key, p.path ORDER BY idx, n)),
held{n} AS (
  SELECT key, path, sep, {_tokens("sep")} AS st, length(sep) AS sl, count(*) AS n, list(text ORDER BY u) AS units,
    list_prepend(0, list(CAST(s AS BIGINT) ORDER BY u)) AS s, list_prepend(0, list(CAST(z AS BIGINT) ORDER BY u)) AS z
  FROM units{n} GROUP BY key, path, sep),
windows{n} AS (
  SELECT key, path, 0::BIGINT AS start, 0::BIGINT AS first, list_filter(range(1, n), lambda i: s[i + 2] - st > {MAX_TOKENS} OR z[i + 2] - sl > {MAX_CHARACTERS})[1] AS cut, 1 AS k FROM held{n}
  UNION ALL
  SELECT key, path, start, first, list_filter(range(first + 1, n), lambda i: s[i + 2] - s[start + 1] - st > {MAX_TOKENS} OR z[i + 2] - z[start + 1] - sl > {MAX_CHARACTERS})[1], k
  FROM (SELECT h.*, w.cut AS first, w.k + 1 AS k, coalesce(list_filter(range(w.start, w.cut), lambda i: s[w.cut + 1] - s[i + 1] - st <= {OVERLAP_TOKENS})[1], w.cut) AS start
        FROM windows{n} w JOIN held{n} h ON h.key = w.key AND h.path = w.path WHERE w.cut IS NOT NULL)),
packed{n} AS (
  SELECT key, path, k AS n, text FROM (
    SELECT w.key, w.path, k, {_strip("list_reduce(list_slice(units, start + 1, coalesce(cut, n)), lambda a, b: a || sep || b)")} AS text
    FROM windows{n} w JOIN held{n} h ON h.key = w.key AND h.path = w.path) WHERE text <> ''
  UNION ALL
  SELECT key, path, n, text FROM (
    SELECT key, path, n, {_strip(f"substr(text, 1 + n * {STRIDE}, {WIDTH})")} AS text
    FROM (SELECT *, unnest(range(0, 1 + greatest(0, CAST(ceil((length(text) - {WIDTH}) / {STRIDE}.0) AS BIGINT)))) AS n
          FROM nodes WHERE depth = {n} AND large AND lv IS NULL)) WHERE text <> '')"""


#: CTEs over ``whole(key, text, is_table)``, giving ``slices(key, n, total, text)``: a text that is not cut is its one slice.
SLICES = f"""
nodes AS (
  SELECT key, delims, []::BIGINT[] AS path, 0 AS depth, text, true AS large, {_level("text", "1")} AS lv
  FROM (SELECT key, text, CASE WHEN is_table THEN {_list(TABLE_DELIMITERS)} ELSE {_list(PROSE_DELIMITERS)} END AS delims
        FROM whole WHERE {_large("text")})
  UNION ALL
  SELECT key, delims, list_append(path, i), depth + 1, piece, large, CASE WHEN large THEN {_level("piece", "lv + 1")} END
  FROM (SELECT key, delims, path, depth, lv, i, piece, {_large("piece")} AS large
        FROM (SELECT key, delims, path, depth, lv, {_strip("raw")} AS piece, i
              FROM (SELECT key, delims, path, depth, lv, unnest(string_split(text, delims[lv])) AS raw,
                      unnest(range(1, len(string_split(text, delims[lv])) + 1)) AS i
                    FROM nodes WHERE large AND lv IS NOT NULL)) WHERE piece <> '')),
{",".join(_pack(d) for d in reversed(range(len(TABLE_DELIMITERS) + 1)))},
cut AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY n) - 1 AS n, count(*) OVER (PARTITION BY key) AS total, text FROM packed0),
slices AS (
  SELECT key, n, total, text FROM cut WHERE total > 1
  UNION ALL SELECT key, 0, 1, text FROM whole WHERE key NOT IN (SELECT key FROM cut WHERE total > 1))"""
