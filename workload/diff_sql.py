"""The line diff of :mod:`auditspan.functions.diffs`, written once more in SQL."""
from __future__ import annotations


def diff_cte(source: str, key: str, old: str, new: str, context: int, labels: tuple[str, str] = ("", "")) -> str:
    """CTEs up to ``diffs`` (key, diff) of the rows of ``source``; they need WITH RECURSIVE."""
    def lines(column: str) -> str:
        return f"regexp_extract_all({column}, '[^' || chr(10) || ']*' || chr(10) || '|[^' || chr(10) || ']+')"

    def first_other(same: str, most: str) -> str:
        return f"coalesce(nullif(list_position(list_transform(range(1, {most} + 1), lambda k: {same}), FALSE), 0) - 1, {most})"

    def span(first: str, n: str) -> str:
        return f"CASE WHEN {n} = 0 THEN {first}::VARCHAR ELSE ({first} + 1)::VARCHAR END || CASE WHEN {n} = 1 THEN '' ELSE ',' || {n} END"

    return f"""d_lines AS (SELECT {key} AS key, {lines(old)} AS a, {lines(new)} AS b FROM {source} WHERE {old} IS NOT NULL AND {new} IS NOT NULL),
d_head AS (SELECT *, {first_other('a[k] = b[k]', 'least(len(a), len(b))')} AS p FROM d_lines),
d_ends AS (SELECT *, {first_other('a[len(a) - k + 1] = b[len(b) - k + 1]', '(least(len(a), len(b)) - p)')} AS s FROM d_head),
d_old AS (SELECT key, i, row_number() OVER (PARTITION BY key, line ORDER BY i) AS o, line FROM
  (SELECT key, i, a[i] AS line FROM (SELECT key, a, unnest(range(p + 1, len(a) - s + 1)) AS i FROM d_ends))),
d_new AS (SELECT key, j, row_number() OVER (PARTITION BY key, line ORDER BY j) AS o, line FROM
  (SELECT key, j, b[j] AS line FROM (SELECT key, b, unnest(range(p + 1, len(b) - s + 1)) AS j FROM d_ends))),
d_pairs AS (SELECT key, list(i ORDER BY i) AS xs, list(j ORDER BY i) AS ys FROM d_old JOIN d_new USING (key, line, o) GROUP BY key),
d_rising AS (SELECT key, ys, 0 AS n, []::BIGINT[] AS lens FROM d_pairs
  UNION ALL SELECT key, ys, n + 1, list_append(lens, 1 + coalesce(list_max(list_transform(
    list_filter(range(1, n + 1), lambda q: ys[q] < ys[n + 1]), lambda q: lens[q])), 0)) FROM d_rising WHERE n < len(ys)),
d_run AS (SELECT key, lens, len(lens) - list_position(list_reverse(lens), list_max(lens)) + 1 AS spot FROM d_rising WHERE n = len(ys)
  UNION ALL SELECT key, lens, list_max(list_filter(range(1, spot), lambda q: lens[q] = lens[spot] - 1)) FROM d_run WHERE lens[spot] > 1),
d_kept AS (SELECT key, xs[spot] AS i, ys[spot] AS j FROM d_run JOIN d_pairs USING (key)
  UNION ALL SELECT key, k, k FROM (SELECT key, unnest(range(1, p + 1)) AS k FROM d_ends)
  UNION ALL SELECT key, len(a) - s + k, len(b) - s + k FROM (SELECT key, a, b, s, unnest(range(1, s + 1)) AS k FROM d_ends)),
d_entries AS (SELECT key, 2 AS kind, i AS spot, row_number() OVER (PARTITION BY key ORDER BY i) - 1 AS gap FROM d_kept
  UNION ALL SELECT key, 0, i, (SELECT count(*) FROM d_kept k WHERE k.key = x.key AND k.i < x.i)
    FROM (SELECT key, unnest(range(1, len(a) + 1)) AS i FROM d_ends) x ANTI JOIN d_kept USING (key, i)
  UNION ALL SELECT key, 1, j, (SELECT count(*) FROM d_kept k WHERE k.key = x.key AND k.j < x.j)
    FROM (SELECT key, unnest(range(1, len(b) + 1)) AS j FROM d_ends) x ANTI JOIN d_kept USING (key, j)),
d_script AS (SELECT *, row_number() OVER w AS pos, count_if(kind <> 1) OVER w - (kind <> 1)::INT AS before_old,
    count_if(kind <> 0) OVER w - (kind <> 0)::INT AS before_new,
    bool_or(kind <> 2) OVER (PARTITION BY key ORDER BY gap, kind, spot ROWS BETWEEN {context} PRECEDING AND {context} FOLLOWING) AS shown
  FROM d_entries WINDOW w AS (PARTITION BY key ORDER BY gap, kind, spot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
d_shown AS (SELECT *, pos - row_number() OVER (PARTITION BY key ORDER BY pos) AS hunk FROM d_script WHERE shown),
d_hunks AS (SELECT key, hunk, min(before_old) AS o1, count_if(kind <> 1) AS on_, min(before_new) AS n1, count_if(kind <> 0) AS nn,
    string_agg(CASE kind WHEN 0 THEN '-' WHEN 1 THEN '+' ELSE ' ' END || CASE WHEN kind = 1 THEN b[spot] ELSE a[spot] END, '' ORDER BY pos) AS body
  FROM d_shown JOIN d_ends USING (key) GROUP BY key, hunk),
diffs AS (SELECT key, coalesce('--- {labels[0]}+++ {labels[1]}' || string_agg('@@ -' || {span('o1', 'on_')} || ' +' || {span('n1', 'nn')} || ' @@' || body, ''
  ORDER BY hunk), '') AS diff FROM d_lines LEFT JOIN d_hunks USING (key) GROUP BY key)"""
