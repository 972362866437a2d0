"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

from tracewell.llm import secret_scan


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def secret_scans(source: str = "documents") -> str:
    """Every rule over every text, without an index."""
    one = []
    for rank, rule in enumerate(secret_scan.RULES):
        p = _quoted(rule.pattern)
        one.append(
            f"""SELECT rid, {rank} AS rank, '{rule.kind}' AS kind,
              unnest(list_transform(range(1, len(hits) + 1), lambda i: {{
                'start': CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT),
                'size': length(hits[i]), 'own': length(wanted[i])}})) AS s
            FROM (SELECT rid, string_split_regex(body, {p}) AS parts, regexp_extract_all(body, {p}, 0) AS hits, regexp_extract_all(body, {p}, {rule.group}) AS wanted
                  FROM d WHERE regexp_matches(body, {p}))
            """
        )
    least = " ".join(f"WHEN {rank} THEN {rule.least}" for rank, rule in enumerate(secret_scan.RULES))
    base = [r.kind for r in secret_scan.RULES if r.base]
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{k}') AS BIGINT) AS n_{k}" for k in base)
    kinds = ", ".join(f"'{k}'" for k in base)
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM {source}),
    s AS ({" UNION ALL ".join(one)}),
    k AS (SELECT rid, rank, kind, s.start AS a, s.start + s.size AS b FROM s WHERE s.own >= CASE rank {least} END)
    SELECT any_value(doc_id) AS doc_id, {counts},
      sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (kind IN ({kinds})), '')) AS base_sha256,
      coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (kind IS NOT NULL), '') AS spans
    FROM d LEFT JOIN k USING (rid) GROUP BY rid"""


JACCARD = """WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 85 * (nx.n + ny.n - k)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON r.doc_id = l.x)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""

URL_LISTS = """WITH p AS (
  SELECT page_id, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1) AS host, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path,
         DATE '2024-01-01' + CAST(page_id * 7919 % 366 AS INTEGER) AS seen FROM pages),
q AS (SELECT *, string_split(host, '.') AS l, list_filter(string_split(path, '/'), lambda s: s <> '') AS g FROM p WHERE host <> ''),
a AS (SELECT page_id, seen, depth, pattern FROM (
  SELECT page_id, seen, 0 AS depth, unnest(CASE WHEN len(l) >= 2 THEN list_transform(range(1, len(l)), lambda i: array_to_string(l[i:], '.')) ELSE [host] END) AS pattern FROM q
  UNION ALL SELECT page_id, seen, 1, host || '/' || g[1] FROM q WHERE len(g) >= 1
  UNION ALL SELECT page_id, seen, 2, host || '/' || g[1] || '/' || g[2] FROM q WHERE len(g) >= 2)),
h AS (SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 6) AS BIGINT) AS h FROM (SELECT DISTINCT pattern FROM a WHERE depth <= 1)),
d AS (SELECT *, CASE WHEN h % 2 = 0 THEN 'spam' ELSE 'legal' END AS list FROM h WHERE h % 3 <> 0),
e AS (SELECT list, pattern, DATE '2024-01-01' + CAST(h % 300 AS INTEGER) AS listed_at, 'add' AS action FROM d
  UNION ALL SELECT list, pattern, DATE '2024-01-01' + CAST(h % 300 + 1 + h % 97 AS INTEGER), 'remove' FROM d
  UNION ALL SELECT list, pattern, DATE '2024-01-01' + CAST(h % 300 + 1 + h % 97 + h % 11 AS INTEGER), 'add' FROM d),
o AS (SELECT list, pattern, listed_at, max(action) AS action FROM e GROUP BY ALL),
s AS (SELECT DISTINCT a.page_id, o.list, o.pattern FROM a JOIN o ON o.pattern = a.pattern
  WHERE o.action = 'add' AND o.listed_at = (SELECT max(x.listed_at) FROM o x WHERE x.pattern = a.pattern AND x.list = o.list AND x.listed_at <= a.seen))
SELECT p.page_id, count(s.pattern) AS n_active, coalesce(string_agg(DISTINCT s.list, ',' ORDER BY s.list), '') AS lists, count(s.pattern) > 0 AS blocked
FROM p LEFT JOIN s USING (page_id) GROUP BY p.page_id"""
