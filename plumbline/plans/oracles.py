"""DuckDB SQL for the queries in queries.py, written independently of the operators."""

from __future__ import annotations

_LINES = """(CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n\\z', ''), chr(10)) END)"""

_WINDOWS = f"""
l AS (SELECT doc_id, list_transform({_LINES}, lambda x: regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '')) AS ls FROM documents),
w AS (SELECT doc_id, ls, unnest(range(0, len(ls) - 5)) AS i FROM l WHERE len(ls) >= 6),
k AS (SELECT doc_id, i, list_slice(ls, i + 1, i + 6) AS win FROM w),
g AS (SELECT doc_id, win, list(i ORDER BY i) AS starts FROM k
      WHERE NOT list_contains(win, '') AND list_sum(list_transform(win, lambda x: strlen(x))) >= 60
      GROUP BY doc_id, win HAVING count(*) >= 3)
"""

_BLOCKS = f"""
{_WINDOWS},
o AS (SELECT *, starts[1] AS first, row_number() OVER (PARTITION BY doc_id ORDER BY starts[1]) AS rn FROM g),
r AS (SELECT doc_id, rn, first, starts, true AS told, first + 6 AS until FROM o WHERE rn = 1
      UNION ALL
      SELECT o.doc_id, o.rn, o.first, o.starts, o.first >= r.until, CASE WHEN o.first >= r.until THEN o.first + 6 ELSE r.until END
      FROM r JOIN o ON o.doc_id = r.doc_id AND o.rn = r.rn + 1)
"""

_LONG = f"""
ex AS (SELECT doc_id, unnest({_LINES}) AS t, generate_subscripts({_LINES}, 1) AS line FROM documents),
long_lines AS (SELECT doc_id, CAST(line AS BIGINT) AS line FROM ex WHERE strlen(t) >= 200)
"""

_PATHS = "p AS (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.md' AS path FROM documents)"
_SCOPES = {
    "prose": "(regexp_matches(path, '^src1/(.*/)?[^/]*\\.md$') OR regexp_matches(path, '^src2/[^/]*/[^/]*\\.md$'))",
    "english": "regexp_matches(path, '^(.*/)?en/[^/]*\\.md$')",
    "every": "true",
    "nightly": "true",
    "teens": "regexp_matches(path, '^src1[^/]/[^/]*/[^/]*5\\.md$')",
}

_SARIF = """
r AS (SELECT user_id, event_id, event_type AS text,
             CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'note' ELSE 'warning' END AS level,
             'f' || (event_id % 9) || '.go' || CASE WHEN event_id % 2 = 0 THEN ':' || (event_id % 50) ELSE '' END || ': ' AS place,
             CASE WHEN event_id % 3 = 0 THEN ' (R1)' ELSE '' END AS rule
      FROM events),
c AS (SELECT user_id, level, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT user_id, string_agg(n || ' ' || level || '(s)', ', ' ORDER BY level) AS header FROM c GROUP BY user_id)
"""

_EDGES = """
e AS (SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS n
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
      WHERE s_nationkey <> c_nationkey GROUP BY ALL),
strong AS (SELECT * FROM e WHERE n > (SELECT median(n) FROM e))
"""
_REACH = f"{_EDGES}, reach AS (SELECT src, dst FROM strong UNION SELECT reach.src, strong.dst FROM reach JOIN strong ON reach.dst = strong.src)"
_REGIONS = "rp AS (SELECT n_nationkey, r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey)"
_RANK = "CASE split_part({0}, '/', 1) WHEN 'ASIA' THEN 0 WHEN 'AMERICA' THEN 1 WHEN 'EUROPE' THEN 2 END"

_SLUG = "lower(regexp_replace(regexp_replace(replace(replace(replace(replace(replace({0}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '\\s', '-', 'g'), '[^\\p{{L}}\\p{{N}}_-]', '', 'g'))"

_HREFS = """
used AS (SELECT DISTINCT page_id, lower(h) AS label, h FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS h FROM pages)),
defined AS (SELECT page_id, lower(regexp_extract(html, '<title>([^ <]*)', 1)) AS label FROM pages WHERE regexp_extract(html, '<title>([^ <]*)', 1) <> '')
"""


def _coupling(distinct: str) -> str:
    return f"""
WITH e AS (SELECT {distinct} c_nationkey AS src, CAST(o_orderkey % 25 AS INTEGER) AS dst FROM orders JOIN customer ON o_custkey = c_custkey),
o AS (SELECT src, count(*) AS n FROM e GROUP BY src), i AS (SELECT dst, count(*) AS n FROM e GROUP BY dst)
SELECT n_nationkey AS node, coalesce(o.n, 0) AS fan_out, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) > 10 OR coalesce(i.n, 0) > 10 AS high
FROM nation LEFT JOIN o ON o.src = n_nationkey LEFT JOIN i ON i.dst = n_nationkey"""


_SUMMARY = """
l AS (SELECT doc_id, source, string_split(replace(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', ''), chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM documents),
s AS (SELECT doc_id, source, CASE WHEN len(ls) <= 20 THEN array_to_string(ls, chr(10))
      ELSE array_to_string(ls[1:20], chr(10)) || chr(10) || '… ' || (len(ls) - 20) || ' more line(s) truncated — see everything, run: check ' || doc_id END AS t FROM l)
"""

ORACLES: dict[str, str] = {
    "dup_block_findings": f"WITH RECURSIVE {_BLOCKS} SELECT doc_id, CAST(starts[len(starts)] + 1 AS BIGINT) AS line, CAST(len(starts) AS BIGINT) AS repeats, array_to_string(list_transform(starts, lambda x: CAST(x + 1 AS VARCHAR)), ', ') AS lines FROM r WHERE told",
    "dup_block_windows": f"WITH {_WINDOWS} SELECT doc_id, CAST(starts[1] AS BIGINT) AS first_start, CAST(len(starts) AS BIGINT) AS n FROM g",
    "line_explode_stats": f"WITH ex AS (SELECT doc_id, unnest({_LINES}) AS t FROM documents) SELECT doc_id, count(*) AS n_lines, CAST(sum(strlen(t)) AS BIGINT) AS n_bytes, count(*) AS last_line, CAST(sum(CASE WHEN t = '' THEN 1 ELSE 0 END) AS BIGINT) AS n_empty FROM ex GROUP BY doc_id",
    "scope_glob_match": f"WITH {_PATHS} SELECT doc_id, " + ", ".join(f"{sql} AS {name}" for name, sql in _SCOPES.items()) + " FROM p",
    "trigger_scope_selection": f"WITH {_PATHS} SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{t}' AS trigger, '{n}' AS check_name, count(*) AS files FROM p WHERE {_SCOPES[n]}" for n, t in (("prose", "edit"), ("english", "edit"), ("every", "edit"), ("teens", "edit"), ("english", "batch"), ("every", "batch"), ("nightly", "batch")))
    + ") WHERE files > 0",
    "findings_in_ranges": f"WITH {_LONG} SELECT doc_id, line FROM long_lines f WHERE EXISTS (SELECT 1 FROM labels b WHERE b.quality = 1 AND b.doc_id = f.doc_id AND f.line BETWEEN b.doc_id % 7 + 1 AND b.doc_id % 7 + 4)",
    "needle_line_ranges": """
WITH p AS (SELECT doc_id, item_id, b.text AS needle, string_split(d.text, b.text) AS parts FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''),
x AS (SELECT doc_id, item_id, needle, parts, unnest(range(1, len(parts))) AS k FROM p),
s AS (SELECT doc_id, item_id, len(needle) - len(replace(needle, chr(10), '')) AS own, k, list_sum(list_transform(parts[1:k], lambda x: len(x) - len(replace(x, chr(10), '')))) AS breaks FROM x)
SELECT doc_id, item_id, CAST(1 + breaks + (k - 1) * own AS BIGINT) AS "start", CAST(1 + breaks + k * own AS BIGINT) AS "end" FROM s""",
    "first_edit": "SELECT doc_id, CASE WHEN strpos(text, 'the') > 0 THEN md5(substr(text, 1, strpos(text, 'the') - 1) || '[the]' || substr(text, strpos(text, 'the') + 3)) END AS after_md5 FROM documents",
    "hunk_range_map": """
WITH li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS ord FROM lineitem),
h AS (SELECT l_orderkey, ord, ord * 20 + CAST(l_quantity AS INTEGER) % 10 AS ns, CAST(l_quantity AS INTEGER) % 4 AS oc, CAST(l_partkey % 5 AS INTEGER) AS nc FROM li),
h2 AS (SELECT *, ns - ord AS os, CASE WHEN nc = 0 THEN ns ELSE ns + nc - 1 END AS ne FROM h),
r AS (SELECT DISTINCT l_orderkey, l_orderkey % 90 + 10 AS a, l_orderkey % 90 + 14 AS b FROM lineitem),
f AS (SELECT r.l_orderkey, a, b, (SELECT min(ord) FROM h2 WHERE h2.l_orderkey = r.l_orderkey AND h2.ne >= a) AS hit FROM r),
s AS (SELECT f.*, h2.os, h2.oc, h2.nc, h2.ns, (SELECT coalesce(sum(x.nc - x.oc), 0) FROM h2 x WHERE x.l_orderkey = f.l_orderkey AND (f.hit IS NULL OR x.ord < f.hit)) AS moved
      FROM f LEFT JOIN h2 ON h2.l_orderkey = f.l_orderkey AND h2.ord = f.hit),
d AS (SELECT *, coalesce(nc > 0 AND b >= ns, false) AS touches FROM s)
SELECT l_orderkey, a AS new_start, b AS new_end, CAST(CASE WHEN touches THEN os ELSE greatest(a - moved, 1) END AS BIGINT) AS old_start,
       CAST(CASE WHEN touches THEN os + oc - 1 ELSE greatest(b - moved, 1) END AS BIGINT) AS old_end
FROM d WHERE NOT (touches AND oc = 0)""",
    "grace_batch": """
WITH e AS (SELECT event_id, user_id, ts, event_type <> 'error' AS passed, CASE WHEN event_id % 11 = 0 THEN 'advisory' ELSE 'blocking' END AS severity, event_id % 11 <> 0 AND event_id % 5 <> 0 AS counts FROM events),
c AS (SELECT event_id, passed, lag(passed) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM e WHERE counts)
SELECT e.event_id, CASE WHEN c.event_id IS NOT NULL AND NOT c.passed AND coalesce(c.before, true) THEN 'advisory' ELSE e.severity END AS severity FROM e LEFT JOIN c USING (event_id)""",
    "dedup_claims": """
WITH RECURSIVE k AS (SELECT event_id, ts, event_type || '-' || (user_id % 3) AS key, row_number() OVER (PARTITION BY event_type || '-' || (user_id % 3) ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT event_id, key, rn, ts AS since, true AS claimed FROM k WHERE rn = 1
      UNION ALL
      SELECT k.event_id, k.key, k.rn, CASE WHEN k.ts > r.since + INTERVAL 3600 SECOND THEN k.ts ELSE r.since END, k.ts > r.since + INTERVAL 3600 SECOND
      FROM r JOIN k ON k.key = r.key AND k.rn = r.rn + 1)
SELECT event_id, key FROM r WHERE claimed""",
    "cache_hits": """
SELECT hit, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT doc_id, doc_id % 3 <> 0 AND doc_id % 4 <> 0 AND (doc_id % 7 <> 0) AS hit FROM documents) GROUP BY hit""",
    "baseline_downgrade": """
WITH j AS (SELECT conv_id, turn, len(text) < 400 AS passed FROM conversations)
SELECT a.conv_id, a.turn, a.passed, b.passed AS base_passed, CASE WHEN NOT a.passed AND b.passed = false THEN 'advisory' ELSE 'blocking' END AS severity
FROM j a LEFT JOIN j b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1""",
    "backtest_pre_existing": """
WITH w AS (SELECT DISTINCT conv_id, turn, unnest(regexp_split_to_array(text, '[ \\n]+')) AS m FROM conversations),
f AS (SELECT * FROM w WHERE len(m) >= 9)
SELECT a.conv_id, a.turn, count(*) AS findings, CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM f b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 2 AND b.m = a.m) THEN 1 ELSE 0 END) AS BIGINT) AS pre_existing
FROM f a GROUP BY ALL""",
    "sarif_level_counts": f"WITH {_SARIF} SELECT user_id, header FROM h",
    "sarif_render": f"WITH {_SARIF} SELECT r.user_id, any_value(header) || chr(10) || string_agg(place || '[' || level || '] ' || text || rule, chr(10) ORDER BY event_id) AS output FROM r JOIN h USING (user_id) GROUP BY r.user_id",
    "import_edges": f"WITH {_EDGES} SELECT src, dst, n FROM e",
    "graph_reach": f"WITH RECURSIVE {_REACH} SELECT src, dst FROM reach",
    "graph_scc": f"WITH RECURSIVE {_REACH} SELECT a.src AS node, least(min(a.dst), a.src) AS component, count(*) AS size FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src",
    "layering_violations": f"""
WITH {_EDGES}, {_REGIONS}, x AS (SELECT a.path AS src, b.path AS dst, {_RANK.format('a.path')} AS f, {_RANK.format('b.path')} AS t FROM strong JOIN rp a ON a.n_nationkey = src JOIN rp b ON b.n_nationkey = dst)
SELECT src, dst, CAST(f AS BIGINT) AS from_layer, CAST(t AS BIGINT) AS to_layer FROM x WHERE t < f""",
    "coupling_edges": _coupling(""),
    "coupling_distinct": _coupling("DISTINCT"),
    "mermaid_lines": f"""
WITH RECURSIVE {_REACH}, {_REGIONS}, x AS (SELECT DISTINCT a.path AS src, b.path AS dst FROM strong JOIN rp a ON a.n_nationkey = src JOIN rp b ON b.n_nationkey = dst),
arrows AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS ord FROM x),
cyclic AS (SELECT path FROM rp WHERE n_nationkey IN (SELECT src FROM reach WHERE src = dst)),
ids AS (SELECT string_agg(regexp_replace(path, '[^A-Za-z0-9]', '_', 'g'), ',' ORDER BY path) AS ids FROM cyclic HAVING count(*) > 0)
SELECT CAST(0 AS BIGINT) AS part, CAST(0 AS BIGINT) AS ord, 'graph TD' AS text
UNION ALL SELECT 1, row_number() OVER (ORDER BY path) - 1 AS ord, '    ' || regexp_replace(path, '[^A-Za-z0-9]', '_', 'g') || '["' || path || '"]' AS text FROM rp
UNION ALL SELECT 2, ord, '    ' || regexp_replace(src, '[^A-Za-z0-9]', '_', 'g') || ' --> ' || regexp_replace(dst, '[^A-Za-z0-9]', '_', 'g') FROM arrows
UNION ALL SELECT 3, 0, '    classDef cycle fill:#fee2e2,stroke:#dc2626,stroke-width:2px;' FROM ids
UNION ALL SELECT 4, 0, '    class ' || ids || ' cycle;' FROM ids
UNION ALL SELECT 5, ord, '    linkStyle ' || ord || ' stroke:#dc2626,stroke-width:2px;' FROM arrows WHERE src IN (SELECT path FROM cyclic) AND dst IN (SELECT path FROM cyclic)""",
    "heading_slugs": f"""
WITH t AS (SELECT 'pages' AS path, regexp_extract(html, '<title>([^<]*)</title>', 1) AS heading, page_id AS ord FROM pages UNION ALL SELECT p_brand, p_name, p_partkey FROM part),
s AS (SELECT path, ord, {_SLUG.format('heading')} AS slug FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY path, slug ORDER BY ord) - 1 AS k FROM s)
SELECT path, ord, CASE WHEN k = 0 THEN slug ELSE slug || '-' || k END AS anchor FROM k""",
    "unused_refs": f"WITH {_HREFS} SELECT page_id, label FROM defined WHERE label NOT IN (SELECT label FROM used)",
    "dangling_refs": f"WITH {_HREFS} SELECT label, count(*) AS n FROM used WHERE label NOT LIKE '^%' AND label NOT IN (SELECT label FROM defined) GROUP BY label",
    "type_runs": """
WITH li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS ord FROM lineitem),
f AS (SELECT *, CASE WHEN lag(l_returnflag) OVER w = l_returnflag THEN 0 ELSE 1 END AS new FROM li WINDOW w AS (PARTITION BY l_orderkey ORDER BY ord)),
g AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY ord) AS grp FROM f)
SELECT l_orderkey, l_returnflag, CAST(min(ord) AS BIGINT) AS start, count(*) AS length FROM g GROUP BY l_orderkey, l_returnflag, grp HAVING count(*) >= 2""",
    "adjacency_unjustified": """
WITH e AS (SELECT DISTINCT user_id AS path, event_id // 3 AS row, event_type FROM events), m AS (SELECT path, row FROM e WHERE event_type = 'error'), n AS (SELECT path, row FROM e WHERE event_type = 'view')
SELECT path, row FROM m WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.path = m.path AND n.row = m.row)
  AND NOT EXISTS (SELECT 1 FROM n WHERE n.path = m.path AND n.row = m.row - 1 AND NOT EXISTS (SELECT 1 FROM m x WHERE x.path = n.path AND x.row = n.row))""",
    "describe_truncated": f"WITH {_SUMMARY} SELECT doc_id, md5(CASE WHEN doc_id % 2 = 1 THEN t WHEN t = '' THEN 'see ' || source ELSE 'see ' || source || chr(10) || t END) AS told_md5 FROM s",
    "batch_report": "SELECT event_id, '[' || CASE WHEN event_type = 'error' THEN 'BLOCKING' ELSE 'advisory' END || '] ' || user_id || ' — ' || event_type || ': ' || CASE WHEN event_id % 2 = 0 THEN 'slow' || chr(10) ELSE '' END || trim(props) AS report FROM events WHERE NOT value < 20",
    "exit_code": "SELECT CAST(user_id AS VARCHAR) AS path, CAST(max(CASE WHEN event_type = 'error' AND NOT value < 20 THEN 1 ELSE 0 END) AS BIGINT) AS batch_code, CAST(max(CASE WHEN event_type = 'error' AND NOT value < 20 THEN 2 ELSE 0 END) AS BIGINT) AS hook_code FROM events GROUP BY user_id",
    "assessment_rollup": f"WITH RECURSIVE {_BLOCKS}, {_LONG} SELECT 'duplicate-code' AS check_name, count(*) AS findings, count(DISTINCT doc_id) AS files FROM r WHERE told UNION ALL SELECT 'long-line', count(*), count(DISTINCT doc_id) FROM long_lines",
}
