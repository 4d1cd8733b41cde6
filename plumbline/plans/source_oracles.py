"""DuckDB SQL for the queries in source_queries.py: what must be found follows from how the sources were written."""

from __future__ import annotations

from .oracles import _BLOCKS, _EDGES, _LINES, _REACH

_FACTS = """
p AS (SELECT p_partkey AS k, p_partkey % 53 + 1 AS n, CAST(p_size % 7 AS BIGINT) AS d, (p_partkey // 7) % 9 AS q, p_partkey % 7 AS l FROM part),
f AS (SELECT 'src/f' || k || '.' || ['go', 'ts', 'tsx', 'js', 'py', 'java', 'kt'][l + 1] AS path, CASE l WHEN 0 THEN 3 WHEN 5 THEN 2 ELSE 1 END AS line,
             CASE l WHEN 4 THEN n + d ELSE n + 2 * d + 2 END AS body_lines, 1 + d AS depth, q AS parameters,
             ['syntax-rules', 'syntax-rules-typescript', 'syntax-rules-tsx', 'syntax-rules-javascript', 'syntax-rules-python', 'syntax-rules-java', 'syntax-rules-kotlin'][l + 1] AS checker FROM p)
"""


def _go(key: str, of: str, number: str = "k") -> str:
    """(k, checker, line, message) of the Go files of a table's keys."""
    return f"""
SELECT {key} AS k, 'primitive-obsession' AS checker, 8 AS line, '2 parameters in a row of type string' AS message FROM {of} WHERE {key} % 2 = 0
UNION ALL SELECT {key}, 'go-ignored-error', 9, 'the last result, an error by convention, is ignored' FROM {of} WHERE {key} % 5 = 0
UNION ALL SELECT {key}, 'go-blank-imports', 5, 'blank import without a reason: side/' || {key} FROM {of} WHERE {key} % 3 <> 0
UNION ALL SELECT {key}, 'go-error-context', 10, 'the error is passed on without context' FROM {of} WHERE {key} % 4 = 0"""


_IMPORTS = f"""
{_EDGES},
i AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS rn FROM strong)
"""

#: What the architecture checkers find in the packages, as a table `found`.
_ARCHITECTURE = f"""
WITH RECURSIVE {_REACH}, i AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS rn FROM strong),
nodes AS (SELECT n_nationkey AS k, 'example.org/m/n' || n_nationkey AS name FROM nation),
pair AS (SELECT a.src AS x, a.dst AS y FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src),
comp AS (SELECT x AS k, min(p.name) AS component FROM pair JOIN nodes p ON p.k = pair.y GROUP BY x),
members AS (SELECT component, string_agg(name, ' -> ' ORDER BY name) || ' -> ' || component AS told FROM comp JOIN nodes USING (k) GROUP BY component),
first AS (SELECT c.component, min('n' || i.src || '/x.go') AS file, min(4 + i.rn) AS line FROM comp c JOIN nodes n ON n.name = c.component JOIN i ON i.src = n.k JOIN comp d ON d.k = i.dst AND d.component = c.component GROUP BY c.component),
rank AS (SELECT k, name, CASE k WHEN 1 THEN 0 WHEN 7 THEN 1 WHEN 3 THEN 2 END AS r FROM nodes),
fan AS (SELECT name, (SELECT count(*) FROM strong WHERE src = k) AS o, (SELECT count(*) FROM strong WHERE dst = k) AS i FROM nodes),
found AS (SELECT 'import-cycles' AS checker, file, CAST(line AS BIGINT) AS line, 'import cycle: ' || told AS message FROM members JOIN first USING (component)
UNION ALL SELECT 'layering', 'n' || i.src || '/x.go', 4 + rn, 'layering: ' || a.name || ' (n' || a.k || ') imports ' || b.name || ' (n' || b.k || '), a layer above its own' FROM i JOIN rank a ON a.k = i.src JOIN rank b ON b.k = i.dst WHERE b.r < a.r
UNION ALL SELECT 'coupling', '', 0, '[coupling] ' || name || ' imports ' || o || ' packages, limit 10' FROM fan WHERE o > 10
UNION ALL SELECT 'coupling', '', 0, '[coupling] ' || name || ' is imported ' || i || ' times, limit 10' FROM fan WHERE i > 10)
"""

ORACLES: dict[str, str] = {
    "syntax_facts": f"WITH {_FACTS} SELECT path, CAST(line AS BIGINT) AS line, CAST(body_lines AS BIGINT) AS body_lines, CAST(depth AS BIGINT) AS depth, CAST(parameters AS BIGINT) AS parameters FROM f",
    "syntax_rule_findings": f"""WITH {_FACTS}
SELECT checker, path, CAST(line AS BIGINT) AS line, '[long-function] body_lines ' || body_lines || ', limit 40' AS message FROM f WHERE body_lines > 40
UNION ALL SELECT checker, path, line, '[deep-nesting] depth ' || depth || ', limit 4' FROM f WHERE depth > 4
UNION ALL SELECT checker, path, line, '[long-parameter-list] parameters ' || parameters || ', limit 5' FROM f WHERE parameters > 5""",
    "go_rule_findings": f"SELECT checker, 'go/' || k || '.go' AS path, CAST(line AS BIGINT) AS line, message FROM ({_go('c_custkey', 'customer')})",
    "duplicate_code_findings": f"WITH RECURSIVE {_BLOCKS} SELECT doc_id || '.py' AS path, CAST(starts[len(starts)] + 1 AS BIGINT) AS line, 'block of lines repeated ' || len(starts) || ' times, at lines ' || array_to_string(list_transform(starts, lambda x: CAST(x + 1 AS VARCHAR)), ', ') AS message FROM r WHERE told",
    "markdown_link_findings": """
WITH c AS (SELECT c_custkey AS k, (SELECT max(c_custkey) FROM customer) AS top, 'docs/' || c_custkey || '.md' AS path FROM customer)
SELECT path, CAST(3 AS BIGINT) AS line, 'undefined reference: ref' || k % 3 AS message FROM c WHERE k % 3 <> 0
UNION ALL SELECT path, 5, 'unused definition: ref0' FROM c WHERE k % 3 <> 0
UNION ALL SELECT path, 3, 'no such heading: #part-' || (k + 1) || '--more' FROM c WHERE k % 2 = 1
UNION ALL SELECT path, 6, 'definition other: missing file: ' || (k + 1) || '.md#' || CASE WHEN k % 5 = 0 THEN 'nowhere' ELSE 'part-' || (k + 1) || '--more' END FROM c WHERE k = top
UNION ALL SELECT path, 6, 'definition other: dead anchor: ' || (k + 1) || '.md#nowhere' FROM c WHERE k % 5 = 0 AND k < top""",
    "go_import_edges": f"WITH {_IMPORTS} SELECT 'example.org/m/n' || src AS src, 'example.org/m/n' || dst AS dst, 'n' || src || '/x.go' AS file, CAST(4 + rn AS BIGINT) AS line FROM i",
    "script_import_edges": f"WITH {_IMPORTS} SELECT 'n' || src AS src, 'n' || dst AS dst, 'n' || src || '/index.ts' AS file, CAST(1 + rn AS BIGINT) AS line FROM i",
    "architecture_findings": _ARCHITECTURE + "SELECT checker, file, CAST(line AS BIGINT) AS line, message FROM found",
    "assessment_report": _ARCHITECTURE + """,
shown AS (SELECT checker, '[advisory] ' || CASE WHEN file = '' THEN '' ELSE file || ':' || line || ': ' END || message AS text FROM found),
ids AS (SELECT name, regexp_replace(name, '[^A-Za-z0-9]', '_', 'g') AS id FROM nodes),
cyclic AS (SELECT name FROM comp JOIN nodes USING (k)),
arrows AS (SELECT a.name AS src, b.name AS dst, row_number() OVER (ORDER BY a.name, b.name) - 1 AS ord FROM strong JOIN nodes a ON a.k = strong.src JOIN nodes b ON b.k = strong.dst),
told AS (
SELECT 0 AS part, 'architecture assessment: ' || (SELECT count(*) FROM found) || ' finding(s) across ' || ((SELECT count(*) FROM nodes) + 1) || ' file(s)' AS text
UNION ALL SELECT 1, text FROM shown
UNION ALL SELECT 2, '- import-cycles: move what both sides need into a package of its own, or let one side depend on an interface.' FROM found WHERE checker = 'import-cycles' HAVING count(*) > 0
UNION ALL SELECT 2, '- layering: put the import behind an interface that the upper layer owns, or move the code that needs it down.' FROM found WHERE checker = 'layering' HAVING count(*) > 0
UNION ALL SELECT 3, 'graph TD'
UNION ALL SELECT 4, '    ' || id || '["' || name || '"]' FROM ids
UNION ALL SELECT 5, '    ' || a.id || ' --> ' || b.id FROM arrows JOIN ids a ON a.name = src JOIN ids b ON b.name = dst
UNION ALL SELECT 6, '    classDef cycle fill:#fee2e2,stroke:#dc2626,stroke-width:2px;' FROM cyclic HAVING count(*) > 0
UNION ALL SELECT 7, '    class ' || string_agg(id, ',' ORDER BY name) || ' cycle;' FROM ids WHERE name IN (SELECT name FROM cyclic) HAVING count(*) > 0
UNION ALL SELECT 8, '    linkStyle ' || ord || ' stroke:#dc2626,stroke-width:2px;' FROM arrows WHERE src IN (SELECT name FROM cyclic) AND dst IN (SELECT name FROM cyclic))
SELECT CAST(part AS BIGINT) AS part, text, count(*) AS n FROM told GROUP BY ALL""",
    "repository_import_edges": f"""
WITH {_EDGES}, here AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS rn FROM strong)
SELECT 'r' || a.n_regionkey AS repo, 'example.org/m/n' || src AS src, 'example.org/m/n' || dst AS dst, 'n' || src || '/x.go' AS file, CAST(4 + rn AS BIGINT) AS line
FROM here JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst WHERE a.n_regionkey = b.n_regionkey""",
    "hook_results": f"""
WITH found AS ({_go('c_custkey', 'customer')}),
asked AS (SELECT c_custkey AS k, unnest([{{'name': 'errors', 'checker': 'go-ignored-error'}}, {{'name': 'context', 'checker': 'go-error-context'}}]) AS c FROM customer),
j AS (SELECT a.k, a.c, f.k IS NOT NULL AND (CASE WHEN a.k % 2 = 0 THEN f.line = 9 WHEN a.k % 3 = 0 THEN f.line = 8 ELSE true END) AS failed, 'go/' || a.k || '.go:' || f.line || ': ' || f.message AS output FROM asked a LEFT JOIN found f ON f.k = a.k AND f.checker = a.c.checker)
SELECT 't' || k AS tool_use_id, c.name AS check_name, 'blocking' AS severity, NOT failed AS passed, md5(CASE WHEN failed THEN output ELSE '' END) AS output_md5 FROM j""",
    "replay_snapshots": f"""
WITH RECURSIVE c AS (SELECT conv_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS k FROM conversations),
l AS (SELECT *, {_LINES} AS ls FROM c),
r AS (SELECT conv_id, k, CASE WHEN conv_id % 2 = 0 THEN array_to_string(ls, chr(10)) ELSE text END AS now, CAST(NULL AS VARCHAR) AS before, conv_id % 2 = 1 AS told, CAST(conv_id % 2 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS lost FROM l WHERE k = 0
      UNION ALL
      SELECT e.conv_id, e.k, CASE WHEN e.hit THEN substr(e.now, 1, strpos(e.now, e.old) - 1) || '<' || e.k || '>' || substr(e.now, strpos(e.now, e.old) + len(e.old)) ELSE e.now END,
             CASE WHEN e.hit THEN e.now END, e.hit, e.seq + CASE WHEN e.hit THEN 1 ELSE 0 END, e.lost + CASE WHEN e.hit THEN 0 ELSE 1 END
      FROM (SELECT l.conv_id, l.k, r.now, r.seq, r.lost, ['e', 'an', 't' || chr(10)][l.k % 3 + 1] AS old, strpos(r.now, ['e', 'an', 't' || chr(10)][l.k % 3 + 1]) > 0 AS hit FROM r JOIN l ON l.conv_id = r.conv_id AND l.k = r.k + 1) e)
SELECT CAST(conv_id AS VARCHAR) AS transcript, seq, 'f' || conv_id AS path, md5(before) AS before_md5, md5(now) AS after_md5, CAST(0 AS BIGINT) AS lost FROM r WHERE told
UNION ALL SELECT CAST(conv_id AS VARCHAR), -1, NULL, NULL, NULL, max(lost) FROM r GROUP BY conv_id""",
    "backtest_lines": f"""
WITH a AS ({_go('s_suppkey + 1', 'supplier').replace('s_suppkey + 1 %', '(s_suppkey + 1) %').replace("|| s_suppkey + 1 FROM", "|| (s_suppkey + 1) FROM")}), b AS ({_go('s_suppkey', 'supplier')})
SELECT CAST(a.k - 1 AS BIGINT) AS seq, 'log#' || (a.k - 1) || ' go/' || (a.k - 1) || '.go:' || a.line || ': [' || a.checker || ']' || CASE WHEN b.k IS NOT NULL THEN ' (pre-existing)' ELSE '' END || ' ' || a.message AS text
FROM a LEFT JOIN b ON b.k = a.k - 1 AND b.checker = a.checker AND b.message = a.message""",
    "hook_changed_lines": """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10))[3] AS third, string_split(text, ' ')[1] AS word FROM documents WHERE doc_id % 7 <> 0),
n AS (SELECT doc_id, text, third AS needle FROM d WHERE third <> '' UNION ALL SELECT doc_id, text, word FROM d WHERE word <> ''),
p AS (SELECT doc_id, needle, string_split(text, needle) AS parts FROM n),
x AS (SELECT doc_id, needle, parts, unnest(range(1, len(parts))) AS k FROM p),
s AS (SELECT doc_id, len(needle) - len(replace(needle, chr(10), '')) AS own, k, list_sum(list_transform(parts[1:k], lambda x: len(x) - len(replace(x, chr(10), '')))) AS breaks FROM x)
SELECT doc_id, count(*) AS n, CAST(sum(1 + breaks + (k - 1) * own) AS BIGINT) AS starts, CAST(sum(1 + breaks + k * own) AS BIGINT) AS ends FROM s GROUP BY doc_id""",
    "hook_answers": """
WITH f AS (SELECT CAST(user_id AS VARCHAR) AS path, event_type AS name, event_type = 'error' AS hard, CASE WHEN event_id % 2 = 0 THEN 'slow' || chr(10) ELSE '' END || 'at ' || event_id AS told FROM events WHERE NOT value < 20),
g AS (SELECT path, bool_or(hard) AS hard, string_agg(name || ' (blocking): ' || told, chr(10) ORDER BY name || ' (blocking): ' || told) FILTER (WHERE hard) AS stderr,
             string_agg(name || ': ' || told, chr(10) ORDER BY name || ': ' || told) || chr(10) || chr(10) || 'If one of these findings is wrong, say so where checks are configured.' AS context FROM f GROUP BY path)
SELECT u.path, CAST(CASE WHEN hard THEN 2 ELSE 0 END AS BIGINT) AS exit_code, md5(CASE WHEN hard THEN stderr END) AS stderr_md5,
       md5(CASE WHEN NOT hard THEN CAST(json_object('hookSpecificOutput', json_object('hookEventName', 'PostToolUse', 'additionalContext', context)) AS VARCHAR) END) AS stdout_md5
FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS path FROM events) u LEFT JOIN g USING (path)""",
    "diagnostic_rows": """
WITH f AS (SELECT event_id AS k, CAST(user_id AS VARCHAR) AS path, event_type AS source, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'WARNING' END AS severity FROM events WHERE NOT value < 20),
d AS (SELECT path, CAST(0 AS BIGINT) AS line, severity, source, CASE WHEN k % 2 = 0 THEN 'slow' || chr(10) ELSE '' END || 'no line told' AS message FROM f WHERE k % 3 = 0
      UNION ALL SELECT path, greatest(k % 50 - 1, 0), severity, source, 'first' FROM f WHERE k % 3 <> 0
      UNION ALL SELECT path, k % 7, severity, source, 'third : x' FROM f WHERE k % 3 <> 0)
SELECT path, line, severity, source, message, count(*) AS n FROM d GROUP BY ALL""",
    "scoped_results": f"""
WITH ex AS (SELECT doc_id, unnest({_LINES}) AS t, generate_subscripts({_LINES}, 1) AS line FROM documents),
l AS (SELECT doc_id, line, doc_id || ':' || line || ': long' AS told, doc_id % 4 = 0 OR line BETWEEN doc_id % 7 + 1 AND doc_id % 7 + 4 OR line = doc_id % 7 + 10 AS stays FROM ex WHERE strlen(t) >= 200)
SELECT doc_id, md5(coalesce(string_agg(told, chr(10) ORDER BY line) FILTER (WHERE stays), '')) AS kept_md5, NOT bool_or(stays) AS passed FROM l GROUP BY doc_id""",
    "batch_run": f"""
WITH found AS ({_go('c_custkey', 'customer')}), old AS ({_go('c_custkey - 1', '(SELECT * FROM customer WHERE (c_custkey - 1) % 10 <> 0)').replace('c_custkey - 1 %', '(c_custkey - 1) %').replace("|| c_custkey - 1 FROM", "|| (c_custkey - 1) FROM")}),
asked AS (SELECT c_custkey AS k, unnest([{{'name': 'errors', 'checker': 'go-ignored-error', 'severity': 'blocking', 'message': 'mind errors'}}, {{'name': 'context', 'checker': 'go-error-context', 'severity': 'blocking', 'message': NULL}}, {{'name': 'threes', 'checker': 'primitive-obsession', 'severity': 'advisory', 'message': NULL}}, {{'name': 'prose', 'checker': 'markdown', 'severity': 'advisory', 'message': NULL}}]) AS c FROM customer),
j AS (SELECT a.k, a.c, f.k IS NULL AS passed, coalesce('go/' || a.k || '.go:' || f.line || ': ' || f.message, '') AS output, o.k IS NOT NULL AS before FROM asked a LEFT JOIN found f ON f.k = a.k AND f.checker = a.c.checker LEFT JOIN old o ON o.k = a.k - 1 AND o.checker = a.c.checker WHERE a.c.name <> 'threes' OR a.k % 10 = 3)
SELECT 'go/' || k || '.go' AS path, c.name AS check_name, CASE WHEN NOT passed AND before AND c.severity = 'blocking' THEN 'advisory' ELSE c.severity END AS severity, passed, md5(output) AS output_md5,
       CASE WHEN NOT passed AND before AND c.severity = 'blocking' THEN CASE WHEN c.message IS NULL THEN '' ELSE c.message || ' ' END || '(advisory: the base revision fails in the same way)' ELSE c.message END AS message FROM j""",
    "text_keys": """
SELECT p_partkey, lower(p_name) || ' ' || lower(p_type) AS label,
       CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN contains(p_brand, '/') THEN regexp_replace(p_brand, '/[^/]*$', '') ELSE '.' END ELSE replace(p_brand, '\\', '/') || '/' || replace(p_type, '\\', '/') END AS folder,
       'lint ' || p_brand || ' --lines ' || CASE WHEN p_partkey % 2 = 0 THEN '1-' || p_size || ',70-71' ELSE '' END AS command FROM part""",
}
