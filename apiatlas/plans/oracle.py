"""Oracle SQL (DuckDB dialect) for the registered queries.

Written from the job definitions, not generated from the Spark plans: URL
parts are taken apart with DuckDB string functions, orders use window
functions / arg_min / arg_max, recursion uses WITH RECURSIVE.
"""

from __future__ import annotations

from apiatlas.plans import dims

# candidate rows from pages: same column meaning as apiatlas.plans.inputs.page_candidates
PAGE_CAND = r"""
cand AS (
  SELECT regexp_extract(url, '^[^:]+://[^/?#]*\.([^./?#:]+)', 1) AS project,
         'page/' || CAST(page_id AS VARCHAR) AS path,
         'lang:' || regexp_extract(url, '^[^:]+://[^/?#]+/([^/?#]*)', 1) AS library,
         url AS text, page_id AS ord, CAST(NULL AS VARCHAR) AS verb
  FROM pages)"""

# URL decomposition of `cand` -> dec(project, path, library, text, ord, verb, scheme, authority,
# base_url, endpoint, tail); qd(ord, key, value) with last-wins keys; fr(ord, fragments)
DECOMPOSE = r"""
s1 AS (
  SELECT *, CASE WHEN starts_with(text, 'https://') THEN 'https://'
                 WHEN starts_with(text, 'www.') OR starts_with(text, 'http://') THEN 'http://'
                 WHEN starts_with(text, 'ws://') THEN 'ws://'
                 WHEN starts_with(text, 'wss://') THEN 'wss://' END AS scheme
  FROM cand),
s2 AS (
  SELECT *, CASE WHEN starts_with(text, 'www.') THEN text ELSE substr(text, length(scheme) + 1) END AS rest
  FROM s1 WHERE scheme IS NOT NULL),
s3 AS (SELECT *, regexp_extract(rest, '^([^/?#]*)', 1) AS authority FROM s2),
s4 AS (
  SELECT *, CASE WHEN starts_with(substr(rest, length(authority) + 1), '/')
                 THEN substr(rest, length(authority) + 2)
                 ELSE substr(rest, length(authority) + 1) END AS rem
  FROM s3 WHERE length(authority) > 0),
s5 AS (SELECT *, regexp_extract(rem, '^([^?#]*)', 1) AS head, regexp_matches(rem, '[^?#]') AS has_ep FROM s4),
dec AS (
  SELECT project, path, library, text, ord, verb, scheme, authority, scheme || authority AS base_url,
         CASE WHEN has_ep THEN (CASE WHEN ends_with(head, '/') THEN substr(head, 1, length(head) - 1)
                                     ELSE head END) END AS endpoint,
         substr(rem, length(head) + 1) AS tail
  FROM s5),
q0 AS (
  SELECT ord, string_split(regexp_extract(substr(tail, 2), '^([^#]*)', 1), '&') AS prs
  FROM dec WHERE endpoint IS NOT NULL AND starts_with(tail, '?')),
q1 AS (SELECT ord, unnest(prs) AS pr, generate_subscripts(prs, 1) AS i FROM q0),
q2 AS (SELECT ord, i, string_split(regexp_replace(pr, '=+$', ''), '=') AS kv FROM q1),
q3 AS (SELECT ord, i, kv[1] AS key, kv[2] AS value FROM q2 WHERE len(kv) = 2),
qd AS (SELECT ord, key, arg_max(value, i) AS value FROM q3 GROUP BY ord, key),
f0 AS (
  SELECT ord, CASE WHEN starts_with(tail, '?') AND regexp_matches(substr(tail, 2), '^[^#]*#.*[^#]')
                   THEN regexp_extract(substr(tail, 2), '^[^#]*#(.*)$', 1)
                   WHEN starts_with(tail, '#') THEN substr(tail, 2) END AS fs
  FROM dec WHERE endpoint IS NOT NULL),
f1 AS (
  SELECT ord, CASE WHEN NOT contains(fs, '#') THEN [fs]
                   WHEN regexp_replace(fs, '#+$', '') = '' THEN []::VARCHAR[]
                   ELSE string_split(regexp_replace(fs, '#+$', ''), '#') END AS fl
  FROM f0 WHERE fs IS NOT NULL),
fr AS (
  SELECT ord, CASE WHEN len(list_distinct(fl)) > 0
                   THEN array_to_string(list_sort(list_distinct(fl)), ',') END AS fragments
  FROM f1)"""

CATALOG = r"""
b0 AS (
  SELECT project, base_url, arg_min(path, ord) AS first_path,
         coalesce(arg_max(library, ord) FILTER (WHERE endpoint IS NOT NULL), arg_min(library, ord)) AS library,
         bool_or(endpoint IS NOT NULL) AS has_ep
  FROM dec GROUP BY project, base_url),
e0 AS (
  SELECT project, base_url, endpoint, min(ord) AS first_ord,
         string_agg(DISTINCT verb, ',' ORDER BY verb) AS http_methods
  FROM dec WHERE endpoint IS NOT NULL GROUP BY project, base_url, endpoint),
qv AS (
  SELECT d.project, d.base_url, d.endpoint, q.key, arg_min(q.value, d.ord) AS value
  FROM dec d JOIN qd q ON q.ord = d.ord GROUP BY d.project, d.base_url, d.endpoint, q.key),
qs AS (
  SELECT project, base_url, endpoint, string_agg(key || '=' || value, '&' ORDER BY key) AS query_string
  FROM qv GROUP BY project, base_url, endpoint),
cat AS (
  SELECT b.project, b.base_url, b.library, b.first_path, e.endpoint, qs.query_string, fr.fragments,
         e.http_methods
  FROM b0 b
  LEFT JOIN e0 e ON e.project = b.project AND e.base_url = b.base_url
  LEFT JOIN qs ON qs.project = e.project AND qs.base_url = e.base_url AND qs.endpoint = e.endpoint
  LEFT JOIN fr ON fr.ord = e.first_ord
  WHERE e.endpoint IS NOT NULL OR NOT b.has_ep)"""

FILL = ("replace(replace(replace(replace(replace(replace(replace(replace(replace(replace({x}, "
        "'<String>', 'A'), '<Double>', '0.0'), '<Float>', '0.0'), '<Integer>', '0'), '<Boolean>', 'true'), "
        "'<STRING>', 'A'), '<DOUBLE>', '0.0'), '<FLOAT>', '0.0'), '<INTEGER>', '0'), '<BOOLEAN>', 'true')")

REBUILD = r"""
rb AS (
  SELECT project, base_url, endpoint,
         base_url || '/' || endpoint || coalesce('?' || query_string, '') ||
           coalesce('#' || list_max(string_split(fragments, ',')), '') AS raw_url,
         base_url || '/' || """ + FILL.format(x="endpoint") + r""" || coalesce('?' || """ + FILL.format(x="query_string") + r""", '') ||
           coalesce('#' || """ + FILL.format(x="list_max(string_split(fragments, ','))") + r""", '') AS populated_url
  FROM cat WHERE endpoint IS NOT NULL)"""

STRING_LITERAL = r'"((?:[^"\\]|\\.)*)"'
STRING_ASSIGNMENT = r'(?:String\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*"((?:[^"\\]|\\.)*)"'


def _keywords_values(table) -> str:
    rows = []
    for i, (lib, kws) in enumerate(table):
        for kw in kws:
            rows.append(f"('{lib}', '{kw}', {i})")
    return "kw(library, keyword, lib_order) AS (VALUES " + ", ".join(rows) + ")"


def _libraries_values(table=None) -> str:
    return "libdim(library) AS (VALUES " + ", ".join(f"('{lib}')" for lib, _ in table or dims.LIBRARY_KEYWORDS) + ")"


EVENT_MODELS = r"""
ec AS (
  SELECT event_type AS project, 'event/' || CAST(event_id AS VARCHAR) AS path,
         'noLib.StringLiteralExpr' AS library,
         replace(replace(replace(props, '\"', '"'), '\''', ''''), '\\', '\') AS t, event_id AS ord
  FROM events),
ev_ok AS (
  SELECT project, path, library, ord, json(t)::VARCHAR AS canonical FROM ec
  WHERE starts_with(t, '{') AND ends_with(t, '}') AND length(t) >= 4 AND json_valid(t)),
models AS (
  SELECT project, canonical, min(ord) AS first_ord, arg_min(path, ord) AS path,
         arg_min(library, ord) AS library, count(*) AS n_occurrences,
         substr(sha256(project || chr(1) || canonical), 1, 16) AS model_id
  FROM ev_ok GROUP BY project, canonical)"""

REGION_MODELS = r"""
rdocs AS (
  SELECT 'regions' AS project, r.r_regionkey AS ord,
         json_object('id', r.r_regionkey,
                     'nations', coalesce((SELECT to_json(list(json_object('key', n.n_nationkey, 'name', n.n_name)
                                                             ORDER BY n.n_nationkey))
                                          FROM nation n WHERE n.n_regionkey = r.r_regionkey), '[]'::JSON),
                     'region', r.r_name)::VARCHAR AS canonical
  FROM region r),
rmodels AS (
  SELECT project, canonical, substr(sha256(project || chr(1) || canonical), 1, 16) AS model_id
  FROM rdocs),
allm AS (SELECT project, canonical, model_id FROM models UNION ALL SELECT project, canonical, model_id FROM rmodels),
tree AS (
  SELECT m.project, m.model_id, t.fullkey AS path, t.path AS parent_path, t.key AS k, t.type AS ty,
         t.atom AS atom, t.value AS tv
  FROM allm m, json_tree(m.canonical) t),
fields AS (
  SELECT project, model_id, path,
         CASE WHEN path = '$' THEN NULL ELSE parent_path END AS parent_path,
         CASE WHEN ends_with(path, ']') THEN NULL ELSE k END AS key,
         CASE WHEN ends_with(path, ']') THEN CAST(regexp_extract(path, '\[([0-9]+)\]$', 1) AS INTEGER) END AS idx,
         length(path) - length(replace(replace(path, '.', ''), '[', '')) AS depth,
         CASE WHEN ty = 'OBJECT' THEN 'OBJECT' WHEN ty = 'ARRAY' THEN 'ARRAY' WHEN ty = 'NULL' THEN 'NULL'
              WHEN ty = 'BOOLEAN' THEN 'BOOLEAN'
              WHEN ty IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN
                CASE WHEN CAST(atom AS DOUBLE) = floor(CAST(atom AS DOUBLE))
                          AND CAST(atom AS DOUBLE) BETWEEN -2147483648 AND 2147483647
                     THEN 'NUMBER_INT' ELSE 'NUMBER_DOUBLE' END
              WHEN ty = 'VARCHAR' THEN
                CASE tv ->> '$' WHEN '<STRING>' THEN 'STRING' WHEN '<DOUBLE>' THEN 'NUMBER_DOUBLE'
                     WHEN '<FLOAT>' THEN 'NUMBER_DOUBLE' WHEN '<INTEGER>' THEN 'NUMBER_INT'
                     WHEN '<BOOLEAN>' THEN 'BOOLEAN' WHEN '<NULL>' THEN 'NULL' ELSE 'STRING' END
              ELSE 'STRING' END AS jtype,
         CASE WHEN ty IN ('OBJECT', 'ARRAY', 'NULL') THEN NULL
              WHEN ty = 'VARCHAR' THEN (CASE WHEN (tv ->> '$') IN ('<STRING>', '<DOUBLE>', '<FLOAT>', '<INTEGER>',
                                                              '<BOOLEAN>', '<NULL>') THEN NULL ELSE tv ->> '$' END)
              ELSE CAST(atom AS VARCHAR) END AS value
  FROM tree)"""


ORACLE: dict[str, str] = {}

ORACLE["decompose_urls"] = "WITH " + PAGE_CAND + "," + DECOMPOSE + r"""
SELECT d.ord, d.project, d.base_url, d.scheme, d.authority, d.endpoint,
       (SELECT string_agg(q.key || '=' || q.value, '&' ORDER BY q.key) FROM qd q WHERE q.ord = d.ord) AS query_string,
       fr.fragments
FROM dec d LEFT JOIN fr ON fr.ord = d.ord"""

ORACLE["url_query_pairs"] = "WITH " + PAGE_CAND + "," + DECOMPOSE + r"""
SELECT d.project, d.base_url, d.endpoint, q.key, arg_min(q.value, d.ord) AS value
FROM dec d JOIN qd q ON q.ord = d.ord
GROUP BY d.project, d.base_url, d.endpoint, q.key"""

ORACLE["build_url_catalog"] = "WITH " + PAGE_CAND + "," + DECOMPOSE + "," + CATALOG + r"""
SELECT project, base_url, library, first_path, endpoint, query_string, fragments, http_methods FROM cat"""

ORACLE["rebuild_urls"] = "WITH " + PAGE_CAND + "," + DECOMPOSE + "," + CATALOG + "," + REBUILD + r"""
SELECT project, base_url, endpoint, raw_url, populated_url FROM rb"""

ROUTES = r"""
pr AS (
  SELECT page_id, regexp_extract(url, '^[^:]+://[^/?#]*\.([^./?#:]+)', 1) AS project,
         regexp_replace(regexp_extract(url, '^[^:]+://[^/?#]+(/[^?#]*)?', 1), '[0-9]+', '{id}', 'g') AS template,
         regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS qs
  FROM pages),
pk AS (
  SELECT project, template,
         CASE WHEN qs = '' THEN []::VARCHAR[]
              ELSE list_transform(string_split(qs, '&'), lambda x: split_part(x, '=', 1)) END AS qk
  FROM pr),
routes AS (SELECT DISTINCT project, template, qk FROM pk),
ru AS (
  SELECT project, template, array_to_string(qk, ',') AS qkeys,
         replace(template, '{id}', '<Integer>') ||
           array_to_string(list_transform(qk, lambda k: '&' || k || '=<String>'), '') AS u
  FROM routes),
rx AS (
  SELECT project, template, qkeys, 'GET' AS verb,
         CASE WHEN strpos(u, '&') > 0 AND (strpos(u, '?') = 0 OR strpos(u, '&') < strpos(u, '?'))
              THEN substr(u, 1, strpos(u, '&') - 1) || '?' || substr(u, strpos(u, '&') + 1)
              ELSE u END AS route_url
  FROM ru)"""

ORACLE["expand_routes"] = "WITH " + ROUTES + r"""
SELECT project, template, qkeys, verb, route_url FROM rx"""

ORACLE["join_base_urls"] = "WITH " + ROUTES + r""",
bases AS (
  SELECT DISTINCT regexp_extract(url, '^[^:]+://[^/?#]*\.([^./?#:]+)', 1) AS project,
                  regexp_extract(url, '^([^:]+://[^/?#]+)', 1) AS base
  FROM pages)
SELECT r.project, b.base, r.verb,
       CASE WHEN b.base IS NULL OR regexp_matches(r.route_url, '(?i)^https?://[^/?#:]+') THEN r.route_url
            ELSE b.base || r.route_url END AS url
FROM rx r LEFT JOIN bases b ON b.project = r.project"""

ORACLE["extract_literals"] = r"""
WITH l0 AS (SELECT page_id, string_split(html, chr(10)) AS ls FROM pages),
l1 AS (SELECT page_id, unnest(ls) AS lt, generate_subscripts(ls, 1) - 1 AS line FROM l0),
m0 AS (SELECT page_id, line, regexp_extract_all(lt, '""" + STRING_LITERAL + r"""', 1) AS lits FROM l1),
m1 AS (SELECT page_id, line, unnest(lits) AS literal, generate_subscripts(lits, 1) - 1 AS pos FROM m0),
m2 AS (SELECT *, replace(replace(replace(literal, '\"', '"'), '\''', ''''), '\\', '\') AS un FROM m1)
SELECT page_id, line, pos, literal,
       CASE WHEN starts_with(un, 'https://') OR starts_with(un, 'http://') OR starts_with(un, 'www.')
                 OR starts_with(un, 'ws://') OR starts_with(un, 'wss://') THEN 'url' ELSE 'text' END AS kind
FROM m2"""

ORACLE["collect_string_vars"] = r"""
WITH m0 AS (SELECT source AS project, unnest(regexp_extract_all(text, '""" + STRING_ASSIGNMENT + r"""')) AS m
            FROM documents),
m1 AS (SELECT project, regexp_extract(m, '""" + STRING_ASSIGNMENT + r"""', 1) AS name,
              regexp_extract(m, '""" + STRING_ASSIGNMENT + r"""', 2) AS value FROM m0)
SELECT project, name, count(DISTINCT value) AS n_values, string_agg(DISTINCT value, '|' ORDER BY value) AS vals
FROM m1 GROUP BY project, name"""

ORACLE["match_keywords"] = "WITH " + _keywords_values(dims.PROSE_KEYWORDS) + r"""
SELECT d.source AS project, CAST(d.doc_id AS VARCHAR) AS path, kw.library, count(*) AS n_keywords
FROM documents d JOIN kw ON contains(lower(d.text), lower(kw.keyword))
GROUP BY d.source, d.doc_id, kw.library"""

ORACLE["files_without_snippets"] = r"""
SELECT source AS project, CAST(doc_id AS VARCHAR) AS path, lang AS library
FROM documents WHERE NOT regexp_matches(text, '""" + STRING_ASSIGNMENT + r"""')"""

ORACLE["keep_maximal_spans"] = r"""
WITH s AS (SELECT l_orderkey AS path, l_partkey AS span_start,
                  l_partkey + CAST(l_quantity AS BIGINT) AS span_end FROM lineitem),
w AS (SELECT *, max(span_end) OVER (PARTITION BY path ORDER BY span_start, span_end DESC
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM s)
SELECT path, span_start, span_end FROM w WHERE prev IS NULL OR span_end > prev"""

ORACLE["enclosing_block"] = r"""
WITH ev AS (SELECT event_id AS id, 'user/' || CAST(user_id AS VARCHAR) AS path,
                   CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS pos, event_type FROM events),
blk AS (SELECT path, 'method' AS kind, event_type AS name, min(pos) AS s, max(pos) AS e FROM ev GROUP BY path, event_type
        UNION ALL
        SELECT path, 'class', 'user', min(pos), max(pos) FROM ev GROUP BY path),
j AS (SELECT ev.id, ev.path, ev.pos, blk.kind, blk.name, blk.s, blk.e,
             row_number() OVER (PARTITION BY ev.id ORDER BY blk.e - blk.s, blk.name, blk.kind) AS rn
      FROM ev JOIN blk ON blk.path = ev.path AND blk.s <= ev.pos AND ev.pos <= blk.e)
SELECT path, id, pos, kind AS block_kind, name AS block_name, s AS block_start, e AS block_end FROM j WHERE rn = 1"""

ORACLE["fold_appends"] = r"""
SELECT 'tpch' AS project, l_orderkey AS builder, string_agg(l_returnflag, '' ORDER BY l_linenumber, l_returnflag) AS value
FROM lineitem GROUP BY l_orderkey"""

ORACLE["expand_concat"] = r"""
SELECT 'tpch' AS project, 'n' || CAST(n.n_nationkey AS VARCHAR) AS expr_id, f.f || '-' || s.s || '@' || n.n_name AS value
FROM nation n, (SELECT DISTINCT l_returnflag AS f FROM lineitem) f, (SELECT DISTINCT l_linestatus AS s FROM lineitem) s"""

ORACLE["resolve_local"] = r"""
SELECT 'tpch' AS project, 'c' || CAST(c.c_custkey AS VARCHAR) AS use_id, 'o' || CAST(o.o_orderkey AS VARCHAR) AS def_id
FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey
WHERE NOT (o.o_orderstatus = 'F' AND starts_with(o.o_orderpriority, '5'))"""

ORACLE["resolve_field"] = r"""
WITH d AS (
  SELECT CASE WHEN p_type = 'PROMO' THEN NULL ELSE 'pkg' || CAST(p_size // 10 AS VARCHAR) END AS package,
         'file' || CAST(p_size AS VARCHAR) AS path, 'f' || CAST(p_partkey AS VARCHAR) AS name,
         CASE WHEN p_size <= 12 THEN 'public' WHEN p_size <= 25 THEN 'protected'
              WHEN p_size <= 37 THEN 'default' ELSE 'private' END AS vis,
         'p' || CAST(p_partkey AS VARCHAR) AS def_id
  FROM part),
u AS (
  SELECT 'pkg' || CAST(l_linenumber - 1 AS VARCHAR) AS package, 'file' || CAST(l_suppkey AS VARCHAR) AS path,
         'f' || CAST(l_partkey AS VARCHAR) AS name,
         'l' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) AS use_id
  FROM lineitem)
SELECT 'tpch' AS project, u.use_id, d.def_id,
       CASE WHEN d.vis = 'public' THEN 'project'
            WHEN d.vis IN ('protected', 'default') AND d.package IS NOT NULL THEN 'package' ELSE 'file' END AS scope
FROM u JOIN d ON d.name = u.name
WHERE d.vis = 'public'
   OR (d.vis IN ('protected', 'default') AND d.package IS NOT NULL AND d.package = u.package)
   OR ((d.vis = 'private' OR (d.vis IN ('protected', 'default') AND d.package IS NULL)) AND d.path = u.path)"""

ORACLE["resolve_param"] = r"""
WITH pa AS (
  SELECT 'file' || CAST(p_size AS VARCHAR) AS ppath, 'm' || CAST(p_partkey AS VARCHAR) AS callee,
         CASE WHEN p_size <= 25 THEN 'public' ELSE 'private' END AS vis, a.arg_pos, a.name
  FROM part, (VALUES (0, 'qty'), (1, 'disc')) a(arg_pos, name)),
ca AS (
  SELECT 'file' || CAST(l_suppkey AS VARCHAR) AS path, 'm' || CAST(l_partkey AS VARCHAR) AS callee, 0 AS arg_pos,
         'q' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) AS expr_id, 'literal' AS kind
  FROM lineitem
  UNION ALL
  SELECT 'file' || CAST(l_suppkey AS VARCHAR), 'm' || CAST(l_partkey AS VARCHAR), 1,
         'd' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR),
         CASE WHEN l_discount = 0 THEN 'other' ELSE 'literal' END
  FROM lineitem)
SELECT 'tpch' AS project, pa.callee, pa.arg_pos, pa.name, ca.path AS call_path, ca.expr_id
FROM pa JOIN ca ON ca.callee = pa.callee AND ca.arg_pos = pa.arg_pos
WHERE ca.kind IN ('literal', 'name') AND (pa.vis = 'public' OR pa.ppath = ca.path)"""

ORACLE["resolve_iterative"] = r"""
WITH RECURSIVE defs AS (
  SELECT 'v' || CAST(p_partkey AS VARCHAR) AS name, 'name' AS vk, NULL AS value,
         'v' || CAST(p_partkey // 2 AS VARCHAR) AS ref FROM part WHERE p_partkey >= 2
  UNION ALL SELECT 'v' || CAST(p_partkey AS VARCHAR), 'literal', 'root', NULL FROM part WHERE p_partkey = 1
  UNION ALL SELECT 'v' || CAST(p_partkey AS VARCHAR), 'literal', 'L' || CAST(p_partkey AS VARCHAR), NULL
            FROM part WHERE p_size <= 5),
walk(start, cur, depth) AS (
  SELECT 'v' || CAST(p_partkey AS VARCHAR), 'v' || CAST(p_partkey AS VARCHAR), 0 FROM part
  UNION ALL
  SELECT w.start, d.ref, w.depth + 1 FROM walk w JOIN defs d ON d.name = w.cur
  WHERE d.vk = 'name')
SELECT 'tpch' AS project, w.start, d.value, min(w.depth) AS depth
FROM walk w JOIN defs d ON d.name = w.cur AND d.vk = 'literal'
GROUP BY w.start, d.value"""

ORACLE["build_json_models"] = "WITH " + EVENT_MODELS + r"""
SELECT project, model_id, canonical, first_ord, path, library, n_occurrences FROM models"""

ORACLE["explode_json_fields"] = "WITH " + EVENT_MODELS + "," + REGION_MODELS + r"""
SELECT project, model_id, path, parent_path, key, idx, depth, jtype, value FROM fields"""

ORACLE["field_usage"] = "WITH " + EVENT_MODELS + "," + REGION_MODELS + r"""
SELECT key, count(*) AS n FROM fields WHERE key IS NOT NULL GROUP BY key"""

ORACLE["fold_json_puts"] = r"""
WITH r AS (
  SELECT user_id, event_type, value,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn
  FROM events)
SELECT 'events' AS project, user_id AS object, count(*) AS n_keys,
       '{' || string_agg('"' || event_type || '":' || CAST(value AS VARCHAR), ',' ORDER BY event_type) || '}' AS doc
FROM r WHERE rn = 1 GROUP BY user_id"""

ORACLE["fill_placeholders"] = r"""
WITH t AS (
  SELECT p_partkey, '/api/' || lower(p_type) || '/<Integer>?name=<String>&size=' ||
         CASE WHEN p_size > 25 THEN '<Double>' ELSE '<BOOLEAN>' END || '#<Float>' AS text
  FROM part)
SELECT p_partkey, text, """ + FILL.format(x="text") + r""" AS filled FROM t"""

ORACLE["fuzzy_fill_queries"] = r"""
WITH q AS (SELECT DISTINCT p_brand AS project, p_name AS key,
                  CASE WHEN p_size % 3 = 0 THEN '<STRING>' WHEN p_size % 3 = 1 THEN '<INTEGER>' ELSE 'fixed' END AS value FROM part),
v AS (SELECT p_brand AS project, p_type AS var_name, min(p_name) AS var_value FROM part GROUP BY p_brand, p_type),
s AS (SELECT q.project, q.key, v.var_value,
             row_number() OVER (PARTITION BY q.project, q.key
                                ORDER BY jaro_winkler_similarity(q.key, v.var_name) DESC, v.var_name) AS rn
      FROM (SELECT DISTINCT project, key FROM q) q JOIN v USING (project))
SELECT q.project, q.key, CASE value WHEN '<STRING>' THEN s.var_value WHEN '<INTEGER>' THEN '0' ELSE value END AS value
FROM q LEFT JOIN s ON s.project = q.project AND s.key = q.key AND s.rn = 1"""

ORACLE["request_plan"] = "WITH " + PAGE_CAND + "," + DECOMPOSE + "," + CATALOG + "," + REBUILD + r""",
bodies AS (SELECT DISTINCT project, '{"lang":"' || regexp_replace(library, '^lang:', '') || '"}' AS body FROM cand),
m(method) AS (VALUES ('GET'), ('POST'), ('PUT'), ('PATCH'), ('DELETE'))
SELECT rb.project, rb.populated_url AS url, m.method, CAST(NULL AS VARCHAR) AS body FROM rb, m
UNION ALL
SELECT rb.project, rb.populated_url, m.method, b.body
FROM rb JOIN bodies b ON b.project = rb.project, m WHERE m.method <> 'GET'"""

ORACLE["library_usage"] = "WITH " + _keywords_values(dims.PROSE_KEYWORDS) + "," + _libraries_values(dims.PROSE_KEYWORDS) + r""",
hits AS (SELECT DISTINCT d.source AS project, kw.library FROM documents d
         JOIN kw ON contains(lower(d.text), lower(kw.keyword)))
SELECT l.library, count(DISTINCT h.project) AS n_projects
FROM libdim l LEFT JOIN hits h ON h.library = l.library GROUP BY l.library"""

ORACLE["models_per_library"] = "WITH " + EVENT_MODELS + r""",
fixed(library) AS (VALUES ('com.google.code.gson'), ('com.squareup.moshi'), ('org.json'),
                          ('noLib.StringLiteralExpr'), ('noLib.BinaryExpr')),
n AS (SELECT library, count(*) AS c FROM models GROUP BY library)
SELECT coalesce(f.library, n.library) AS library, coalesce(n.c, 0) AS n_models
FROM fixed f FULL OUTER JOIN n ON n.library = f.library"""

ORACLE["project_counters"] = "WITH " + EVENT_MODELS + "," + _keywords_values(dims.EVENT_KEYWORDS) + r""",
p AS (SELECT DISTINCT event_type AS project FROM events),
libs AS (SELECT e.event_type AS project, count(DISTINCT kw.library) AS n_libs
         FROM events e JOIN kw ON contains(lower(e.props), lower(kw.keyword)) GROUP BY e.event_type),
mods AS (SELECT project, count(*) AS n_models FROM models GROUP BY project)
SELECT count(*) AS n_projects, count(*) FILTER (WHERE libs.n_libs >= 1) AS n_with_library,
       count(*) FILTER (WHERE libs.n_libs = 1) AS n_with_one_library,
       count(*) FILTER (WHERE mods.n_models >= 1) AS n_with_models
FROM p LEFT JOIN libs ON libs.project = p.project LEFT JOIN mods ON mods.project = p.project"""

ORACLE["project_summary"] = "WITH " + PAGE_CAND + "," + DECOMPOSE + "," + CATALOG + "," + EVENT_MODELS + r""",
m AS (SELECT project, count(*) AS n_models FROM models GROUP BY project),
b AS (SELECT project, count(DISTINCT base_url) AS n_base_urls FROM cat GROUP BY project)
SELECT coalesce(m.project, b.project) AS project, coalesce(m.n_models, 0) AS n_models,
       coalesce(b.n_base_urls, 0) AS n_base_urls
FROM m FULL OUTER JOIN b ON b.project = m.project"""


# ------------------------------------------------------------------ code facts
from apiatlas.functions import encoding as _enc  # noqa: E402
from apiatlas.operators import facts as _facts  # noqa: E402

_CALL_KEYWORDS = "('if', 'for', 'while', 'switch', 'catch', 'return', 'new', 'synchronized')"


def _n_args(x: str) -> str:
    return f"CASE WHEN trim({x}) = '' THEN 0 ELSE len(string_split({x}, ',')) END"


# The pages hold no comments and no calls inside arguments: plain patterns say the same there.
_CREATION = r"\bnew\s+([A-Za-z_][\w.]*)\s*(?:<[^<>()]*>)?\s*\(([^()]*)\)?"
_CALL = r"(?:\b([A-Za-z_][\w]*(?:\(\))?)\s*\.\s*)?\b([a-z_][\w]*)\s*\(([^()]*)\)?"

CALLS = r"""
l0 AS (SELECT page_id, string_split(html, chr(10)) AS ls FROM pages),
l1 AS (SELECT page_id, unnest(ls) AS lt, generate_subscripts(ls, 1) - 1 AS line FROM l0),
c0 AS (SELECT page_id, line, regexp_extract_all(lt, '""" + _CREATION + r"""') AS cm,
              regexp_extract_all(lt, '""" + _CALL + r"""') AS km,
              regexp_extract_all(lt, '""" + _facts.CAST + r"""') AS sm FROM l1),
cr AS (SELECT page_id, line, unnest(cm) AS m, generate_subscripts(cm, 1) - 1 AS pos FROM c0),
ca AS (SELECT page_id, line, unnest(km) AS m, generate_subscripts(km, 1) - 1 AS pos FROM c0),
cs AS (SELECT page_id, line, unnest(sm) AS m, generate_subscripts(sm, 1) - 1 AS pos FROM c0),
calls AS (
  SELECT page_id, line, pos, 'creation' AS kind,
         string_split(regexp_extract(m, '""" + _CREATION + r"""', 1), '.')[-1] AS name,
         CAST(NULL AS VARCHAR) AS scope, """ + _n_args("regexp_extract(m, '" + _CREATION + "', 2)") + r""" AS n_args
  FROM cr
  UNION ALL
  SELECT page_id, line, pos, 'call', regexp_extract(m, '""" + _CALL + r"""', 2),
         nullif(regexp_extract(m, '""" + _CALL + r"""', 1), ''),
         """ + _n_args("regexp_extract(m, '" + _CALL + "', 3)") + r"""
  FROM ca WHERE regexp_extract(m, '""" + _CALL + r"""', 2) NOT IN """ + _CALL_KEYWORDS + r"""
  UNION ALL
  SELECT page_id, line, pos, 'cast', string_split(regexp_extract(m, '""" + _facts.CAST + r"""', 1), '.')[-1],
         nullif(regexp_extract(m, '""" + _facts.CAST + r"""', 2), ''), 0
  FROM cs)"""

ORACLE["extract_calls"] = "WITH " + CALLS + "\nSELECT page_id, line, pos, kind, name, scope, n_args FROM calls"


def _rules_values() -> str:
    def q(v):
        return "NULL" if v is None else (str(v) if isinstance(v, int) else f"'{v}'")
    rows = ", ".join("(" + ", ".join(q(x) for x in r) + ")" for r in dims.CALL_RULES + dims.PAGE_RULES)
    return f"rules(kind, name, match, type, min_args, library) AS (VALUES {rows})"


ORACLE["match_call_rules"] = "WITH " + CALLS + ", " + _rules_values() + r"""
SELECT DISTINCT c.page_id, c.line, c.pos, c.kind, c.name, coalesce(r.library, r.type) AS library
FROM calls c JOIN rules r ON r.kind = c.kind AND r.name = c.name
WHERE r.match IS NULL AND (r.min_args IS NULL OR c.n_args >= r.min_args)"""


def _library_list() -> str:
    return "[" + ", ".join(f"'{lib}'" for lib, _ in dims.LIBRARY_KEYWORDS) + "]"


PART_DEPS = r"""
pg AS (
  SELECT p_type AS project, p_partkey AS ord, p_size,
         coalesce(""" + _library_list() + r"""[CAST(regexp_extract(p_brand, '#(\d+)', 1) AS INTEGER)],
                  'com.brand' || regexp_extract(p_brand, '#(\d+)', 1)) AS grp
  FROM part),
occ AS (
  SELECT project, grp AS library, CAST(p_size AS VARCHAR) AS version, ord, 0 AS pos FROM pg
  WHERE list_contains(""" + _library_list() + r""", grp)
  UNION ALL
  SELECT project, 'android.core', CAST(p_size AS VARCHAR), ord, 1048576 FROM pg),
deps AS (
  SELECT project, library, version FROM (
    SELECT *, row_number() OVER (PARTITION BY project, library ORDER BY ord DESC, pos DESC) AS rn FROM occ)
  WHERE rn = 1)"""

ORACLE["extract_dependencies"] = "WITH " + PART_DEPS + "\nSELECT project, library, version FROM deps"

ORACLE["match_available_version"] = "WITH " + PART_DEPS + ", " + _libraries_values() + r""",
folders AS (SELECT DISTINCT pg.grp || '-' || CAST(pg.p_size AS VARCHAR)
                    || CASE WHEN pg.ord % 2 = 1 THEN '-beta' ELSE '' END AS folder FROM pg),
fb AS (SELECT l.library, max(f.folder) AS fallback FROM folders f JOIN libdim l ON contains(f.folder, l.library)
       GROUP BY l.library)
SELECT d.project, d.library, d.version, coalesce(f.folder, fb.fallback) AS folder, f.folder IS NOT NULL AS exact
FROM deps d LEFT JOIN folders f ON f.folder = d.library || '-' || d.version
LEFT JOIN fb ON fb.library = d.library"""


def _is_url(x: str) -> str:
    return (f"((starts_with({x}, 'https://') AND length(regexp_extract(substr({x}, 9), '^([^/?#]*)', 1)) > 0) OR "
            f"(starts_with({x}, 'www.') AND length(regexp_extract({x}, '^([^/?#]*)', 1)) > 0) OR "
            f"(starts_with({x}, 'http://') AND length(regexp_extract(substr({x}, 8), '^([^/?#]*)', 1)) > 0) OR "
            f"(starts_with({x}, 'ws://') AND length(regexp_extract(substr({x}, 6), '^([^/?#]*)', 1)) > 0) OR "
            f"(starts_with({x}, 'wss://') AND length(regexp_extract(substr({x}, 7), '^([^/?#]*)', 1)) > 0))")


ORACLE["urls_from_candidates"] = r"""
WITH a AS (SELECT CAST(page_id AS VARCHAR) AS expr_id,
                  unnest([url, regexp_extract(url, '^[^:]+://[^/?#]+(/[^?#]*)?', 1)]) AS t FROM pages)
SELECT 'pages' AS project, expr_id, bool_or(""" + _is_url("t") + r""") AS any_url,
       count(*) FILTER (WHERE """ + _is_url("t") + r""") AS n_urls
FROM a GROUP BY expr_id"""

ORACLE["assemble_urls"] = r"""
WITH u AS (SELECT page_id, regexp_extract(url, '^([^:]+)://', 1) AS proto,
                  regexp_extract(url, '^[^:]+://([^/?#]+)', 1) AS host,
                  regexp_extract(url, '^([^:]+://[^/?#]+)', 1) AS base,
                  regexp_extract(url, '^[^:]+://[^/?#]+(.*)$', 1) AS file FROM pages)
SELECT 'pages' AS project, 'a' || CAST(page_id AS VARCHAR) AS expr_id, proto || '://' || host || file AS text FROM u
UNION ALL SELECT 'pages', 'b' || CAST(page_id AS VARCHAR), base || file FROM u
UNION ALL SELECT 'pages', 'b' || CAST(page_id AS VARCHAR), base || '/' FROM u"""


def _encode_sql(x: str, escapes: str) -> str:
    out = f"replace({x}, '%', '%25')"
    for ch in escapes:
        lit = ch.replace("'", "''")
        out = f"replace({out}, '{lit}', '%{ord(ch):02X}')"
    return out


_QK = _encode_sql("split_part(kv, '=', 1)", _enc.QUERY_COMPONENT_ESCAPES)
_QV = _encode_sql("CASE WHEN contains(kv, '=') THEN substr(kv, strpos(kv, '=') + 1) ELSE '' END", _enc.QUERY_COMPONENT_ESCAPES)

ORACLE["fold_builder_steps"] = r"""
WITH u AS (SELECT page_id, url, regexp_extract(url, '^([^:]+)://', 1) AS scheme,
                  regexp_extract(url, '^[^:]+://([^/?#]+)', 1) AS host,
                  regexp_extract(url, '^[^:]+://[^/?#]+(/[^?#]*)?', 1) AS path,
                  regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS qs,
                  regexp_extract(url, '#(.*)$', 1) AS frag FROM pages),
segs AS (SELECT page_id, string_split(path, '/') AS sl FROM u),
sp AS (SELECT page_id, string_agg('/' || """ + _encode_sql("s", _enc.PATH_SEGMENT_ESCAPES) + r""", '' ORDER BY i) AS p
       FROM (SELECT page_id, unnest(sl) AS s, generate_subscripts(sl, 1) AS i FROM segs) WHERE i > 1
       GROUP BY page_id),
qp AS (SELECT page_id, string_agg('&' || """ + _QK + r""" || '=' || """ + _QV + r""", '' ORDER BY i) AS q
       FROM (SELECT page_id, unnest(string_split(qs, '&')) AS kv, generate_subscripts(string_split(qs, '&'), 1) AS i
             FROM u WHERE qs <> '')
       GROUP BY page_id),
t AS (SELECT u.page_id, scheme || '://' || host || coalesce(sp.p, '') || coalesce(qp.q, '') ||
             CASE WHEN contains(url, '#') THEN '#' || """ + _encode_sql("frag", _enc.FRAGMENT_ESCAPES) + r""" ELSE '' END AS x
      FROM u LEFT JOIN sp ON sp.page_id = u.page_id LEFT JOIN qp ON qp.page_id = u.page_id)
SELECT CAST(page_id AS VARCHAR) AS builder,
       CASE WHEN strpos(x, '&') > 0 THEN substr(x, 1, strpos(x, '&') - 1) || '?' || substr(x, strpos(x, '&') + 1)
            ELSE x END AS text
FROM t"""

ORACLE["stream_url_catalog"] = ORACLE["build_url_catalog"]

ORACLE["resolve_return"] = r"""
SELECT 'tpch' AS project, 'ordersOf' || CAST(c.c_custkey AS VARCHAR) AS callee,
       'c' || CAST(c.c_custkey AS VARCHAR) AS call_id, 'o' || CAST(o.o_orderkey AS VARCHAR) AS return_id
FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey"""

ORACLE["resolve_field_access"] = r"""
SELECT 'tpch' AS project, 'Part' AS class, 'f' || CAST(l.l_partkey AS VARCHAR) AS name,
       'l' || CAST(l.l_orderkey AS VARCHAR) || '_' || CAST(l.l_linenumber AS VARCHAR) AS access_id,
       'p' || CAST(p.p_partkey AS VARCHAR) AS def_id
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey WHERE p.p_size <= 37"""

ORACLE["alias_through_params"] = r"""
WITH RECURSIVE e AS (
  SELECT DISTINCT 'cust' || CAST(o_custkey AS VARCHAR) AS caller_var, 'order' || CAST(o_orderkey AS VARCHAR) AS callee_var
  FROM orders
  UNION
  SELECT DISTINCT 'order' || CAST(l_orderkey AS VARCHAR),
         'line' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) FROM lineitem),
nodes AS (SELECT callee_var AS v FROM e UNION SELECT caller_var FROM e),
walk(var, cur, depth) AS (
  SELECT v, v, 0 FROM nodes
  UNION ALL
  SELECT w.var, e.caller_var, w.depth + 1 FROM walk w JOIN e ON e.callee_var = w.cur)
SELECT 'tpch' AS project, var, cur AS root, min(depth) AS depth
FROM walk w WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.callee_var = w.cur)
GROUP BY var, cur"""

ORACLE["nest_json_values"] = r"""
WITH lv AS (
  SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type, value,
         row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d'), event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events),
ud AS (
  SELECT user_id, day, count(*) AS n_keys,
         '{' || string_agg('"' || event_type || '":' || CAST(value AS VARCHAR), ',' ORDER BY event_type) || '}' AS doc
  FROM lv WHERE rn = 1 GROUP BY user_id, day)
SELECT 'events' AS project, 'u' || CAST(user_id AS VARCHAR) || '_' || day AS object, n_keys, doc FROM ud
UNION ALL
SELECT 'events', 'u' || CAST(user_id AS VARCHAR), count(*), '{' || string_agg('"' || day || '":' || doc, ',' ORDER BY day) || '}'
FROM ud GROUP BY user_id"""

ORACLE["fold_reassigned_puts"] = r"""
WITH m AS (SELECT user_id, event_id, event_type, value,
                  max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS mark FROM events),
r AS (SELECT *, coalesce(CAST(mark AS VARCHAR), '0') AS doc_no,
             row_number() OVER (PARTITION BY user_id, mark, event_type ORDER BY event_id DESC) AS rn FROM m)
SELECT 'events' AS project, user_id AS object, doc_no, count(*) AS n_keys,
       '{' || string_agg('"' || event_type || '":' || CAST(value AS VARCHAR), ',' ORDER BY event_type) || '}' AS doc
FROM r WHERE rn = 1 GROUP BY user_id, doc_no"""

ORACLE["extract_routes"] = r"""
SELECT p_brand AS project, 'Part' || p_partkey || '.java' AS path, 'Api' || p_partkey AS iface, 'get' || p_partkey AS method, 'GET' AS verb,
       'parts/{id}/' || lower(p_type) AS template,
       'Path:id:int:0;QueryMap::Map<String, String>:1;Query:size:' || CASE WHEN p_size % 2 = 0 THEN 'Integer' ELSE 'String' END || ':2' AS params
FROM part"""

ORACLE["extract_fields"] = r"""
SELECT p_brand AS project, 'Part' || p_partkey || '.java' AS path, 'Part' || p_partkey AS class, replace(p_name, ' ', '_') AS field,
       CASE WHEN p_size > 25 THEN 'int' ELSE 'String' END AS type, false AS is_transient, 'private' AS visibility, p_name AS renamed
FROM part"""

ORACLE["attach_http_method"] = r"""
WITH c AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey, l_linenumber),
v AS (SELECT l_orderkey, arg_min(CASE flag WHEN 'A' THEN 'POST' ELSE 'DELETE' END, l_linenumber) AS verb FROM c
      WHERE l_linenumber > 2 AND flag IN ('A', 'R') GROUP BY l_orderkey)
SELECT 'tpch' AS project, 'b' || c.l_orderkey AS builder, c.l_orderkey AS request, 'http://shop.com/c/' || o.o_custkey AS text, v.verb
FROM c JOIN orders o ON o.o_orderkey = c.l_orderkey LEFT JOIN v ON v.l_orderkey = c.l_orderkey WHERE c.l_linenumber = 2"""

ORACLE["request_body_models"] = "WITH " + EVENT_MODELS + r"""
SELECT project, canonical AS model, 'OkHttp' AS library, 'text' AS kind FROM models"""

ORACLE["read_report"] = "WITH " + PAGE_CAND + "," + DECOMPOSE + "," + CATALOG + "," + REBUILD + "," + EVENT_MODELS + r"""
SELECT project, 'ENDPOINTS' AS section,
       row_number() OVER (PARTITION BY project ORDER BY base_url || '/' || endpoint) AS idx, populated_url AS value
FROM rb
UNION ALL
SELECT project, 'JSON', row_number() OVER (PARTITION BY project ORDER BY canonical), canonical FROM models"""


def _skeleton_levels(max_depth: int = 10) -> str:
    """Bottom-up rendering of `fields` nodes, one CTE per depth (deepest first)."""
    parts = []
    tag = "CASE WHEN jtype = 'NULL' THEN 'null' ELSE '\"<' || jtype || '>\"' END"
    for d in range(max_depth, -1, -1):
        if d == max_depth:
            parts.append(f"r{d} AS (SELECT project, model_id, path, parent_path, key, idx, {tag} AS r "
                         f"FROM fields WHERE depth = {d})")
            continue
        parts.append(f"""k{d} AS (
  SELECT project, model_id, parent_path AS path,
         '{{' || string_agg(to_json(key)::VARCHAR || ':' || r, ',' ORDER BY key) || '}}' AS obj,
         '[' || string_agg(r, ',' ORDER BY idx) || ']' AS arr
  FROM r{d + 1} GROUP BY project, model_id, parent_path),
r{d} AS (
  SELECT f.project, f.model_id, f.path, f.parent_path, f.key, f.idx,
         CASE WHEN f.jtype = 'OBJECT' THEN coalesce(k.obj, '{{}}') WHEN f.jtype = 'ARRAY' THEN coalesce(k.arr, '[]')
              ELSE {tag.replace('jtype', 'f.jtype')} END AS r
  FROM fields f LEFT JOIN k{d} k ON k.project = f.project AND k.model_id = f.model_id AND k.path = f.path
  WHERE f.depth = {d})""")
    return ",\n".join(parts)


ORACLE["json_skeleton"] = "WITH " + EVENT_MODELS + "," + REGION_MODELS + ",\n" + _skeleton_levels() + r"""
SELECT project, model_id, r AS skeleton FROM r0"""

ORACLE["schema_from_fields"] = r"""
WITH RECURSIVE
g AS (SELECT p_type, p_name, min(p_size) AS s, min(p_brand) AS b FROM part GROUP BY p_type, p_name),
nt AS (SELECT p_type AS t, lead(p_type) OVER (ORDER BY p_type) AS nxt FROM (SELECT DISTINCT p_type FROM part)),
cf AS (
  SELECT upper(substr(g.p_type, 1, 1)) || lower(substr(g.p_type, 2)) AS class,
         CASE WHEN g.b = 'Brand#2' THEN upper(replace(g.p_name, ' ', '_')) ELSE replace(g.p_name, ' ', '_') END AS key,
         CASE WHEN g.s <= 10 THEN 'leaf' WHEN g.s <= 20 THEN 'leaf' WHEN g.s <= 30 OR nt.nxt IS NULL THEN 'leaf'
              WHEN g.s <= 40 THEN 'array' ELSE 'object' END AS shape,
         CASE WHEN g.s <= 10 THEN 'STRING' WHEN g.s <= 20 THEN 'NUMBER_INT'
              WHEN g.s <= 30 OR nt.nxt IS NULL THEN 'NUMBER_DOUBLE' END AS tag,
         CASE WHEN g.s > 30 AND nt.nxt IS NOT NULL THEN upper(substr(nt.nxt, 1, 1)) || lower(substr(nt.nxt, 2)) END
           AS ref_class
  FROM g JOIN nt ON nt.t = g.p_type
  WHERE g.b <> 'Brand#1'),
ef AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY key) - 1 AS eidx FROM cf),
nodes(root, path, parent_path, key, idx, depth, jtype, expand, mode) AS (
  SELECT DISTINCT class, '$', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS INTEGER), 0, 'OBJECT',
         class, 'object' FROM cf
  UNION ALL
  SELECT n.root, x.path, x.parent_path, x.key, x.idx, x.depth, x.jtype, x.expand, x.mode
  FROM nodes n JOIN ef ON ef.class = n.expand,
       LATERAL (SELECT unnest([
         CASE WHEN n.mode = 'elements' THEN {'path': n.path || '[' || CAST(ef.eidx AS VARCHAR) || ']',
                                             'parent_path': n.path, 'key': CAST(NULL AS VARCHAR),
                                             'idx': CAST(ef.eidx AS INTEGER), 'depth': n.depth + 1,
                                             'jtype': 'OBJECT', 'expand': CAST(NULL AS VARCHAR),
                                             'mode': CAST(NULL AS VARCHAR)} END,
         {'path': CASE WHEN n.mode = 'elements' THEN n.path || '[' || CAST(ef.eidx AS VARCHAR) || '].' || ef.key
                       ELSE n.path || '.' || ef.key END,
          'parent_path': CASE WHEN n.mode = 'elements' THEN n.path || '[' || CAST(ef.eidx AS VARCHAR) || ']'
                              ELSE n.path END,
          'key': ef.key, 'idx': CAST(NULL AS INTEGER),
          'depth': n.depth + CASE WHEN n.mode = 'elements' THEN 2 ELSE 1 END,
          'jtype': CASE ef.shape WHEN 'leaf' THEN ef.tag WHEN 'object' THEN 'OBJECT' ELSE 'ARRAY' END,
          'expand': CASE WHEN ef.shape IN ('object', 'array') THEN ef.ref_class END,
          'mode': CASE ef.shape WHEN 'object' THEN 'object' WHEN 'array' THEN 'elements' END}
       ]) AS x) AS u(x)
  WHERE x IS NOT NULL AND n.depth < 40),
fields AS (SELECT 'tpch' AS project, 'tpch#' || root AS model_id, path, parent_path, key, idx, depth, jtype
           FROM nodes),
""" + _skeleton_levels(24) + r"""
SELECT project, regexp_replace(model_id, '^[^#]*#', '') AS class, r AS skeleton FROM r0"""


ORACLE["extract_imports"] = "WITH " + _libraries_values() + r""",
i AS (SELECT p_brand AS project, 'Part' || p_partkey || '.java' AS path,
             """ + _library_list() + r"""[p_partkey % """ + str(len(dims.LIBRARY_KEYWORDS)) + r""" + 1] || '.X' AS import FROM part)
SELECT i.project, i.path, i.import, l.library FROM i JOIN libdim l ON contains(i.import, l.library)"""


ORACLE["converter_libraries"] = r"""
WITH c AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT 'tpch' AS project, l_orderkey AS client,
       arg_max(CASE flag WHEN 'A' THEN 'com.google.code.gson' ELSE 'com.squareup.moshi' END, l_linenumber) AS library
FROM c WHERE l_linenumber % 4 <> 0 AND flag IN ('A', 'R') GROUP BY l_orderkey"""

ORACLE["serializer_models"] = r"""
WITH t AS (SELECT DISTINCT upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS class,
                  CASE p_size % 5 WHEN 0 THEN 'com.google.code.gson' ELSE 'com.squareup.moshi' END AS library
           FROM part WHERE p_size % 5 IN (0, 1))
SELECT s.project, s.class, t.library, s.skeleton FROM (""" + ORACLE["schema_from_fields"] + r""") s JOIN t ON t.class = s.class"""

ORACLE["request_body_class_models"] = r"""
SELECT project, model, library, kind FROM (""" + ORACLE["request_body_models"] + r""")
UNION ALL
SELECT project, skeleton, 'com.squareup.moshi', 'class' FROM (""" + ORACLE["schema_from_fields"] + ")"


ORACLE["resolve_values"] = r"""
SELECT DISTINCT 'tpch' AS project, 'url' || o_orderkey AS expr_id,
       'http://' || lower(n_name) || '/c' || c_custkey || CASE WHEN o_orderkey % 3 = 0 THEN '<INTEGER>' ELSE '<STRING>' END AS value
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderkey % 3 IN (0, 1)"""


# ------------------------------------------------------------------ facts of sources
PAGE_SOURCES = r"""s AS (SELECT CAST(page_id % 7 AS VARCHAR) AS project, 'Page' || page_id || '.java' AS path, page_id,
      regexp_extract(url, '^([^:]+://[^/?#]+)', 1) AS base, regexp_extract(url, '^[^:]+://([^/?#]+)', 1) AS host FROM pages WHERE contains(url, '://'))"""

ORACLE["source_texts"] = "WITH " + PAGE_SOURCES + r""",
t AS (SELECT *, base || '/id' || page_id || '?q=k' || (page_id % 5) AS built FROM s)
SELECT project, path, 10 AS line, 'noLib.StringLiteralExpr' AS library, base || '/p/' || page_id AS text FROM s
UNION ALL SELECT project, path, 7, 'noLib.StringLiteralExpr', '/p/' || page_id FROM s
UNION ALL SELECT project, path, 14, 'noLib.StringLiteralExpr', '?q=k' || (page_id % 5) FROM s
UNION ALL SELECT project, path, unnest([12, 13, 14, 15]), 'noLib.StringBuilder', built FROM t"""

ORACLE["source_urls"] = "WITH " + PAGE_SOURCES + r"""
SELECT project, path, 'OkHttp' AS library, 'http://' || host || '/b%20c?n=' || page_id AS text, ['POST', 'PUT', 'DELETE'][page_id % 3 + 1] AS verb FROM s"""

ORACLE["source_blocks"] = "WITH " + PAGE_SOURCES + r""",
b(kind, name, start_line, end_line, depth, parent) AS (VALUES ('class', NULL, 3, 22, 0, NULL), ('method', 'path', 6, 8, 1, 'Page'),
     ('method', 'open', 9, 18, 1, 'Page'), ('method', 'tail', 19, 21, 1, 'Page'))
SELECT project, path, kind, coalesce(name, 'Page' || page_id) AS name, start_line, end_line, depth, parent || page_id AS parent FROM s, b"""

ORACLE["string_declarations"] = "WITH " + PAGE_SOURCES + r""",
v AS (SELECT project, 'BASE' AS name, base AS value FROM s UNION ALL SELECT project, 'KIND', 'k' || (page_id % 5) FROM s)
SELECT project, name, count(DISTINCT value) AS n_values, string_agg(DISTINCT value, '|' ORDER BY value) AS vals FROM v GROUP BY project, name"""

ORACLE["typed_call_rules"] = "WITH " + PAGE_SOURCES + r""",
c(kind, name, scope_type, result_type, library) AS (VALUES
     ('call', 'execute', 'org.apache.http.client.HttpClient', NULL, 'org.apache.httpcomponents'),
     ('creation', 'Builder', NULL, 'okhttp3.Request.Builder', 'com.squareup.okhttp3'))
SELECT project, path, 17 AS line, kind, name, scope_type, result_type, library FROM s, c"""

ORACLE["fold_appends_through_calls"] = r"""
WITH e AS (SELECT o_custkey, -1 AS p1, 0 AS p2, 'C' AS t FROM (SELECT DISTINCT o_custkey FROM orders)
UNION ALL SELECT o_custkey, o_orderkey, 0, o_orderstatus FROM orders
UNION ALL SELECT o_custkey, o_orderkey, l_linenumber, lower(l_returnflag) FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT 'tpch' AS project, 'cust' || o_custkey AS builder, string_agg(t, '' ORDER BY p1, p2, t) AS value FROM e GROUP BY o_custkey"""


# ------------------------------------------------------------------ files
ORACLE["read_corpus"] = r"""
SELECT CAST(page_id % 7 AS VARCHAR) AS project, count(*) AS n_lines, CAST(sum(length(url) + 1) AS BIGINT) AS n_chars
FROM pages WHERE url IS NOT NULL GROUP BY 1"""

ORACLE["list_files"] = r"""
SELECT CAST(page_id % 7 AS VARCHAR) AS project, CAST(sum(octet_length(encode(url)) + 1) AS BIGINT) AS n_bytes
FROM pages WHERE url IS NOT NULL GROUP BY 1"""

ORACLE["read_packages"] = "SELECT replace(p_name, ' ', '.') AS package_name, CAST(p_size AS BIGINT) AS version FROM part"

ORACLE["write_snippets"] = r"""
SELECT source AS project, CAST(doc_id AS VARCHAR) AS path, lang AS library FROM documents
WHERE lang IN (SELECT lang FROM documents GROUP BY lang HAVING count(*) >= 200)"""

ORACLE["write_models"] = "WITH " + EVENT_MODELS + r"""
SELECT project, library, count(*) AS n_models FROM models GROUP BY project, library"""

ORACLE["fuzzy_fill_json"] = r"""
WITH f AS (SELECT p_brand AS project, CAST(p_partkey AS VARCHAR) AS model_id, p_name AS key,
                  ['STRING', 'NUMBER_INT', 'BOOLEAN', 'NUMBER_DOUBLE'][p_size % 4 + 1] AS jtype, CASE WHEN p_partkey % 3 = 0 THEN 'known' END AS value FROM part),
v AS (SELECT p_brand AS project, p_type AS var_name, min(p_name) AS var_value FROM part GROUP BY p_brand, p_type),
s AS (SELECT k.project, k.key, v.var_value,
             row_number() OVER (PARTITION BY k.project, k.key ORDER BY jaro_winkler_similarity(k.key, v.var_name) DESC, v.var_name) AS rn
      FROM (SELECT DISTINCT project, key FROM f WHERE value IS NULL AND jtype = 'STRING') k JOIN v USING (project))
SELECT f.project, model_id, f.key, jtype, CASE WHEN value IS NOT NULL THEN value WHEN jtype = 'STRING' THEN s.var_value
       WHEN jtype = 'BOOLEAN' THEN 'true' WHEN jtype = 'NUMBER_INT' THEN '0' ELSE '0.0' END AS value
FROM f LEFT JOIN s ON s.project = f.project AND s.key = f.key AND s.rn = 1"""

ORACLE["corpus_schema"] = r"""
WITH f AS (SELECT p_brand || '/' || p_type AS project, bool_or(p_size % 3 = 0) AS num, bool_or(p_size % 3 = 1) AS dim, bool_or(p_size % 3 = 2) AS txt
           FROM part GROUP BY 1)
SELECT project, 'OBJECT<' || concat_ws(', ', CASE WHEN dim THEN 'dim: OBJECT<w: ARRAY<BIGINT>>' END, CASE WHEN num OR dim THEN 'name: STRING' END,
       CASE WHEN num AND txt THEN 'size: VARIANT' WHEN num THEN 'size: BIGINT' WHEN txt THEN 'size: STRING' END) || '>' AS schema FROM f"""
