"""DuckDB SQL that states the registered queries' results straight from the tables."""

FINDINGS = """
f AS (
  SELECT 'u-' || user_id AS doc_id, ['odcs', 'odps', 'odcl', 'okf'][event_id % 4 + 1] AS spec_id, event_type AS code, event_id AS seq,
         CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 WHEN 'click' THEN 1 ELSE 0 END AS severity_rank,
         CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' WHEN 'click' THEN 'warning' ELSE 'info' END AS severity,
         '/spec/' || (event_id % 7) || '/x' AS pointer, 'value ' || floor(value)::BIGINT AS message,
         CASE WHEN event_id % 3 = 0 THEN event_id % 100 END AS line, CASE WHEN event_id % 6 = 0 THEN event_id % 10 END AS col
  FROM events
)"""

COUNTS = "count(*) FILTER (WHERE severity_rank = 2) AS errors, count(*) FILTER (WHERE severity_rank = 1) AS warnings, count(*) FILTER (WHERE severity_rank = 0) AS infos, count(*) AS total"

r1_at_or_above = f"WITH {FINDINGS} SELECT doc_id, severity, code, seq FROM f WHERE severity_rank >= 1"

r2_severity_counts = f"""
WITH {FINDINGS}
SELECT 'document' AS level, doc_id, NULL::VARCHAR AS spec_id, {COUNTS} FROM f GROUP BY doc_id
UNION ALL SELECT 'spec', NULL, spec_id, {COUNTS} FROM f GROUP BY spec_id
UNION ALL SELECT 'run', NULL, NULL, {COUNTS} FROM f
"""

r3_worst_severity = f"WITH {FINDINGS} SELECT doc_id, spec_id, ['info', 'warning', 'error'][max(severity_rank) + 1] AS worst FROM f GROUP BY doc_id, spec_id"

r4_gate = f"""
WITH {FINDINGS}
SELECT doc_id, ['info', 'warning', 'error'][max(severity_rank) + 1] AS worst, max(severity_rank) >= 2 AS gated, CASE WHEN max(severity_rank) >= 2 THEN 1 ELSE 0 END AS exit_code
FROM f GROUP BY doc_id
"""

r5_merge_reports = f"WITH {FINDINGS} SELECT doc_id, spec_id, code, seq FROM f WHERE severity_rank = 2 UNION ALL SELECT doc_id, spec_id, code, seq FROM f WHERE spec_id = 'odcs'"

r6_sort_findings = f"WITH {FINDINGS} SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY severity_rank DESC, seq)::INTEGER AS position FROM f"

r7_run_envelope = f"""
WITH {FINDINGS}, d AS (SELECT DISTINCT 'u-' || o_custkey AS doc_id FROM orders), c AS (SELECT doc_id, max(severity_rank) AS r, {COUNTS} FROM f GROUP BY doc_id),
e AS (
  SELECT d.doc_id, CASE WHEN r >= 2 THEN 'gated' ELSE 'reported' END AS outcome, ['info', 'warning', 'error'][r + 1] AS worst,
         coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(infos, 0) AS infos, coalesce(total, 0) AS total
  FROM d LEFT JOIN c ON c.doc_id = d.doc_id
)
SELECT *, '{{"doc_id":"' || doc_id || '","outcome":"' || outcome || '","worst":' || coalesce('"' || worst || '"', 'null') || ',"counts":{{"errors":' || errors || ',"warnings":' || warnings || ',"infos":' || infos || ',"total":' || total || '}}}}' AS json FROM e
"""

r7_run_summary = f"""
WITH {FINDINGS}
SELECT 'gated' AS outcome, (SELECT count(DISTINCT o_custkey) FROM orders) AS documents, {COUNTS}, ['info', 'warning', 'error'][max(severity_rank) + 1] AS worst, 1 AS exit_code FROM f
"""

r8_findings_for_pointer = f"WITH {FINDINGS} SELECT doc_id, code, seq FROM f WHERE starts_with(pointer, '/spec/3/')"

r10_render_finding = f"""
WITH {FINDINGS}
SELECT seq, severity || '[' || code || '] ' || doc_id || coalesce(':' || line, '') || CASE WHEN line IS NOT NULL THEN coalesce(':' || col, '') ELSE '' END || ' (' || pointer || '): ' || message AS text,
       spec_id || CASE WHEN seq % 5 = 0 THEN '@1.0' ELSE '' END || CASE WHEN seq % 10 = 0 THEN ' s' ELSE '' END AS spec
FROM f
"""

CONTRACTS = """
c AS (
  SELECT o_orderkey AS k, 'contracts/' || o_orderkey AS doc_id, o_custkey, o_orderpriority, o_orderstatus, o_orderkey % 97 = 0 AS broken,
         CASE WHEN o_orderkey % 97 <> 0 AND o_orderkey % 89 <> 0 THEN
           'c-' || CASE o_orderkey % 10 WHEN 3 THEN o_orderkey - 1 WHEN 9 THEN o_orderkey - o_orderkey % 1000 ELSE o_orderkey END END AS contract_id
  FROM orders
), item AS (
  SELECT 'contracts/' || l_orderkey AS doc_id, l_orderkey AS k, l_linenumber, l_partkey, l_suppkey,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS i
  FROM lineitem
)"""

REFS = """
r AS (
  SELECT 'products/' || o_custkey AS doc_id, '/inputPorts/' || n || '/contractId' AS pointer, 'c-' || o_orderkey AS contract_id
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders JOIN customer ON c_custkey = o_custkey)
  UNION ALL
  SELECT 'products/' || o_custkey, '/outputPorts/0/contractId', 'c-' || min(o_orderkey) FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey
  UNION ALL
  SELECT 'products/' || o_custkey, '/outputPorts/0/inputContracts/' || n || '/id', 'c-' || o_orderkey
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders JOIN customer ON c_custkey = o_custkey) WHERE n < 2
)"""

v1_parse_findings = f"WITH {CONTRACTS} SELECT doc_id, 'ODCS001' AS code, 'error' AS severity FROM c WHERE broken"

s2_route_documents = f"""
WITH {CONTRACTS}
SELECT doc_id, CASE WHEN broken THEN NULL ELSE 'odcs' END AS standard FROM c UNION ALL SELECT 'products/' || c_custkey, 'odps' FROM customer
"""

s2_routing_problems = f"WITH {CONTRACTS} SELECT doc_id, 'CLI002' AS code, 'warning' AS severity FROM c WHERE broken"

x3_contract_references = f"WITH {REFS} SELECT doc_id, pointer, contract_id FROM r"

_RESOLVED = """
SELECT r.doc_id, r.pointer, r.contract_id,
       CASE WHEN {examined} = 0 THEN 'not-inspected' WHEN t.target IS NOT NULL THEN 'resolved' WHEN {unreadable} > 0 THEN 'not-inspected' ELSE 'does-not-exist' END AS state,
       CASE WHEN {examined} = 0 THEN 'outside-document-set' WHEN t.target IS NULL AND {unreadable} > 0 THEN 'inspection-failed' END AS reason,
       array_to_string(t.target, ',') AS targets
FROM r LEFT JOIN t ON t.contract_id = r.contract_id
"""
_TARGETS = "t AS (SELECT contract_id, list_sort(list(doc_id)) AS target FROM c WHERE contract_id IS NOT NULL GROUP BY contract_id)"

x4_resolve_contracts = f"WITH {CONTRACTS}, {REFS}, {_TARGETS}" + _RESOLVED.format(examined="1", unreadable="0")
x4_incomplete_corpus = f"WITH {CONTRACTS}, {REFS}, {_TARGETS}" + _RESOLVED.format(examined="1", unreadable="(SELECT count(*) FROM c WHERE contract_id IS NULL AND NOT broken)")
x4_products_only = f"WITH {CONTRACTS}, {REFS}, t AS (SELECT NULL::VARCHAR AS contract_id, NULL::VARCHAR[] AS target WHERE false)" + _RESOLVED.format(examined="0", unreadable="0")

# Of the others, sorted, the first ten and how many more there are; {0} is the list, {1} stands before the last one.
_NAMED = "CASE WHEN len({0}) > 10 THEN array_to_string({0}[1:10], ', ') || ' and ' || (len({0}) - 10) || ' more' WHEN len({0}) = 1 THEN {0}[1] ELSE array_to_string({0}[1:len({0}) - 1], ', ') || '{1}' || {0}[-1] END"
x5_contract_id_collisions = f"""
WITH {CONTRACTS}, g AS (SELECT contract_id, list_sort(list(doc_id)) AS l FROM c WHERE contract_id IS NOT NULL GROUP BY contract_id HAVING count(*) > 1),
o AS (SELECT doc_id, contract_id, list_filter(l, lambda x: x <> doc_id) AS others FROM c JOIN g USING (contract_id))
SELECT doc_id, 'CLI203' AS code, 'id ' || contract_id || ' is also declared by ' || {_NAMED.format("others", " and ")} AS message FROM o
"""

missing_contracts_gate = f"""
WITH {CONTRACTS}, {REFS}, m AS (SELECT r.doc_id, count(*) AS n FROM r WHERE contract_id NOT IN (SELECT contract_id FROM c WHERE contract_id IS NOT NULL) GROUP BY r.doc_id)
SELECT doc_id, 'warning' AS worst, n AS missing, true AS gated FROM m
"""

h1_version_behind = f"WITH {CONTRACTS} SELECT doc_id, 'ODCS200' AS code, '/apiVersion' AS pointer FROM c WHERE NOT broken AND o_orderpriority = '1-URGENT'"

h2_absent_sections = f"""
WITH {CONTRACTS}
SELECT doc_id, 'ODCS202' AS code, '/servers' AS pointer FROM c WHERE NOT broken AND k NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT doc_id, 'ODCS203', '/team' FROM c WHERE NOT broken AND o_custkey % 5 < 4
UNION ALL SELECT doc_id, 'ODCS204', '/description' FROM c WHERE NOT broken AND k % 5 < 4
"""

h3_unconventional_status = f"WITH {CONTRACTS} SELECT doc_id, 'ODCS205' AS code, '/status' AS pointer FROM c WHERE NOT broken AND o_orderstatus NOT IN ('F', 'O')"

h4_duplicate_stable_ids = f"""
WITH {CONTRACTS}, ids AS (
  SELECT doc_id, '/servers' AS a, i, 's' || (l_suppkey % 5) AS id FROM item WHERE k % 97 <> 0
  UNION ALL SELECT doc_id, '/schema/0/properties', i, 'p' || (l_partkey % 50) FROM item WHERE k % 97 <> 0
), n AS (SELECT *, row_number() OVER w AS n, first(i) OVER w AS f FROM ids WINDOW w AS (PARTITION BY doc_id, a, id ORDER BY i))
SELECT doc_id, 'ODCS206' AS code, a || '/' || i || '/id' AS pointer, 'id ' || id || ' is that of member ' || f AS message FROM n WHERE n > 1
"""

REGISTRY = """
d AS (SELECT doc_id, sha256(coalesce(text, '')) AS digest, strlen(coalesce(text, '')) AS bytes FROM documents),
g AS (
  SELECT p_partkey AS k, 'r-' || CASE WHEN p_partkey % 50 = 0 THEN p_partkey - 1 ELSE p_partkey END AS id, '/spec/' || p_partkey || '/' AS place,
         CASE WHEN p_type LIKE 'PROMO%' THEN 'moving' WHEN p_type LIKE 'SMALL%' OR p_type LIKE 'LARGE%' THEN 'absent' ELSE 'v' || p_size END AS pin,
         CASE WHEN p_partkey % 23 = 0 THEN '/abs/' WHEN p_partkey % 29 = 0 THEN 'a/../' ELSE 'docs/' END || p_partkey AS path,
         coalesce(d.digest, sha256(p_partkey::VARCHAR)) AS digest, d.digest AS actual, d.bytes
  FROM part LEFT JOIN d ON d.doc_id = p_partkey
), gap AS (
  SELECT *, list_filter([CASE WHEN k % 7 = 0 THEN 'homepage' END, CASE WHEN k % 3 = 0 THEN 'repository' END, CASE WHEN k % 6 = 0 THEN 'steward' END, CASE WHEN k % 9 = 0 THEN 'licence' END, CASE WHEN pin = 'absent' THEN 'pinned_ref' END], lambda x: x IS NOT NULL) AS gaps FROM g
)"""

p1_registry_field_rules = f"""
WITH {REGISTRY}
SELECT id AS doc_id, 'REG006' AS code, place || 'name' AS pointer FROM g WHERE k % 31 = 0
UNION ALL SELECT id, 'REG008', place || 'vendored_path' FROM g WHERE k % 23 = 0 OR k % 29 = 0
UNION ALL SELECT id, 'REG007', place || 'sha256' FROM g WHERE k % 37 = 0 AND k % 11 <> 0
UNION ALL SELECT id, 'REG010', place || 'fetched_at' FROM g WHERE k % 41 = 0
UNION ALL SELECT id, 'REG009', place || 'homepage' FROM g WHERE k % 7 <> 0 AND k % 5 = 0
UNION ALL SELECT id, 'REG009', place || 'poll/endpoint' FROM g WHERE k % 16 = 0
"""

p2_pin_rules = f"WITH {REGISTRY} SELECT id AS doc_id, CASE pin WHEN 'moving' THEN 'REG001' ELSE 'REG002' END AS code, place || 'pinned_ref' AS pointer FROM g WHERE pin IN ('moving', 'absent')"

p3_provenance_gaps = f"""
WITH {REGISTRY}
SELECT id AS doc_id, 'REG003' AS code, place || gap AS pointer FROM (SELECT id, place, unnest(gaps) AS gap FROM gap) WHERE gap <> 'pinned_ref'
UNION ALL SELECT id, 'REG004', place || 'notes' FROM gap WHERE len(gaps) > 0 AND k % 2 = 1
"""

p3_gap_totals = f"WITH {REGISTRY} SELECT count(*) FILTER (WHERE len(gaps) > 0) AS entries_with_gaps, sum(len(gaps))::BIGINT AS total_gaps, count(*) FILTER (WHERE k % 8 = 0) AS pollable FROM gap"

p4_duplicate_entry_ids = f"WITH {REGISTRY} SELECT id AS doc_id, 'REG005' AS code, place || 'id' AS pointer, 'the id is that of entry ' || (k - 1) AS message FROM g WHERE k % 50 = 0 AND k > 0"

_STATUS = "CASE WHEN actual IS NULL OR k % 23 = 0 OR k % 29 = 0 THEN 'missing' WHEN k % 11 = 0 OR k % 37 = 0 THEN 'drifted' ELSE 'matched' END"
p5_verify_digests = f"WITH {REGISTRY} SELECT id, path, {_STATUS} AS status, CASE WHEN k % 23 <> 0 AND k % 29 <> 0 THEN bytes END AS bytes FROM g"

p5_streamed_digests = f"""
WITH {REGISTRY}
SELECT id, CASE WHEN k % 43 = 0 THEN 'docs' ELSE path END AS path, CASE WHEN k % 43 = 0 THEN 'unreadable' ELSE {_STATUS} END AS status, CASE WHEN k % 43 <> 0 AND k % 23 <> 0 AND k % 29 <> 0 THEN bytes END AS bytes FROM g
"""

p5_digest_findings = f"WITH {REGISTRY}, s AS (SELECT *, {_STATUS} AS status FROM g) SELECT id AS doc_id, CASE status WHEN 'missing' THEN 'REG020' WHEN 'drifted' THEN 'REG022' ELSE 'REG023' END AS code, place || 'sha256' AS pointer FROM s"

p6_reconcile_manifest = f"""
WITH {REGISTRY}
SELECT coalesce(m.path, 'docs/' || d.doc_id) AS path,
       CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN m.path IS NULL THEN 'unlisted' WHEN k % 11 = 0 OR k % 37 = 0 THEN 'drifted' ELSE 'ok' END AS status
FROM (SELECT CASE WHEN k % 3 = 0 THEN 'moved/' ELSE '' END || path AS path, k FROM g) m FULL OUTER JOIN d ON m.path = 'docs/' || d.doc_id
"""

p8_catalogue = f"""
WITH {REGISTRY}
SELECT k::INTEGER AS idx, id, array_to_string(gaps, ',') AS gaps, {_STATUS} AS status, false AS has_validator,
       CASE WHEN k % 4 = 0 THEN '1.0' END AS version, CASE WHEN k % 9 <> 0 THEN 'l' END AS licence,
       CASE WHEN k % 7 <> 0 THEN CASE WHEN k % 5 = 0 THEN 'http://h.org' ELSE 'https://h.org' END WHEN k % 3 <> 0 THEN 'https://r.org/' || k END AS upstream
FROM gap
"""

PRODUCTS = """
p AS (
  SELECT c_custkey AS k, 'products/' || c_custkey AS doc_id, count(o_orderkey) AS n, 'p-' || c_custkey AS id
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
)"""

v2_required_missing = f"WITH {PRODUCTS} SELECT doc_id, '/outputPorts/0' AS pointer, '101' AS code, 'lacks version' AS message FROM p WHERE k % 6 = 0"
v3_unknown_property = f"WITH {PRODUCTS} SELECT doc_id, '' AS pointer, '102' AS code, 'unknown keys: colour' AS message FROM p WHERE k % 7 = 0"
v4_value_not_permitted = f"WITH {PRODUCTS} SELECT doc_id, '/apiVersion' AS pointer, '103' AS code, 'v9.9.9 is not permitted' AS message FROM p WHERE k % 11 = 0"
v5_wrong_type = f"WITH {PRODUCTS} SELECT doc_id, '/id' AS pointer, '104' AS code, 'is integer, not string' AS message FROM p WHERE k % 13 = 0"
v6_malformed_value = f"WITH {PRODUCTS} SELECT doc_id, '/team/members/0/dateIn' AS pointer, '105' AS code, '2024-13-45 does not match date' AS message FROM p WHERE k % 17 = 0"
v7_bad_cardinality = f"""
WITH {PRODUCTS}
SELECT doc_id, '/inputPorts' AS pointer, '106' AS code, CASE WHEN n > 12 THEN 'maxItems' ELSE 'minItems' END || ' is not met' AS message FROM p WHERE n > 12 OR n < 1
UNION ALL SELECT doc_id, '/outputPorts/0/inputContracts', '106', 'minItems is not met' FROM p WHERE n < 2
"""
v8_out_of_range = f"""
WITH {PRODUCTS}
SELECT doc_id, '/id' AS pointer, '107' AS code, 'minLength is not met' AS message FROM p WHERE k % 13 <> 0 AND length(id) < 4
UNION ALL SELECT doc_id, '/id', '107', 'maximum is not met' FROM p WHERE k % 13 = 0 AND k > 700
"""
v9_no_matching_alternative = f"WITH {PRODUCTS} SELECT doc_id, '/id' AS pointer, '108' AS code, 'oneOf: branches that match: 0' AS message FROM p WHERE CASE WHEN k % 13 = 0 THEN k < 100 ELSE length(id) > 4 END"
v_schema_findings = f"""
WITH {PRODUCTS}
SELECT 'ODPS' || code AS code, 'error' AS severity, n FROM (
  SELECT '101' AS code, count(*) FILTER (WHERE k % 6 = 0) AS n FROM p UNION ALL SELECT '102', count(*) FILTER (WHERE k % 7 = 0) FROM p UNION ALL SELECT '103', count(*) FILTER (WHERE k % 11 = 0) FROM p
  UNION ALL SELECT '104', count(*) FILTER (WHERE k % 13 = 0) FROM p UNION ALL SELECT '105', count(*) FILTER (WHERE k % 17 = 0) FROM p
)
"""

v_compute_assets = """
WITH s AS (SELECT p_partkey AS k, 'services/' || p_partkey AS doc_id FROM part)
SELECT doc_id, 'CADS105' AS code, '/apiVersion' AS pointer FROM s WHERE k % 5 = 0
UNION ALL SELECT doc_id, 'CADS103', '/kind' FROM s WHERE k % 7 = 0
UNION ALL SELECT doc_id, 'CADS107', '/name' FROM s WHERE k % 11 = 0
UNION ALL SELECT doc_id, 'CADS101', '' FROM s WHERE k % 3 = 0
UNION ALL SELECT doc_id, 'CADS105', '/domainId' FROM s WHERE k % 13 = 0
UNION ALL SELECT doc_id, 'CADS104', '/sla/properties/0/value' FROM s WHERE k % 17 = 0
UNION ALL SELECT doc_id, 'CADS101', '/team/0' FROM s WHERE k % 2 = 1
UNION ALL SELECT doc_id, 'CADS105', '/createdAt' FROM s WHERE k % 19 = 0
"""
v_applicators = f"""
WITH {PRODUCTS}
SELECT doc_id, 'ODPS101' AS code, '' AS pointer FROM p
UNION ALL SELECT doc_id, 'ODPS103', '/status' FROM p WHERE k % 13 = 0
UNION ALL SELECT doc_id, 'ODPS102', '' FROM p WHERE k % 7 = 0
UNION ALL SELECT doc_id, 'ODPS106', '/inputPorts' FROM p WHERE n = 0
UNION ALL SELECT doc_id, 'ODPS104', '/outputPorts/0/version' FROM p WHERE k % 6 <> 0
UNION ALL SELECT doc_id, 'ODPS108', '/id' FROM p WHERE CASE WHEN k % 13 = 0 THEN k > 700 ELSE length(id) >= 5 END
UNION ALL SELECT doc_id, 'ODPS106', '/team/members' FROM p
UNION ALL SELECT 'schema', 'ODPS100', ''
"""

LEXICON = """
x AS (SELECT c_custkey AS k, 'lexicon/' || c_custkey AS doc_id FROM customer)"""

x1_resolve_field_references = f"""
WITH {LEXICON}, t(m, raw, state, reason, target) AS (
  VALUES (0, 'orders.id', 'resolved', NULL, '/models/orders/fields/id'), (1, 'orders.missing', 'does-not-exist', NULL, NULL), (2, 'orders.tags.x', 'not-inspected', 'unsupported', NULL),
         (3, 'orders', 'not-inspected', 'unsupported', NULL), (4, 'orders.nested.x', 'resolved', NULL, '/models/orders/fields/nested/fields/x'), (5, 'other.id', 'does-not-exist', NULL, NULL)
)
SELECT doc_id, '/models/orders/fields/f1/references' AS pointer, raw, state, reason, target FROM x JOIN t ON m = k % 6
"""

x2_resolve_refs = f"""
WITH {LEXICON}, t(m, raw, state, reason, target) AS (
  VALUES (0, '#/definitions/d', 'resolved', NULL, '/definitions/d'), (1, '#/definitions/p/q', 'resolved', NULL, '/definitions/p~1q'), (2, 'other.yaml#/x', 'not-inspected', 'outside-document-set', NULL),
         (3, '#', 'not-inspected', 'unsupported', NULL), (4, '#/definitions/no', 'does-not-exist', NULL, NULL)
)
SELECT doc_id, '/models/orders/fields/f2/$ref' AS pointer, raw, state, reason, target FROM x JOIN t ON m = k % 5
"""

x_reference_findings = f"""
WITH {LEXICON}
SELECT code, severity, count(*) AS n FROM (
  SELECT ['ODCL303', 'ODCL300', 'ODCL302', 'ODCL302', 'ODCL303', 'ODCL300'][k % 6 + 1] AS code, ['info', 'warning', 'info', 'info', 'info', 'warning'][k % 6 + 1] AS severity FROM x
  UNION ALL SELECT ['ODCL303', 'ODCL303', 'ODCL302', 'ODCL302', 'ODCL301'][k % 5 + 1], ['info', 'info', 'info', 'info', 'warning'][k % 5 + 1] FROM x
) GROUP BY code, severity
"""

h5_unknown_root_keys = f"WITH {LEXICON} SELECT doc_id, 'ODCL206' AS code, '/zzz' AS pointer FROM x WHERE k % 7 = 0"
h6_untyped_fields = f"WITH {LEXICON} SELECT doc_id, 'ODCL207' AS code, '/models/orders/fields/f3' AS pointer FROM x WHERE k % 3 = 0"
h7_deprecated_keywords = f"WITH {LEXICON} SELECT doc_id, 'ODCL208' AS code, '/models/orders/fields/f1/pii' AS pointer, 'use classification' AS message FROM x WHERE k % 8 = 0"
h8_uninspected_servers = f"WITH {LEXICON} SELECT doc_id, 'ODCL304' AS code, '/servers/s' AS pointer FROM x WHERE k % 2 = 0"
h_hygiene_counts = f"""
WITH {LEXICON}
SELECT code, CASE code WHEN 'ODCL304' THEN 'info' ELSE 'warning' END AS severity, n FROM (
  SELECT 'ODCL200' AS code, count(*) FILTER (WHERE k % 4 = 0) AS n FROM x UNION ALL SELECT 'ODCL203', count(*) FILTER (WHERE k % 9 = 0) FROM x UNION ALL SELECT 'ODCL205', count(*) FILTER (WHERE k % 10 = 0) FROM x
  UNION ALL SELECT 'ODCL206', count(*) FILTER (WHERE k % 7 = 0) FROM x UNION ALL SELECT 'ODCL207', count(*) FILTER (WHERE k % 3 = 0) FROM x UNION ALL SELECT 'ODCL208', count(*) FILTER (WHERE k % 8 = 0) FROM x
  UNION ALL SELECT 'ODCL304', count(*) FILTER (WHERE k % 2 = 0) FROM x
)
"""

r11_checked_against = f"""
WITH {CONTRACTS}, n AS (SELECT count(*) AS products, (SELECT count(*) FROM c WHERE NOT broken) AS contracts FROM customer)
SELECT 'CLI006' AS code, 'error' AS severity, products AS n FROM n UNION ALL SELECT 'ODPS900', 'error', products FROM n UNION ALL SELECT 'ODPS901', 'error', products FROM n UNION ALL SELECT 'ODCS904', 'info', contracts FROM n
"""

r9_documents_by_spec = f"WITH {CONTRACTS} SELECT 'products/' || c_custkey AS doc_id FROM customer UNION ALL SELECT doc_id FROM c WHERE broken"

m1_contract_catalogue = f"""
WITH {CONTRACTS}
SELECT doc_id, contract_id AS id, CASE o_orderstatus WHEN 'F' THEN 'retired' WHEN 'O' THEN 'active' ELSE 'in-review' END AS status, 1::BIGINT AS schema_count,
       (SELECT count(*) FROM item WHERE item.doc_id = c.doc_id) AS property_count, 't' AS names, false AS is_multi_table, 0 AS extra_keys
FROM c WHERE NOT broken
"""

m2_flatten_properties = f"WITH {CONTRACTS} SELECT doc_id, '/schema/0/properties/' || i AS pointer, 't.c' || l_linenumber AS path, false AS is_object, false AS is_array, false AS has_nested FROM item WHERE k % 97 <> 0"

m3_primary_keys = f"""
WITH {CONTRACTS}
SELECT doc_id, '/schema/0' AS schema, string_agg('c' || l_linenumber, ',' ORDER BY l_partkey % 3, i) AS keys FROM item WHERE k % 97 <> 0 AND l_suppkey % 3 = 0 GROUP BY doc_id
"""

m4_metric_view_sources = """
SELECT 'views/' || n_nationkey AS doc_id, (generate_subscripts(l, 1) - 1)::INTEGER AS position, unnest(l) AS source
FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN ['orders', 'customer', 'region', 'part', 'orders'] ELSE ['orders', 'customer', 'part', 'orders'] END AS l FROM nation)
"""

m5_high_risk = "SELECT 'assets/' || s_suppkey AS doc_id FROM supplier WHERE s_suppkey % 4 = 0"
m5_compliance_by_framework = """
SELECT 'gdpr' AS framework, count(*) AS assets, count(*) FILTER (WHERE s_suppkey % 3 = 1) AS non_compliant FROM supplier
UNION ALL SELECT 'sox', count(*), count(*) FILTER (WHERE s_suppkey % 4 = 0) FROM supplier
"""

STAR = "v AS (SELECT *, strftime(o_orderdate, '%Y-%m') AS month FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus <> 'P')"

e1_evaluate_metric_view = f"WITH {STAR} SELECT n_name AS nation, c_mktsegment AS segment, round(sum(o_totalprice), 2) AS revenue, count(*) AS orders FROM v GROUP BY 1, 2"
e2_windowed_measures = f"""
WITH {STAR}, g AS (SELECT c_mktsegment AS segment, month, count(*) AS orders FROM v GROUP BY 1, 2)
SELECT segment, month, (sum(orders) OVER (PARTITION BY segment ORDER BY month))::BIGINT AS running, orders FROM g
"""
e2_semiadditive_measures = f"WITH {STAR} SELECT c_mktsegment AS segment, count(*) AS running FROM v GROUP BY 1"
_BUYERS = "d AS (SELECT segment, first AS month, count(*) AS new FROM (SELECT c_mktsegment AS segment, o_custkey, min(month) AS first FROM v GROUP BY 1, 2) GROUP BY 1, 2)"
_MONTHS = f"g AS (SELECT c_mktsegment AS segment, month, max(o_totalprice) AS hi, min(o_totalprice) AS lo, sum(o_totalprice) AS s, count(o_totalprice) AS c FROM v GROUP BY 1, 2), {_BUYERS}, m AS (SELECT g.*, coalesce(new, 0) AS new FROM g LEFT JOIN d USING (segment, month))"
e2_windowed_states = f"""
WITH {STAR}, {_MONTHS}
SELECT segment, month, max(hi) OVER w AS largest, max(hi) OVER w AS first_largest, min(lo) OVER (PARTITION BY segment) AS smallest, round(sum(s) OVER w / sum(c) OVER w, 2) AS mean, (sum(new) OVER w)::BIGINT AS buyers,
       round(sum(s) OVER w / sum(new) OVER w, 2) AS of_each_buyer, round(s / c, 2) AS own_mean
FROM m WINDOW w AS (PARTITION BY segment ORDER BY month)
"""
e2_semiadditive_states = f"""
WITH {STAR}, {_MONTHS}
SELECT segment, max(hi) AS largest, arg_min(hi, month) AS first_largest, round(sum(s) / sum(c), 2) AS mean, sum(new)::BIGINT AS buyers, round(sum(s) / sum(c), 2) AS own_mean FROM m GROUP BY segment
"""
_ROWS = "r AS (SELECT c_mktsegment AS segment, month, o_custkey AS c, o_custkey % 7 AS k, o_orderpriority AS p FROM v)"
_SO_FAR = """
    count(DISTINCT c) OVER w AS buyers_so_far, (sum(DISTINCT k) OVER w)::BIGINT AS keys_so_far, round(sum(DISTINCT k) OVER w / count(DISTINCT k) OVER w, 4) AS mean_key_so_far,
    count(DISTINCT (k, p)) OVER (PARTITION BY segment) AS pairs_in_all, count(*) FILTER (WHERE p = '1-URGENT') OVER w AS urgent_so_far"""
e2_distinct_measures = f"""
WITH {STAR}, {_ROWS}, w AS (SELECT DISTINCT segment, month, {_SO_FAR} FROM r WINDOW w AS (PARTITION BY segment ORDER BY month)),
o AS (SELECT segment, month, count(DISTINCT c) AS own_buyers, (sum(DISTINCT k) FILTER (WHERE k > 2))::BIGINT AS own_keys FROM r GROUP BY 1, 2)
SELECT w.*, own_buyers, own_keys FROM w JOIN o ON w.segment IS NOT DISTINCT FROM o.segment AND w.month = o.month
"""
e2_semiadditive_distinct = f"""
WITH {STAR}, {_ROWS}
SELECT segment, count(DISTINCT c) AS buyers_so_far, sum(DISTINCT k)::BIGINT AS keys_so_far, round(sum(DISTINCT k) / count(DISTINCT k), 4) AS mean_key_so_far, count(DISTINCT (k, p)) AS pairs_in_all,
       count(*) FILTER (WHERE p = '1-URGENT') AS urgent_so_far, count(DISTINCT c) AS own_buyers, (sum(DISTINCT k) FILTER (WHERE k > 2))::BIGINT AS own_keys
FROM r GROUP BY segment
"""
_OF = "count(*) AS orders, count(DISTINCT o_custkey) AS buyers"
e3_lattice_views = f"""
WITH {STAR}
SELECT 'fine' AS view, n_name AS nation, c_mktsegment AS segment, NULL AS month, {_OF}, max(o_totalprice) AS largest, NULL AS mean_key FROM v GROUP BY 2, 3
UNION ALL SELECT 'nation', n_name, NULL, NULL, {_OF}, max(o_totalprice), round(avg(o_custkey), 3) FROM v GROUP BY 2
UNION ALL SELECT 'month', NULL, NULL, month, {_OF}, NULL, round(avg(o_custkey), 3) FROM v GROUP BY 4
UNION ALL SELECT 'all', NULL, NULL, NULL, {_OF}, max(o_totalprice), round(avg(o_custkey), 3) FROM v
"""
e3_materialize_views = f"WITH {STAR} SELECT c_mktsegment AS segment, count(*) AS orders FROM v GROUP BY 1 UNION ALL SELECT 'all rows', count(*) FROM v"

e4_check_constraints = """
SELECT 'lineitem' AS object, property, rule, violations FROM (
  SELECT 'l_orderkey' AS property, 'required' AS rule, count(*) FILTER (WHERE l_orderkey IS NULL) AS violations FROM lineitem
  UNION ALL SELECT 'l_quantity', 'minimum', count(*) FILTER (WHERE l_quantity < 2) FROM lineitem
  UNION ALL SELECT 'l_quantity', 'exclusiveMaximum', count(*) FILTER (WHERE l_quantity >= 50) FROM lineitem
  UNION ALL SELECT 'l_discount', 'maximum', count(*) FILTER (WHERE l_discount > 0.05) FROM lineitem
  UNION ALL SELECT 'l_returnflag', 'minLength', count(*) FILTER (WHERE length(l_returnflag) < 1) FROM lineitem
  UNION ALL SELECT 'l_returnflag', 'pattern', count(*) FILTER (WHERE NOT regexp_full_match(l_returnflag, '[A-N]')) FROM lineitem
  UNION ALL SELECT 'l_partkey', 'unique', count(l_partkey) - count(DISTINCT l_partkey) FROM lineitem
  UNION ALL SELECT 'l_orderkey,l_linenumber', 'primaryKey', count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) FROM lineitem
)
"""

e5_check_quality_rules = """
SELECT 'rows' AS name, 'rowCount' AS metric, count(*)::DOUBLE AS value, count(*) > 100 AND count(*) <= 10000000 AS passed FROM orders
UNION ALL SELECT 'nulls', 'nullValues', count(*) FILTER (WHERE o_custkey IS NULL)::DOUBLE, count(*) FILTER (WHERE o_custkey IS NULL) = 0 FROM orders
UNION ALL SELECT 'repeats', 'duplicateValues', (count(o_custkey) - count(DISTINCT o_custkey))::DOUBLE, count(o_custkey) - count(DISTINCT o_custkey) BETWEEN 0 AND 10 FROM orders
UNION ALL SELECT 'price', 'sql', (max(o_orderkey) - min(o_orderkey))::DOUBLE, max(o_orderkey) - min(o_orderkey) NOT IN (1, 2) AND max(o_orderkey) - min(o_orderkey) >= 3 FROM orders
"""

_ORPHANS = "SELECT '{0}' AS relationship, count(*) AS orphans, coalesce((SELECT string_agg('{{' || k || '}}', ';' ORDER BY k) FROM (SELECT DISTINCT {1} AS k FROM {2} ORDER BY 1 LIMIT 3)), '') AS sample FROM {2}"
e6_check_relationships = f"""
WITH a AS (SELECT * FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)), b AS (SELECT * FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'))
{_ORPHANS.format("orders.o_custkey -> customer.c_custkey", "o_custkey", "a")} UNION ALL {_ORPHANS.format("lineitem.l_orderkey -> closed.o_orderkey", "l_orderkey", "b")}
"""

t1_pointer_escape = "SELECT doc_id, replace(replace(text || '~1/' || source, '~', '~0'), '/', '~1') AS escaped, CASE WHEN text IS NOT NULL AND source IS NOT NULL THEN true END AS round_trip FROM documents"

_MARKS = "CASE conv_id % 4 WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} ELSE {3} END"
_HTML = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#39;')"
t1_pointer_escape_whole = "SELECT doc_id, replace(replace('~1/' || text, '~', '~0'), '/', '~1') AS escaped, CASE WHEN text IS NOT NULL THEN true END AS round_trip FROM documents"

# Whole texts, character by character; {1} and {2} are put around the code point.
_EACH = "array_to_string(list_transform(string_split({0}, ''), lambda c: CASE WHEN {3} THEN '{1}' || printf('%04X', unicode(c)) || '{2}' ELSE c END), '')"
_CODES = "unicode(c) < 32 OR unicode(c) BETWEEN 127 AND 159 OR unicode(c) IN (173, 8288, 65279) OR unicode(c) BETWEEN 8203 AND 8207 OR unicode(c) BETWEEN 8232 AND 8238 OR unicode(c) BETWEEN 8294 AND 8297"
_PLANTED = _MARKS.format("chr(8238)", "chr(8203)", "chr(27) || chr(9)", "'<&>'") + " || text"
_INSERTED = "substr(text, 1, 10) || " + _MARKS.format("chr(8238)", "chr(8203)", "chr(27) || chr(9)", "'<&>'") + " || substr(text, 11)"
t2_neutralise_for_terminal = f"SELECT conv_id, turn, {_EACH.format('x', '<U+', '>', _CODES)} AS shown FROM (SELECT conv_id, turn, {_INSERTED} AS x FROM conversations)"
t3_neutralise_for_html = f"SELECT conv_id, turn, {_EACH.format('x', '&lt;U+', '&gt;', f'unicode(c) NOT IN (9, 10, 13) AND ({_CODES})')} AS shown FROM (SELECT conv_id, turn, {_HTML.format(_INSERTED)} AS x FROM conversations)"
t2_neutralise_whole_for_terminal = f"SELECT conv_id, turn, {_EACH.format('x', '<U+', '>', _CODES)} AS shown FROM (SELECT conv_id, turn, {_PLANTED} AS x FROM conversations)"
t3_neutralise_whole_for_html = f"SELECT conv_id, turn, {_EACH.format('x', '&lt;U+', '&gt;', f'unicode(c) NOT IN (9, 10, 13) AND ({_CODES})')} AS shown FROM (SELECT conv_id, turn, {_HTML.format(_PLANTED)} AS x FROM conversations)"
t6_bundle_relative = r"""
SELECT page_id, CASE WHEN ltrim(p, '/') <> '' AND NOT regexp_matches(ltrim(p, '/'), '(^|/)(|\.|\.\.)(/|$)') THEN ltrim(p, '/') END AS path, NULL::VARCHAR AS leaving, NULL::VARCHAR AS whole
FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1) AS p FROM pages)
"""

BUNDLE = """
b AS (
  SELECT DISTINCT doc_id % 100 AS k, 'b' || (doc_id // 100) AS bundle, doc_id // 100 AS m FROM documents WHERE doc_id IS NOT NULL
), n AS (
  SELECT *, 'n/' || k || CASE WHEN k % 25 = 24 THEN ' x' ELSE '' END AS id, bundle || '/n/' || k || CASE WHEN k % 25 = 24 THEN ' x' ELSE '' END || '.md' AS doc_id, k % 40 = 39 AS blank,
         CASE WHEN k % 12 = 5 AND k % 29 <> 0 THEN 'deprecated' WHEN k % 12 = 6 AND k % 29 <> 0 THEN 'draft' WHEN k % 12 = 7 AND k % 29 <> 0 THEN 'odd' ELSE 'stable' END AS status,
         CASE WHEN (k // 3) % 4 = 0 AND k % 3 = 2 THEN k - 2 ELSE k + 1 END AS derived
  FROM b
), there AS (SELECT bundle, k AS target FROM n WHERE k % 25 <> 24)"""

s4_read_bundles = f"""
WITH {BUNDLE}
SELECT bundle, id AS concept_id, id || '.md' AS path,
       (5 + (k % 11 <> 0)::INT + (k % 7 <> 0)::INT + (k % 14 < 2)::INT + (k % 10 <> 9)::INT + (k % 20 = 9)::INT + (k % 23 = 0)::INT)::INTEGER AS n_keys
FROM n
"""
k1_concept_type = f"WITH {BUNDLE} SELECT doc_id, CASE WHEN k % 11 = 0 THEN 'OKF002' ELSE 'OKF003' END AS code, CASE WHEN k % 11 = 0 THEN 'error' ELSE 'info' END AS severity FROM n WHERE k % 11 = 0 OR k % 13 = 0"
k2_recommended_keys = f"WITH {BUNDLE} SELECT doc_id, 'OKF004' AS code, 'warning' AS severity FROM n WHERE k % 7 = 0"
k3_empty_bodies = f"WITH {BUNDLE} SELECT doc_id, 'OKF005' AS code, 'warning' AS severity FROM n WHERE blank"
k4_tags_shape = f"WITH {BUNDLE} SELECT doc_id, 'OKF006' AS code, 'warning' AS severity FROM n WHERE k % 5 < 3"
k5_trust_events = f"""
WITH {BUNDLE}
SELECT doc_id, ['OKF102', 'OKF103', 'OKF101'][k % 4 + 1] AS code, 'warning' AS severity FROM n WHERE k % 4 < 3
UNION ALL SELECT doc_id, 'OKF104', 'warning' FROM n WHERE k % 14 = 0
UNION ALL SELECT doc_id, unnest(['OKF106', 'OKF107']), 'warning' FROM n WHERE k % 14 = 1
"""
k6_lifecycle = f"WITH {BUNDLE} SELECT doc_id, 'OKF108' AS code, 'info' AS severity FROM n WHERE status = 'odd' UNION ALL SELECT doc_id, 'OKF109', 'warning' FROM n WHERE k % 17 = 0"
k7_usage_window = f"WITH {BUNDLE} SELECT doc_id, 'OKF110' AS code, 'warning' AS severity FROM n WHERE k % 20 = 9"
k8_footnote_attribution = f"""
WITH {BUNDLE}
SELECT doc_id, 'OKF111' AS code, 'warning' AS severity FROM n WHERE NOT blank AND k % 15 = 2
UNION ALL SELECT doc_id, 'OKF111', 'warning' FROM n WHERE NOT blank AND k % 4 <> 1 AND k % 10 = 9
UNION ALL SELECT doc_id, 'OKFL05', 'warning' FROM n WHERE k % 10 <> 9 AND (blank OR k % 4 = 1)
"""
k9_legacy_keys = f"WITH {BUNDLE} SELECT doc_id, 'OKF201' AS code, 'warning' AS severity FROM n WHERE k % 23 = 0 UNION ALL SELECT doc_id, 'OKF202', 'warning' FROM n WHERE k % 24 = 7 AND NOT blank"
k11_resolve_resources = f"WITH {BUNDLE} SELECT doc_id, 'OKF401' AS code, 'warning' AS severity FROM n WHERE k % 10 <> 9 AND NOT EXISTS (SELECT 1 FROM there t WHERE t.bundle = n.bundle AND t.target = derived)"
k12_link_targets = f"""
WITH {BUNDLE}
SELECT doc_id, 'OKF402' AS code, 'info' AS severity FROM n WHERE NOT blank AND NOT EXISTS (SELECT 1 FROM there t WHERE t.bundle = n.bundle AND t.target = k + 1)
UNION ALL SELECT doc_id, 'OKF402', 'info' FROM n WHERE NOT blank AND k % 9 = 0
UNION ALL SELECT doc_id, 'OKF402', 'info' FROM n WHERE NOT blank AND k % 10 = 0 AND k % 25 = 24
UNION ALL SELECT n.doc_id, 'OKF403', 'warning' FROM n JOIN n o ON o.bundle = n.bundle AND o.k = n.k + 1 AND o.status = 'deprecated' AND o.k % 25 <> 24 WHERE NOT n.blank
UNION ALL SELECT doc_id, 'OKF403', 'warning' FROM n WHERE NOT blank AND k % 10 = 0 AND status = 'deprecated' AND k % 25 <> 24
UNION ALL SELECT doc_id, 'OKFL10', 'warning' FROM n WHERE NOT blank AND k % 10 = 0 AND k % 25 <> 24
"""
k14_declared_versions = f"WITH {BUNDLE} SELECT DISTINCT bundle || '/index.md' AS doc_id, 'OKF405' AS code, 'info' AS severity FROM n WHERE m % 10 = 3"
k15_duplicate_titles = f"""
WITH {BUNDLE}, g AS (SELECT bundle, k % 30 AS t, list_sort(list(id)) AS l FROM n GROUP BY 1, 2 HAVING count(*) > 1)
SELECT doc_id, 'OKF406' AS code, 'shares its title with ' || {_NAMED.format("list_filter(l, lambda x: x <> id)", ", ")} AS message FROM n JOIN g ON g.bundle = n.bundle AND g.t = k % 30
"""
k16_circular_derivation = f"""
WITH RECURSIVE {BUNDLE}, e AS (SELECT bundle, k AS a, derived AS b FROM n WHERE k % 10 <> 9 AND k % 25 <> 24 AND EXISTS (SELECT 1 FROM there t WHERE t.bundle = n.bundle AND t.target = derived)),
r(bundle, a, b) AS (SELECT bundle, a, b FROM e UNION SELECT r.bundle, r.a, e.b FROM r JOIN e ON e.bundle = r.bundle AND e.a = r.b),
s AS (SELECT r.bundle, r.a, list_sort(list('n/' || r.b)) AS l FROM r JOIN r q ON q.bundle = r.bundle AND q.a = r.b AND q.b = r.a GROUP BY r.bundle, r.a)
SELECT bundle || '/n/' || a || '.md' AS doc_id, 'OKF112' AS code, 'derives from itself: ' || array_to_string(l, ' -> ') AS message FROM s WHERE l[1] = 'n/' || a
"""
k17_index_listings = f"""
WITH {BUNDLE}
SELECT DISTINCT bundle || '/index.md' AS doc_id, 'OKF407' AS code, 'warning' AS severity FROM n
UNION ALL SELECT doc_id, 'OKFL09', 'warning' FROM n WHERE k % 8 = 0 OR k % 25 = 24
"""
l1_heading_structure = f"""
WITH {BUNDLE}
SELECT doc_id, 'OKFL01' AS code, 'warning' AS severity FROM n WHERE blank OR (k % 8 = 3 AND k % 16 <> 4 AND k % 24 <> 7)
UNION ALL SELECT doc_id, 'OKFL03', 'warning' FROM n WHERE NOT blank AND k % 8 <> 3 AND k % 16 = 4
UNION ALL SELECT doc_id, 'OKFL03', 'warning' FROM n WHERE NOT blank AND k % 8 <> 3 AND k % 24 = 7
UNION ALL SELECT doc_id, 'OKFL03', 'warning' FROM n WHERE NOT blank AND k % 8 <> 3 AND k % 9 = 4
"""
l2_key_order = f"WITH {BUNDLE} SELECT doc_id, 'OKFL02' AS code, 'info' AS severity FROM n WHERE k % 29 = 0"
l3_actor_convention = f"WITH {BUNDLE} SELECT doc_id, 'OKFL06' AS code, 'info' AS severity FROM n WHERE k % 6 = 0 AND k % 10 <> 9"
l5_trailing_whitespace = f"WITH {BUNDLE} SELECT doc_id, 'OKFL08' AS code, CASE WHEN blank THEN '1' ELSE '2' END AS n FROM n WHERE blank OR k % 6 = 1"
l6_portable_ids = f"WITH {BUNDLE} SELECT doc_id, 'OKFR01' AS code, 'warning' AS severity FROM n WHERE k % 25 = 24"
l7_unverified_and_draft = f"WITH {BUNDLE} SELECT doc_id, 'OKFL11' AS code, 'info' AS severity FROM n WHERE k % 14 <> 1 UNION ALL SELECT doc_id, 'OKFL12', 'warning' FROM n WHERE status = 'draft'"
l8_code_block_syntax = f"WITH {BUNDLE} SELECT doc_id, 'OKF007' AS code, 'info' AS severity FROM n WHERE NOT blank AND k % 5 = 3"
l9_language_coverage = f"""
WITH {BUNDLE}
SELECT 'json' AS language, count(*) AS blocks, count(*) AS concepts, true AS checkable FROM n WHERE NOT blank AND k % 5 IN (2, 3)
UNION ALL SELECT '', count(*), count(*), false FROM n WHERE NOT blank AND k % 5 = 4
"""

p7_verdict_agreement = """
WITH d AS (SELECT DISTINCT doc_id AS k FROM documents WHERE doc_id IS NOT NULL)
SELECT k AS doc_id, CASE WHEN k % 3 = 0 THEN 'uncovered' WHEN k % 5 = 0 THEN 'orphan' WHEN k % 7 = 0 THEN 'stale'
       WHEN (k % 2 = 0) = (k % 8 < 5) AND k % 4 = 0 THEN 'converged-but-listed' WHEN (k % 2 = 0) = (k % 8 < 5) THEN 'agree' WHEN k % 4 = 0 THEN 'known-divergence' ELSE 'unexpected-divergence' END AS status
FROM d
"""
p7_verdict_balance = """
WITH d AS (SELECT DISTINCT doc_id AS k FROM documents WHERE doc_id IS NOT NULL), v AS (
  SELECT 'recorded' AS side, count(*) FILTER (WHERE k % 3 <> 0 AND k % 2 = 0) AS passes, count(*) FILTER (WHERE k % 3 <> 0 AND k % 2 = 1) AS fails FROM d
  UNION ALL SELECT 'computed', count(*) FILTER (WHERE k % 5 <> 0 AND k % 8 < 5), count(*) FILTER (WHERE k % 5 <> 0 AND k % 8 >= 5) FROM d
)
SELECT *, passes >= 2 AND fails >= 2 AS discriminates FROM v
"""
v4_enum_of_objects = """
SELECT 'orders/' || o_orderkey AS doc_id, '/tag' AS pointer, 'this object is not permitted' AS message FROM orders
WHERE NOT coalesce((o_orderstatus = 'O' AND o_orderkey % 5 = 3) OR (o_orderstatus = 'F' AND o_orderkey % 5 = 2) OR (o_orderstatus = 'P' AND o_orderkey % 5 = 0), false)
"""
v7_equal_members = """
SELECT 'orders/' || o_orderkey AS doc_id, '/lines' AS pointer, 'members are equal' AS message
FROM (SELECT l_orderkey AS o_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > count(DISTINCT (l_partkey % 2, l_suppkey % 3))) JOIN orders USING (o_orderkey)
"""
v8_exact_bounds = """
WITH h AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE 0 END AS unit, 301 + o_orderkey % 40 AS digits FROM orders)
SELECT 'orders/' || k AS doc_id, '/huge' AS pointer, 'maximum is not met' AS message FROM h WHERE k % 7 <> 0 AND (digits > 321 OR (digits = 321 AND unit > 0))
UNION ALL SELECT 'orders/' || k, '/huge', 'exclusiveMinimum is not met' FROM h WHERE k % 7 = 0 AND digits >= 310
UNION ALL SELECT 'orders/' || k, '/huge', 'multipleOf is not met' FROM h
"""
k16_rings_through_one = """
WITH c AS (SELECT DISTINCT c_custkey AS k, c_custkey // 100 * 100 AS hub FROM customer WHERE c_custkey IS NOT NULL)
SELECT hub::VARCHAR AS bundle, printf('c%08d', hub) AS start, printf('c%08d', hub) || CASE WHEN k = hub THEN '' ELSE printf(' -> c%08d', k) END AS walk FROM c
"""
_MERGED = "m AS (SELECT 0 AS r, * FROM f WHERE severity_rank = 2 UNION ALL SELECT 1, * FROM f WHERE spec_id = 'odcs' UNION ALL SELECT 2, * FROM f), p AS (SELECT *, row_number() OVER (ORDER BY r, doc_id NULLS FIRST, seq) - 1 AS position FROM m)"
r5_merged_order = f"WITH {FINDINGS}, {_MERGED} SELECT doc_id, seq, severity, position FROM p"
r6_sorted_merge = f"WITH {FINDINGS}, {_MERGED} SELECT doc_id, seq, severity, position, row_number() OVER (ORDER BY severity_rank DESC, position) - 1 AS rank FROM p"
s6_published_runs = f"""
WITH {FINDINGS}
SELECT 'first' AS run, severity, count(*) AS n, count(DISTINCT doc_id) AS documents FROM f GROUP BY severity
UNION ALL SELECT 'second', severity, count(*), count(DISTINCT doc_id) FROM f WHERE severity_rank = 2 GROUP BY severity
"""
p7_own_verdicts = """
WITH s AS (SELECT p_partkey AS k, CASE WHEN k % 5 = 0 OR k % 7 = 0 OR k % 11 = 0 OR k % 3 = 0 OR k % 13 = 0 OR k % 17 = 0 OR k % 2 = 1 OR k % 19 = 0 THEN 'err' ELSE 'ok' END AS verdict FROM part)
SELECT 'services/' || k AS doc_id, verdict, k % 3 = 0 AS validated, CASE WHEN (verdict = 'ok') = (k % 2 = 0) THEN 'agree' ELSE 'unexpected-divergence' END AS status FROM s
"""
_EVENT = "SELECT 'events/' || event_id AS doc_id, {pointer} AS pointer, {parent} AS parent, {key} AS key, {idx}::INTEGER AS idx, {depth} AS depth, {kind} AS kind, {sval} AS sval, {nval}::DOUBLE AS nval, {n} AS n_children, {path} AS rule_path FROM events WHERE event_id IS NOT NULL"
_EVENT_NODES = [
    ("''", "NULL", "NULL", "NULL", 0, "'object'", "NULL", "NULL", 5, "''"),
    ("'/id'", "''", "'id'", "NULL", 1, "'integer'", "event_id::VARCHAR", "event_id", 0, "'/id'"),
    ("'/user'", "''", "'user'", "NULL", 1, "'object'", "NULL", "NULL", 2, "'/user'"),
    ("'/user/id'", "'/user'", "'id'", "NULL", 2, "CASE WHEN user_id IS NULL THEN 'null' ELSE 'integer' END", "coalesce(user_id::VARCHAR, 'null')", "user_id", 0, "'/user/id'"),
    ("'/user/tags~1x'", "'/user'", "'tags/x'", "NULL", 2, "'array'", "NULL", "NULL", 3, "'/user/tags~1x'"),
    ("'/user/tags~1x/0'", "'/user/tags~1x'", "NULL", "0", 3, "'string'", "'a'", "NULL", 0, "'/user/tags~1x/*'"),
    ("'/user/tags~1x/1'", "'/user/tags~1x'", "NULL", "1", 3, "'string'", "coalesce(event_type, '')", "NULL", 0, "'/user/tags~1x/*'"),
    ("'/user/tags~1x/2'", "'/user/tags~1x'", "NULL", "2", 3, "'array'", "NULL", "NULL", 0, "'/user/tags~1x/*'"),
    ("'/value'", "''", "'value'", "NULL", 1, "'number'", "(event_id % 1000) || '.25'", "event_id % 1000 + 0.25", 0, "'/value'"),
    ("'/even'", "''", "'even'", "NULL", 1, "'boolean'", "CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END", "NULL", 0, "'/even'"),
    ("'/servers'", "''", "'servers'", "NULL", 1, "'object'", "NULL", "NULL", 1, "'/servers'"),
    ("'/servers/s' || event_id % 3", "'/servers'", "'s' || event_id % 3", "NULL", 2, "'number'", "'1.0'", "1.0", 0, "'/servers/*'"),
]
s3_json_nodes = " UNION ALL ".join(_EVENT.format(**dict(zip(("pointer", "parent", "key", "idx", "depth", "kind", "sval", "nval", "n", "path"), row, strict=True))) for row in _EVENT_NODES)
s1_unreadable_files = """
SELECT doc_id || '.json' AS file, strlen(t) + bad AS bytes, CASE WHEN bad = 0 THEN sha256(t) END AS sha256, CASE WHEN bad = 1 THEN 'CLI001' END AS code,
       CASE WHEN bad = 1 THEN 'cannot be read: not UTF-8 at byte ' || strlen(t) END AS message
FROM (SELECT doc_id, min(coalesce(text, '')) AS t, CASE WHEN doc_id % 10 = 3 THEN 1 ELSE 0 END AS bad FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id)
UNION ALL SELECT 'nothing.yaml', NULL, NULL, 'CLI001', 'cannot be read: no such file or folder'
"""
s1_read_documents = "SELECT c_custkey, c_name FROM customer"
s5_read_registries = """
WITH m AS (SELECT p_partkey // 100 AS m, count(*) AS n, count(*) FILTER (WHERE p_partkey % 3 = 0) AS p, bool_or(p_partkey % 700 = 0) AS odd FROM part GROUP BY 1),
c AS (SELECT *, CASE WHEN m % 11 = 5 THEN 'REG100' WHEN m % 7 = 4 OR odd THEN 'REG101' WHEN m % 5 = 3 THEN 'REG102' END AS code FROM m)
SELECT 'registries/' || m AS doc_id, CASE WHEN code IS NULL THEN n ELSE 0 END AS entries, CASE WHEN code IS NULL THEN p ELSE 0 END AS polled, code FROM c
"""
s6_diagnostic_json = f"""
WITH {FINDINGS}
SELECT doc_id, seq, '{{"severity":"' || severity || '","code":"' || code || '","message":"' || message || '","help":null,"location":{{"document":"' || doc_id || '","line":' || coalesce(line::VARCHAR, 'null') || ',"column":' || coalesce(col::VARCHAR, 'null')
       || ',"pointer":"' || pointer || '"}},"spec_ref":{{"id":"' || spec_id || '","version":' || CASE WHEN seq % 5 = 0 THEN '"1.0"' ELSE 'null' END || ',"section":' || CASE WHEN seq % 10 = 0 THEN '"s"' ELSE 'null' END || '}}}}' AS json FROM f
"""
r7_run_json = f"""
WITH {FINDINGS}, n AS (SELECT (SELECT count(DISTINCT o_custkey) FROM orders) AS documents, {COUNTS}, ['info', 'warning', 'error'][max(severity_rank) + 1] AS worst FROM f)
SELECT '{{"schema_version":1,"tool":{{"name": "audit", "version": "2"}},"command":"validate","summary":{{"outcome":"gated","specs":2,"documents":' || documents || ',"diagnostics":' || total || ',"error":' || errors || ',"warning":' || warnings || ',"info":' || infos
       || '}},"gate":{{"policy":"at-or-above","threshold":"warning","gated":true,"worst_severity":"' || worst || '"}},"exit_code":1,"specs":[{{"id": "odcs", "version": "3.1.0"}}, {{"id": "odps", "version": null}}]}}' AS json FROM n
"""
s6_findings_json = f"""
WITH {FINDINGS}
SELECT doc_id, seq, '{{"doc_id":"' || doc_id || '","spec_id":"' || spec_id || '","severity":"' || severity || '","code":"' || code || '","line":' || coalesce(line::VARCHAR, 'null') || ',"seq":' || seq || '}}' AS json FROM f
"""
t5_extract_links = f"""
WITH {BUNDLE}, l AS (
  SELECT bundle, id, k, 0 AS o, '/n/' || (k + 1) || '.md#a' AS raw, 'n/' || (k + 1) || '.md' AS target FROM n WHERE NOT blank
  UNION ALL SELECT bundle, id, k, 1, k || '.md', 'n/' || k || '.md' FROM n WHERE NOT blank AND k % 10 = 0
  UNION ALL SELECT bundle, id, k, 2, 'missing.md', 'n/missing.md' FROM n WHERE NOT blank AND k % 9 = 0
  UNION ALL SELECT bundle, id, k, 3, 'https://x.org/a.md', NULL FROM n WHERE NOT blank AND k % 9 = 0
)
SELECT bundle, id AS concept_id, (row_number() OVER (PARTITION BY bundle, id ORDER BY o) - 1)::INTEGER AS at, raw, target FROM l
"""
t4_fenced_code_blocks = f"""
WITH {BUNDLE}
SELECT bundle, id AS concept_id, CASE WHEN k % 5 = 4 THEN '' ELSE 'json' END AS language, ['{{"a": 1}}', '{{"a": }}', '# not a heading [x](/nowhere.md)'][k % 5 - 1] AS code, 1 AS n_lines FROM n WHERE NOT blank AND k % 5 > 1
"""
WORKSHOP = """
w AS (
  SELECT c_custkey AS k, 'w' || (c_custkey // 100) AS bundle, 'w' || (c_custkey // 100) || '/c' || c_custkey || '.md' AS doc_id, c_custkey // 6 % 5 AS half, c_custkey // 4 % 4 AS other,
         c_custkey % 100 = 57 AS blank, c_custkey % 50 = 9 AS broken
  FROM customer
), logs AS (SELECT DISTINCT 'w' || (c_custkey // 100) AS bundle, c_custkey // 100 AS m FROM customer), a AS (SELECT * FROM w WHERE NOT blank AND NOT broken), filled AS (SELECT * FROM w WHERE NOT blank)"""
s4_workshops = f"""
WITH {WORKSHOP}
SELECT bundle, 'c' || k || '.md' AS path, CASE WHEN blank OR broken THEN 0 ELSE 1 + (k % 2 = 0)::INT + (k % 3 < 2)::INT + (k % 5 <> 0)::INT + (k % 7 = 0)::INT + (k % 4 = 0)::INT END::INTEGER AS n_keys, broken AND NOT blank AS broken FROM w
UNION ALL SELECT bundle, 'log.md', 1, false FROM logs WHERE m % 2 = 0
"""
k0_unreadable = f"WITH {WORKSHOP} SELECT doc_id, 'OKF001' AS code, 'error' AS severity FROM w WHERE broken AND NOT blank UNION ALL SELECT DISTINCT bundle, 'OKF900', 'error' FROM w WHERE blank"
k10_bundle_computations = f"""
WITH {WORKSHOP}
SELECT doc_id, code, 'warning' AS severity FROM (
  SELECT doc_id, 'OKF301' AS code FROM a WHERE k % 2 = 1 UNION ALL SELECT doc_id, 'OKF304' FROM a WHERE k % 3 = 2 UNION ALL SELECT doc_id, 'OKF305' FROM a WHERE k % 3 = 1 UNION ALL SELECT doc_id, 'OKF306' FROM a WHERE k % 5 = 0
  UNION ALL SELECT doc_id, 'OKF308' FROM a WHERE k % 6 <> 0 AND k % 7 <> 0 UNION ALL SELECT doc_id, 'OKF309' FROM a WHERE k % 42 = 0 UNION ALL SELECT doc_id, 'OKF303' FROM a WHERE k % 4 = 0 UNION ALL SELECT doc_id, 'OKF302' FROM a WHERE k % 4 = 0
)
"""
k13_reserved_filenames = f"WITH {WORKSHOP} SELECT bundle || '/log.md' AS doc_id, 'OKF404' AS code, 'error' AS severity FROM logs WHERE m % 2 = 0"
l4_untagged_computation = f"WITH {WORKSHOP} SELECT doc_id, 'OKFL07' AS code, 'warning' AS severity FROM filled WHERE k % 6 = 0 AND half = 0"
l8_computation_syntax = f"""
WITH {WORKSHOP}
SELECT doc_id, 'OKF310' AS code, 'warning' AS severity FROM filled WHERE k % 6 = 0 AND half IN (2, 4)
UNION ALL SELECT doc_id, 'OKF007', 'info' FROM filled WHERE k % 4 = 0 AND other = 1
"""
l9_languages = f"""
WITH {WORKSHOP}, l AS (
  SELECT doc_id, ['', 'json', 'json', 'python', 'bash'][half + 1] AS language FROM filled WHERE k % 6 = 0 UNION ALL SELECT doc_id, ['javascript', 'yaml', 'bash', 'mermaid'][other + 1] FROM filled WHERE k % 4 = 0
)
SELECT language, count(*) AS blocks, count(DISTINCT doc_id) AS concepts, language IN ('json', 'yaml', 'bash') AS checkable FROM l GROUP BY language
"""
k10_attested_computations = """
WITH c AS (SELECT 'b/c' || c_custkey || '.md' AS doc_id, c_custkey AS k FROM customer)
SELECT doc_id, 'OKF301' AS code FROM c WHERE k % 2 = 1 UNION ALL SELECT doc_id, 'OKF304' FROM c WHERE k % 3 = 2 UNION ALL SELECT doc_id, 'OKF305' FROM c WHERE k % 3 = 1 UNION ALL SELECT doc_id, 'OKF306' FROM c WHERE k % 5 = 0
UNION ALL SELECT doc_id, 'OKF308' FROM c WHERE k % 6 <> 0 AND k % 7 <> 0 UNION ALL SELECT doc_id, 'OKF309' FROM c WHERE k % 42 = 0 UNION ALL SELECT doc_id, 'OKF303' FROM c WHERE k % 4 = 0 UNION ALL SELECT doc_id, 'OKF302' FROM c WHERE k % 4 = 0
"""
