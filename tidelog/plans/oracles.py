"""The registered queries as DuckDB SQL."""

LOG = "log AS (SELECT CAST(user_id AS VARCHAR) AS id, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS oid, event_id AS seq, CAST(event_id // 1000 AS VARCHAR) AS bid, event_id AS line_no, props AS record FROM events)"
CURRENT = f"{LOG}, cur AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)"
KEYS = "keys AS (SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer)"
STAMP = f"""{LOG},
p AS (SELECT *, lag(oid) OVER (PARTITION BY id ORDER BY seq) AS prev FROM log),
e AS (SELECT *, (oid = 1 AND coalesce(prev, 2) <> 1) AS fresh FROM p WHERE oid = 1 OR prev = 1),
n AS (SELECT *, sum(1) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s, sum(CAST(fresh AS INT)) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS f FROM e),
st AS (SELECT seq AS ord, id, oid AS op, bid, record, CAST(s AS BIGINT) AS seq, CAST(max(CASE WHEN fresh THEN f END) OVER (PARTITION BY id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS rid FROM n),
sc AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)"""
DEAD = """'{"id":"' || id || '","_oid":2,"_rid":' || rid || ',"_seq":' || seq || '}'"""
UNITS = r"(length({0}) + length(regexp_replace({0}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"
STALE = f"""{CURRENT}, sz AS (SELECT bid, CAST(sum(strlen(record) + 1) AS BIGINT) AS size FROM log GROUP BY bid),
lv AS (SELECT bid, CAST(sum({UNITS.format('record')}) AS BIGINT) AS chars FROM cur GROUP BY bid),
stale AS (SELECT bid, size, coalesce(chars, 0) AS live_chars, size - coalesce(chars, 0) AS stale_bytes FROM sz LEFT JOIN lv USING (bid))"""
STATS = "CAST(coalesce(max(seq), 0) AS BIGINT) AS max_seq, CAST(coalesce(min(seq), 9007199254740991) AS BIGINT) AS min_seq, CAST(coalesce(max(rid), 0) AS BIGINT) AS max_rid, CAST(coalesce(min(rid), 9007199254740991) AS BIGINT) AS min_rid"
INDEX = "ix AS (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) = 1)"


GOOD = """'{"id":"' || event_id || '","_oid":1,"_rid":' || event_id || ',"_seq":' || event_id || '}'"""
CHECKED = f"""odd AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN {GOOD} WHEN 1 THEN '{{"_oid":1,"_rid":1,"_seq":' || event_id || '}}' WHEN 2 THEN '{{"id":' || event_id || ',"_oid":1,"_rid":1,"_seq":1}}'
        WHEN 3 THEN '{{"id":"' || event_id || '","_rid":1,"_seq":1}}' WHEN 4 THEN '{{"id":"' || event_id || '","_oid":"1","_rid":1,"_seq":1}}' WHEN 5 THEN '{{"id":"' || event_id || '","_oid":1,"_rid":true,"_seq":1}}'
        WHEN 6 THEN '{{"id":"' || event_id ELSE {GOOD} || ' x' END AS line FROM events),
kinds AS (SELECT event_id, json_valid(line) AS whole, CASE WHEN json_valid(line) THEN [json_type(line, '$.id'), json_type(line, '$._oid'), json_type(line, '$._rid'), json_type(line, '$._seq')] END AS k FROM odd),
checked AS (SELECT event_id, CASE WHEN NOT whole THEN 'not one JSON value' WHEN k[1] IS NULL THEN 'id is missing' WHEN k[1] <> 'VARCHAR' THEN 'id must be a string'
        WHEN k[2] IS NULL THEN '_oid is missing' WHEN k[2] NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN '_oid must be a number' WHEN k[3] IS NULL THEN '_rid is missing' WHEN k[3] NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN '_rid must be a number'
        WHEN k[4] IS NULL THEN '_seq is missing' WHEN k[4] NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN '_seq must be a number' ELSE 'ok' END AS error FROM kinds)"""
PARSED = f"""{LOG}, lines AS (SELECT bid, line_no, '{{"id":"' || id || '","_oid":' || oid || ',"_rid":' || line_no || ',"_seq":' || line_no || ',"props":' || record || '}}' AS line FROM log),
parsed AS (SELECT bid, line_no, line, json_extract_string(line, '$.id') AS id, CAST(json_extract(line, '$._oid') AS INTEGER) AS oid, CAST(json_extract(line, '$._rid') AS BIGINT) AS rid, CAST(json_extract(line, '$._seq') AS BIGINT) AS seq FROM lines)"""
TEXT = """('{"k":' || json_extract_string(record, '$.k') || ',"id":"' || id || '","_seq":' || seq || ',"_rid":' || rid || ',"_oid":1}')"""
CELLS = "SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS cells FROM lineitem GROUP BY l_orderkey"


def orders(flag: str) -> str:
    return f"SELECT DISTINCT l_orderkey AS bit FROM lineitem WHERE l_returnflag = '{flag}'"


def users(kind: str) -> str:
    return f"SELECT DISTINCT user_id AS bit FROM events WHERE event_type = '{kind}' AND user_id IS NOT NULL"


ORACLES = {
    "kv_live": f"WITH {CURRENT} SELECT id, seq, record FROM cur WHERE oid <> 2",
    "kv_get": f"WITH {CURRENT} SELECT id, seq, record FROM cur WHERE oid <> 2 AND id = '7'",
    "kv_multi_get": f"WITH {CURRENT}, {KEYS} SELECT id, seq, record FROM cur WHERE oid <> 2 AND id IN (SELECT id FROM keys)",
    "kv_has": f"WITH {CURRENT}, {KEYS} SELECT k.id, CASE WHEN c.id IS NULL THEN 0 ELSE 1 END AS present FROM keys k LEFT JOIN (SELECT id FROM cur WHERE oid <> 2) c ON k.id = c.id",
    "kv_missing": f"WITH {CURRENT}, {KEYS} SELECT id FROM keys WHERE id NOT IN (SELECT id FROM cur WHERE oid <> 2)",
    "kv_get_by_rid": f"WITH {STAMP} SELECT id, rid, seq, record FROM sc WHERE op <> 2 AND rid = (SELECT max(rid) FROM sc WHERE op <> 2)",
    "rid_conflicts": "SELECT l_suppkey AS rid, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_partkey) > 1",
    "live_filter": f"WITH {CURRENT} SELECT id, oid, seq FROM cur WHERE oid <> 2",
    "tombstones": f"WITH {CURRENT} SELECT id, oid, seq FROM cur WHERE oid = 2",
    "oplog_assign": f"WITH {STAMP} SELECT ord, id, op, seq, rid FROM st",
    "oplog_delete": f"WITH {STAMP} SELECT ord, id, seq, rid, {DEAD} AS record FROM st WHERE op = 2",
    "parse_block": f"WITH {PARSED} SELECT bid, line_no, id, oid, rid, seq, line AS record FROM parsed",
    "load_block": f"WITH {PARSED} SELECT bid, id, line_no, oid, seq, line AS record FROM parsed QUALIFY row_number() OVER (PARTITION BY bid, id ORDER BY line_no DESC) = 1",
    "error_rows": f"WITH {CHECKED} SELECT event_id AS line_no, 'Invalid JSON entry in b at lineNo:' || event_id || ': ' || error AS error FROM checked WHERE error <> 'ok'",
    "merge_latest": f"""WITH {LOG}, d AS (SELECT id, oid, line_no, CAST(line_no % 8 AS VARCHAR) AS bid, line_no * 7919 % 997 AS seq FROM log),
        b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY bid, id ORDER BY line_no DESC) = 1)
        SELECT id, bid, seq, line_no, oid FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC, bid DESC) = 1""",
    "seq_stats": f"WITH {STAMP} SELECT {STATS} FROM sc",
    "seq_stats_by_block": f"WITH {STAMP} SELECT bid, {STATS} FROM st GROUP BY bid",
    "stale_bytes": f"WITH {STALE} SELECT bid, size, live_chars, stale_bytes FROM stale",
    "stale_delta": f"""WITH {STAMP}, l AS (SELECT *, {UNITS.format('body')} AS len FROM (SELECT *, CASE WHEN op = 2 THEN {DEAD} ELSE record END AS body FROM st)),
        g AS (SELECT bid, len, lag(op) OVER w AS pop, lag(bid) OVER w AS pbid, lag(len) OVER w AS plen FROM l WINDOW w AS (PARTITION BY id ORDER BY ord)),
        u AS (SELECT bid, len AS size, 0 AS stale FROM g UNION ALL SELECT pbid, 0, plen FROM g WHERE pop = 1)
        SELECT bid, CAST(sum(size) AS BIGINT) AS size_added, CAST(sum(stale) AS BIGINT) AS stale_added FROM u GROUP BY bid""",
    "compaction_candidates": f"WITH {STALE} SELECT bid, size, stale_bytes FROM stale WHERE size > 0 AND stale_bytes / size >= 0.4",
    "compact_block": f"""WITH {LOG}, d AS (SELECT id, oid, seq, line_no, record, CAST(line_no % 8 AS VARCHAR) AS bid FROM log), c AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)
        SELECT bid, id, row_number() OVER (ORDER BY seq) AS line_no, oid, record FROM c WHERE bid = '4' AND (oid <> 2 OR id IN (SELECT id FROM d WHERE bid <> '4'))""",
    "block_pack_whole": """WITH RECURSIVE r AS (SELECT conv_id * 1000 + turn AS ord, CAST(strlen(text) AS BIGINT) AS size, row_number() OVER (ORDER BY conv_id, turn) AS k FROM conversations),
        w AS (SELECT ord, size, k, CAST(0 AS BIGINT) AS block, coalesce(size, 0) AS held FROM r WHERE k = 1
        UNION ALL SELECT r.ord, r.size, r.k, CASE WHEN w.held >= 2000 THEN w.block + 1 ELSE w.block END, CASE WHEN w.held >= 2000 THEN coalesce(r.size, 0) ELSE w.held + coalesce(r.size, 0) END FROM w JOIN r ON r.k = w.k + 1)
        SELECT ord, size, block FROM w""",
    "store_open": f"WITH {STAMP} SELECT id, seq, rid, json_extract_string(record, '$.k') AS k FROM sc WHERE op <> 2",
    "store_compact": f"WITH {STAMP} SELECT id, seq, rid FROM sc WHERE op <> 2",
    "oplog_existing": f"WITH {STAMP} SELECT ord, id, op, seq, rid FROM st",
    "store_records": f"WITH {STAMP} SELECT id, {TEXT} AS record FROM sc WHERE op <> 2",
    "store_sizes": f"WITH {STAMP}, a AS (SELECT sum(strlen(CASE WHEN op = 2 THEN {DEAD} ELSE {TEXT} END) + 1) AS size FROM st), l AS (SELECT sum(strlen(CASE WHEN op = 2 THEN {DEAD} ELSE {TEXT} END) + 1) AS live FROM sc) SELECT CAST(size AS BIGINT) AS size, CAST(live AS BIGINT) AS live_chars, CAST(size - live AS BIGINT) AS stale_bytes FROM a, l",
    "free_block": "WITH b AS (SELECT s_suppkey - 1 AS i, s_name, s_suppkey * 37 % 100 AS size, s_suppkey % 3 = 0 AS locked FROM supplier) SELECT min(i) AS \"index\", arg_min(s_name, i) AS bid FROM b WHERE i >= 3 AND NOT locked AND size < 40",
    "store_lookups": f"WITH {STAMP}, {KEYS}, l AS (SELECT id, seq FROM sc WHERE op <> 2) SELECT k.id, CASE WHEN l.id IS NULL THEN 0 ELSE 1 END AS present, l.seq FROM keys k LEFT JOIN l ON k.id = l.id",
    "block_pack": """WITH RECURSIVE r AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
        w AS (SELECT source, doc_id, n_chars, k, CAST(0 AS BIGINT) AS block, n_chars AS held FROM r WHERE k = 1
        UNION ALL SELECT r.source, r.doc_id, r.n_chars, r.k, CASE WHEN w.held >= 50000 THEN w.block + 1 ELSE w.block END, CASE WHEN w.held >= 50000 THEN r.n_chars ELSE w.held + r.n_chars END FROM w JOIN r ON r.source = w.source AND r.k = w.k + 1)
        SELECT source, doc_id, n_chars, block FROM w""",
    "utf16_units": f"SELECT doc_id, {UNITS.format('text')} AS utf16_units, strlen(text) AS utf8_bytes FROM documents",
    "project_field": "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(CASE WHEN json_extract(props, '$.k') IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_fields FROM events",
    "validate_records": f"WITH {CHECKED} SELECT event_id, error FROM checked",
    "block_scan": """SELECT bid, CAST(n AS BIGINT) AS line_no, parts[n] AS line FROM (SELECT bid, parts, unnest(range(1, len(parts))) AS n FROM (SELECT CAST(page_id AS VARCHAR) AS bid, string_split(regexp_replace(html, '\n+', chr(10), 'g'), chr(10)) AS parts FROM pages))""",
    "custom_break": "SELECT doc_id, CAST(generate_subscripts(parts, 1) AS BIGINT) AS line_no, unnest(parts) AS line FROM (SELECT doc_id, string_split(text, '. ') AS parts FROM documents)",
    "line_scan": "SELECT doc_id, CAST(generate_subscripts(parts, 1) AS BIGINT) AS line_no, unnest(parts) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)",
    "bitset_union": f"{users('click')} UNION {users('view')}",
    "bitset_intersection": f"{users('click')} INTERSECT {users('view')}",
    "bitset_difference": f"{orders('R')} EXCEPT {orders('A')}",
    "bitset_clear": f"{orders('N')} EXCEPT {orders('R')}",
    "bitset_set": f"{orders('A')} UNION {orders('R')}",
    "bitset_resize": f"SELECT CAST(count(*) * 8192 AS BIGINT) AS capacity FROM (SELECT DISTINCT bit // 8192 AS page FROM ({orders('A')}) UNION SELECT unnest(range(12208)))",
    "bitset_packed_union": f"SELECT count(*) AS n FROM ({orders('A')} UNION {orders('R')})",
    "bitset_packed_intersection": f"SELECT count(*) AS n FROM ({orders('A')} INTERSECT {orders('R')})",
    "bitset_probe": f"SELECT c_custkey AS bit, CASE WHEN u.bit IS NULL THEN 0 ELSE 1 END AS is_set FROM customer LEFT JOIN ({users('purchase')}) u ON c_custkey = u.bit",
    "bitset_iterate": "SELECT bit, row_number() OVER (ORDER BY bit) - 1 AS position FROM (SELECT DISTINCT o_custkey AS bit FROM orders)",
    "bitset_capacity": "SELECT CAST(count(DISTINCT o_orderkey // 8192) * 8192 AS BIGINT) AS capacity FROM orders",
    "index_upsert": f"WITH {INDEX} SELECT * FROM ix",
    "index_seek": "SELECT conv_id, turn, role FROM conversations WHERE conv_id = 5 AND turn = 1",
    "index_delete": f"WITH {INDEX} SELECT * FROM ix WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_returnflag = 'R' AND l.l_orderkey = ix.l_orderkey AND l.l_linenumber = ix.l_linenumber)",
    "index_scan": "SELECT conv_id, turn, role FROM conversations ORDER BY conv_id, turn",
    "lower_bound": """WITH k AS (SELECT o_custkey AS x, row_number() OVER (ORDER BY o_custkey) AS r FROM (SELECT DISTINCT o_custkey FROM orders)), p AS (SELECT DISTINCT c_custkey FROM customer)
        SELECT c_custkey, CAST(2 * (SELECT count(*) FROM k WHERE x < c_custkey) AS BIGINT) AS "offset", EXISTS (SELECT 1 FROM k WHERE x = c_custkey) AS found FROM p""",
    "compound_lower_bound": """WITH k AS (SELECT DISTINCT l_orderkey AS a, CAST(l_linenumber AS BIGINT) AS b FROM lineitem), p AS (SELECT DISTINCT a, b + 1 AS b FROM k),
        u AS (SELECT a, b, 1 AS w FROM k UNION ALL SELECT a, b, 0 FROM p), g AS (SELECT a, b, sum(w) AS here, min(w) AS probe FROM u GROUP BY a, b),
        c AS (SELECT *, sum(here) OVER (ORDER BY a, b ROWS UNBOUNDED PRECEDING) - here AS below FROM g)
        SELECT a AS l_orderkey, b AS line, CAST(3 * below AS BIGINT) AS "offset", here > 0 AS found FROM c WHERE probe = 0""",
    "cell_get_set": f"SELECT l_orderkey, cells[2] AS second, CAST(NULL AS BIGINT) AS before, CAST(list_sum(cells) - cells[-1] + 4294967295 AS BIGINT) AS total FROM ({CELLS})",
    "cell_push_pop": f'SELECT l_orderkey, CAST(1 AS BIGINT) AS last, len(cells) + 1 AS length, len(cells) AS "left", CAST(NULL AS BIGINT) AS "none" FROM ({CELLS})',
    "cell_growth": "SELECT doc_id, CAST(CASE WHEN n_chars + 128 >= greatest(n_chars, 1024) THEN ceil(greatest(n_chars, 1024) * 2 / 4096.0) * 4096 ELSE greatest(n_chars, 1024) END AS BIGINT) AS capacity FROM documents",
    "cell_rows": f'SELECT l_orderkey, r AS "row", cells[2 * r + 1] AS key, cells[2 * r + 2] AS value FROM (SELECT l_orderkey, cells, unnest(range((len(cells) + 1) // 2)) AS r FROM ({CELLS}))',
    "cell_index_of": "SELECT l_orderkey, CAST(coalesce(list_position(list(l_linenumber ORDER BY l_linenumber), 3), 0) - 1 AS BIGINT) AS place FROM lineitem GROUP BY l_orderkey",
    "split_fields": "SELECT event_id, props AS fifth, '' AS ninth FROM events",
    "compound_compare": "SELECT l_orderkey, l_linenumber, CASE WHEN row(l_orderkey, CAST(l_linenumber AS BIGINT)) < row(CAST(700 AS BIGINT), CAST(3 AS BIGINT)) THEN -1 WHEN row(l_orderkey, CAST(l_linenumber AS BIGINT)) > row(CAST(700 AS BIGINT), CAST(3 AS BIGINT)) THEN 1 ELSE 0 END AS side FROM lineitem",
    "base36_id": "SELECT o_orderkey, lower(to_base(o_orderkey, 36)) AS base36 FROM orders",
    "stream_latest": f"WITH {CURRENT} SELECT id, seq, record FROM cur WHERE oid <> 2",
}
