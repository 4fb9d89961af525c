"""DuckDB SQL for the queries that SQL can express."""

OP5 = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
bp AS (SELECT item, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM bl),
grams AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM bp),
lens AS (SELECT DISTINCT n FROM grams),
dp AS (SELECT r, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM d, lens WHERE len(w) >= n),
dg AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM dp),
hits AS (SELECT r, i, n, item FROM dg JOIN grams USING (n, gram)),
pos AS (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hits),
nh AS (SELECT r, count(*) AS n_hit FROM pos GROUP BY r),
it AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN nh USING (r) LEFT JOIN it USING (r)
"""

_HOST = r"translate(coalesce(regexp_extract({0}, '(?s)^.*?://([^/?#]*)([^?#]*)(.*)$', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"coalesce(regexp_extract({0}, '(?s)^.*?://([^/?#]*)([^?#]*)(.*)$', 2), '')"
_KEY = (
    "CASE WHEN instr({0}, '://') > 0 THEN " + _HOST + " || CASE WHEN " + _PATH + " = '' THEN '/' ELSE " + _PATH + " END"
    r" || coalesce(regexp_extract({0}, '(?s)^[^#?]*(\?[^#]*)?', 1), '') END"
)
_LINK = "replace(link, '&amp;', '&')"
_HERE = "'http://' || " + _HOST.format("url")
_OWN_PATH = "CASE WHEN " + _PATH.format("url") + " = '' THEN '/' ELSE " + _PATH.format("url") + " END"


def _resolved(path: str) -> str:
    """A path without dot segments, as the query has it."""
    only = f"regexp_extract({path}, '(?s)^([^?#]*)', 1)"
    steps = f"list_prepend('', string_split({only}, '/')[2:])"
    fold = f"list_reduce({steps}, lambda a, x: CASE WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN x = '.' THEN a ELSE a || '/' || x END)"
    return f"({fold} || CASE WHEN string_split({only}, '/')[-1] IN ('.', '..') THEN '/' ELSE '' END || regexp_extract({path}, '(?s)^[^?#]*(.*)$', 1))"


_ABSOLUTE = (
    f"CASE WHEN instr({_LINK}, '://') > 0 THEN {_LINK} WHEN {_LINK} LIKE '//%' THEN 'http:' || {_LINK} WHEN {_LINK} LIKE '/%' THEN {_HERE} || " + _resolved(_LINK)
    + f" WHEN {_LINK} LIKE '?%' THEN {_HERE} || {_OWN_PATH} || {_LINK} WHEN {_LINK} LIKE '#%' THEN url ELSE {_HERE} || "
    + _resolved(f"(regexp_replace({_OWN_PATH}, '[^/]*$', '') || {_LINK})") + " END"
)
OP6 = (
    r"""
WITH RECURSIVE rules(action, rule_host, rule_path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
p AS (SELECT page_id, url, """ + _HOST.format("url") + " AS host, " + _PATH.format("url") + " AS path, " + _KEY.format("url") + r""" AS key, coalesce(html, '') AS html FROM pages),
links AS (
  SELECT url, key, regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0), '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1) AS link FROM p
  UNION ALL SELECT url, key, regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0), '(?is)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1) FROM p),
absolute AS (SELECT key, """ + _ABSOLUTE + r""" AS dst FROM links WHERE link <> ''),
e AS (SELECT DISTINCT key AS a, """ + _KEY.format("dst") + r""" AS b FROM absolute WHERE key IS NOT NULL),
both_ways AS (SELECT a, b FROM e WHERE b IS NOT NULL AND a <> b UNION SELECT b, a FROM e WHERE b IS NOT NULL AND a <> b),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT a, a FROM both_ways UNION SELECT r.a, t.b FROM reach r JOIN both_ways t ON r.b = t.a),
comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a),
spots AS (SELECT node, component, regexp_extract(node, '(?s)^([^/]*)', 1) AS host, regexp_extract(node, '(?s)^[^/]*([^?]*)', 1) AS path FROM comp),
places AS (SELECT host, path FROM p WHERE host <> '' UNION SELECT host, path FROM spots),
ruled AS (SELECT host, path, rule_host || rule_path AS rule, action FROM places JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) = 1),
decided AS (SELECT component, coalesce(bool_or(action = 'block'), false) AS blocked, coalesce(bool_or(action = 'allow'), false) AS allowed FROM spots LEFT JOIN ruled USING (host, path) GROUP BY component),
inherited AS (SELECT node AS key, CASE WHEN blocked AND NOT allowed THEN 'block' END AS verdict FROM comp JOIN decided USING (component))
SELECT page_id, p.host, p.path, rule, coalesce(action, verdict, 'allow') AS verdict
FROM p LEFT JOIN ruled ON p.host = ruled.host AND p.path = ruled.path LEFT JOIN inherited ON p.key = inherited.key
"""
)

OP9 = r"""
WITH rows_ AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS hash FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows_ GROUP BY source),
w AS (SELECT source, source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS room FROM sizes),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(room) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
    FROM w WINDOW before AS (ORDER BY room / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, room / weight) AS filled FROM l WHERE level * weight <= room),
t AS (SELECT source, source_size, least(room, coalesce(filled * weight, room)) AS target FROM l, f),
c AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
h AS (SELECT source, hash, sum(size) AS s FROM rows_ GROUP BY source, hash),
u AS (SELECT source, hash, s, sum(s) OVER (PARTITION BY source ORDER BY hash) AS upto FROM h),
k AS (SELECT u.source, u.hash, upto <= target - copies * source_size OR (upto - s <= target - copies * source_size
      AND upto - (target - copies * source_size) < (target - copies * source_size) - (upto - s)) AS more
    FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target, size * (copies + CASE WHEN more THEN 1 ELSE 0 END) AS taken
FROM rows_ JOIN c ON rows_.source IS NOT DISTINCT FROM c.source JOIN k ON rows_.source IS NOT DISTINCT FROM k.source AND rows_.hash = k.hash
"""

OP3 = r"""
WITH c AS (SELECT conv_id, list(struct_pack(r := role, x := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS t,
    string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS text FROM conversations GROUP BY conv_id),
n AS (SELECT conv_id, t, len(t) AS n, text FROM c),
p AS (SELECT DISTINCT t[1:k] AS t FROM (SELECT t, unnest(range(1, CAST(n AS BIGINT))) AS k FROM n)),
g AS (SELECT t, n, min(conv_id) AS conv_id, count(*) AS n_copies, arg_min(text, conv_id) AS text FROM n GROUP BY t, n)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, n_copies, text FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.t = g.t)
"""



def _crc32(list_of_bytes: str) -> str:
    """CRC-32 of a list of byte values, bit by bit."""
    step = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = f"list_reduce(list_prepend(xor(a, x), range(0, 8)), lambda c, k: {step})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {list_of_bytes}), lambda a, x: {byte}), 4294967295)"


_BYTES = "list_transform(range(0, {n}), lambda i: CAST('0x' || substr({hex}, 2 * i + 1, 2) AS BIGINT))"
PAYLOADS = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n FROM d),
p AS (SELECT doc_id, n, greatest(64, (n + 63) // 64 * 64) AS size, rpad(h, CAST(2 * greatest(64, (n + 63) // 64 * 64) AS INT), '0') AS h FROM s)
SELECT doc_id, n AS n_bytes, size AS payload_bytes, sha256(unhex(h)) AS payload_sha256, {_crc32(_BYTES.format(n=64, hex="right(h, 128)"))} AS tail_crc32 FROM p
"""

#: Counts of one, two and three words in training documents, and weights from the shortest context upwards (mu = 30).
LM = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+') AS w,
    {_crc32(_BYTES.format(n="length(CAST(doc_id AS VARCHAR))", hex="hex(encode(CAST(doc_id AS VARCHAR)))"))} % 10 = 0 AS held FROM documents),
t AS (SELECT r, held, unnest(list_concat([chr(10) || 'start'], w, [chr(10) || 'end'])) AS w, unnest(range(0, len(w) + 2)) AS i FROM d),
g AS (SELECT r, held, i, w, lag(w) OVER o AS w1, lag(w, 2) OVER o AS w2 FROM t WINDOW o AS (PARTITION BY r ORDER BY i)),
c1 AS (SELECT w, count(*) AS n FROM g WHERE NOT held GROUP BY w),
c2 AS (SELECT w1, w, count(*) AS n FROM g WHERE NOT held AND w1 IS NOT NULL GROUP BY w1, w),
c3 AS (SELECT w2, w1, w, count(*) AS n FROM g WHERE NOT held AND w2 IS NOT NULL GROUP BY w2, w1, w),
k AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS nn, count(*) AS v FROM c1 WHERE w <> chr(10) || 'start'),
p1 AS (SELECT g.*, coalesce(c1.n, 0) AS n1, (coalesce(c1.n, 0) + 0.1::DOUBLE) / (nn + 0.1::DOUBLE * (v + 1)) AS p FROM g LEFT JOIN c1 USING (w), k WHERE i > 0),
p2 AS (SELECT p1.*, coalesce(c2.n, 0) AS n2, CASE WHEN h.n > 0 THEN (coalesce(c2.n, 0) + 30 * p) / (h.n + 30) ELSE p END AS q FROM p1 LEFT JOIN c1 h ON p1.w1 = h.w LEFT JOIN c2 ON p1.w1 = c2.w1 AND p1.w = c2.w),
p3 AS (SELECT p2.r, n1, p, CASE WHEN h.n > 0 THEN (coalesce(c3.n, 0) + 30 * q) / (h.n + 30) ELSE q END AS s FROM p2 LEFT JOIN c2 h ON p2.w2 = h.w1 AND p2.w1 = h.w LEFT JOIN c3 ON p2.w2 = c3.w2 AND p2.w1 = c3.w1 AND p2.w = c3.w)
SELECT doc_id, any_value(held) AS held_out, count(*) AS n_tokens, count(*) FILTER (WHERE n1 > 0) AS n_known, any_value(nn) AS train_tokens, round(sum(log10(p)), 3) AS base_score, round(sum(log10(s)), 3) AS score
FROM p3 JOIN d USING (r), k GROUP BY r, doc_id
"""

ORACLES = {"media_payloads": PAYLOADS, "lm_scores": LM, "op3_chat_format": OP3, "op5_decontamination": OP5, "op6_url_filter": OP6, "op9_mixing": OP9}
