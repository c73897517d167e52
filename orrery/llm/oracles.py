"""DuckDB SQL for the opN_ queries that SQL can express."""

SQL = {
    "op9_minhash_near_dup": r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) >= 4 THEN list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')))
                      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS shingles
  FROM split),
posted AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM posted a JOIN posted b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT doc_id, len(shingles)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON doc_id = u
""",
    "op5_mixing": r"""
WITH words AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         len(regexp_extract_all(coalesce(text, ''), '[#$%&*|!]')) AS noise
  FROM documents),
keyed AS (
  SELECT *, -ln((('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496)
            / (CASE WHEN size = 0 THEN 1.0::DOUBLE ELSE size::DOUBLE / (size + 4 * noise)::DOUBLE END) AS key
  FROM words),
per AS (
  SELECT source, sum(size)::HUGEINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM keyed GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][nth % 3 + 1]::HUGEINT AS weight, 2 * source_size AS ceiling FROM per),
stacked AS (
  SELECT *, sum(ceiling) OVER up - ceiling AS below, sum(weight) OVER () - sum(weight) OVER up + weight AS open, sum(source_size) OVER () AS total
  FROM weighed WINDOW up AS (ORDER BY ceiling::DOUBLE / weight, nth ROWS UNBOUNDED PRECEDING)),
levels AS (
  SELECT 3 * total - 2 * below AS rest, open AS shared FROM stacked
  WHERE ceiling * open * 2 >= weight * (3 * total - 2 * below) ORDER BY ceiling::DOUBLE / weight, nth LIMIT 1),
targets AS (
  SELECT source, source_size::BIGINT AS source_size,
         CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE least((weight * rest)::DOUBLE / (shared * 2)::DOUBLE, ceiling::DOUBLE) END AS target
  FROM stacked, levels),
running AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
         CASE WHEN t.source_size = 0 THEN 0 ELSE floor(t.target / t.source_size)::BIGINT END AS epochs,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING)::BIGINT - k.size AS start
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, round(target - epochs * source_size)::BIGINT - start)))::BIGINT AS taken
FROM running
""",
    "op3_secret_scan": r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents),
kinds(ord, kind, pattern, least_len) AS (VALUES
  (0, 'assign', '(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 6),
  (1, 'access', '(AKIA[A-Z0-9]+)', 20), (2, 'hex', '([0-9a-f]{24,})', 24),
  (3, 'owned', '((?:gh[pousr]_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*|[A-Za-z0-9+/_-]{32,}))', 1)),
parts AS (
  SELECT rid, doc_id, owner, t, ord, kind, least_len,
         unnest(list_transform(string_split_regex(t, pattern), lambda x: length(x))) AS gap,
         unnest(regexp_extract_all(t, pattern, 0)) AS whole, unnest(regexp_extract_all(t, pattern, 1)) AS value,
         unnest(range(len(string_split_regex(t, pattern)))) AS i
  FROM docs, kinds WHERE regexp_matches(t, pattern)),
placed AS (
  SELECT *, sum(gap + coalesce(length(whole), 0)) OVER (PARTITION BY rid, ord ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM parts),
found AS (
  SELECT rid, doc_id, owner, t, ord, kind, value, stop - length(whole) AS start, stop
  FROM placed WHERE whole IS NOT NULL AND length(value) >= least_len),
spans AS (
  SELECT * FROM found WHERE ord < 3 UNION ALL
  SELECT * FROM found w WHERE ord = 3 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
    AND len(list_distinct(string_split(value, ''))) >= 8
    AND NOT EXISTS (SELECT 1 FROM found b WHERE b.rid = w.rid AND b.ord < 3 AND b.start < w.stop AND w.start < b.stop)),
held AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT (owner, t)) AS texts FROM spans GROUP BY value),
marked AS (SELECT s.*, owners <= 5 AND texts <= 20 AS is_live, owners || '/' || texts AS holders FROM spans s JOIN held h ON s.value = h.value),
per AS (
  SELECT rid, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
         coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (ord < 3), '') AS base,
         coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (ord < 3 OR is_live), '') AS spans,
         coalesce(string_agg(holders, ',' ORDER BY start, ord) FILTER (ord < 3 OR is_live), '') AS ownership, count(*) FILTER (is_live) AS n_live, count(*) FILTER (ord < 3 AND NOT is_live) AS n_example
  FROM marked GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(ownership, '') AS ownership
FROM docs LEFT JOIN per USING (rid)
""",
    "op10_url_filters": r"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(name, h, p, verdict) AS (VALUES
  ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
globs(name) AS (VALUES ('cheap-pills'), ('spam-farm'), ('casino'), ('free-money'), ('xxx')),
judged AS (
  SELECT page_id, host, path,
         (SELECT arg_max(r.name, length(r.name)) FROM rules r
          WHERE (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p)) AS by_host,
         (SELECT arg_max(g.name, struct_pack(l := length(g.name), n := g.name)) FROM globs g
          WHERE regexp_matches(host || path, '(^|[^A-Za-z0-9])' || g.name || '($|[^A-Za-z0-9])')) AS by_glob
  FROM parts)
SELECT page_id, host, path, by_host AS "rule",
       CASE WHEN by_host IS NULL AND by_glob IS NOT NULL THEN '^' || by_glob || '^' END AS "pattern",
       CASE WHEN by_host IN ('net/', 'example.com/de/') THEN 'block'
            WHEN by_host IS NOT NULL THEN 'allow'
            WHEN by_glob IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM judged
""",
    "op11_prefix_trie": r"""
WITH crc(code) AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END))),
ordered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS head, count(*) AS n,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
             lambda c, b: xor(c // 256, (any_value(code))[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 6 AS h
  FROM ordered, crc GROUP BY conv_id),
heads AS (SELECT c.conv_id, c.h, c.head, coalesce(b.n, 0) AS n_head FROM convs c LEFT JOIN convs b ON b.conv_id = c.head),
rebuilt AS (
  SELECT h.conv_id, o.i AS d, o.role, o.text FROM heads h JOIN ordered o ON o.conv_id = h.head AND o.i <= h.h
  UNION ALL
  SELECT h.conv_id, o.i - h.h + least(h.h, h.n_head) AS d, o.role, o.text FROM heads h JOIN ordered o ON o.conv_id = h.conv_id AND o.i > h.h),
paths AS (
  SELECT conv_id, d, length(text) AS size, count(*) OVER (PARTITION BY conv_id) AS turns,
         md5(string_agg(md5(length(role) || ':' || role || text), '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING)) AS node,
         coalesce(md5(string_agg(md5(length(role) || ':' || role || text), '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 'root') AS parent
  FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, 0, (SELECT count(*) FROM rebuilt r WHERE r.conv_id = convs.conv_id), 'root', NULL FROM convs),
nodes AS (
  SELECT node, any_value(parent) AS parent, min(conv_id) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, any_value(size) AS size,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (turns = d), '') AS ends
  FROM paths GROUP BY node),
families AS (SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.parent = n.node) AS n_children FROM nodes n LEFT JOIN nodes p ON p.node = n.parent),
sums AS (
  SELECT p.node, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.size)::BIGINT AS saved_tokens
  FROM families f JOIN paths p ON p.conv_id = f.conv_id AND p.d <= f.depth GROUP BY p.node)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(ends) AS ends_sha256 FROM families JOIN sums USING (node)
""",
}
