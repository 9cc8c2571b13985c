"""DuckDB SQL for the queries that SQL can express, over the whole tables."""

WORDS = r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = f"""
WITH d AS (SELECT doc_id, coalesce({WORDS.format(t="text")}, []) AS w FROM documents),
i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {WORDS.format(t="text")} AS w FROM benchmark WHERE text IS NOT NULL),
i2 AS (SELECT item, w, least(10, len(w)) AS k FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, list_aggregate(w[p : p + k - 1], 'string_agg', ' ') AS s
        FROM (SELECT item, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p FROM i2)),
ks AS (SELECT DISTINCT k FROM win),
pos AS (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p FROM d, ks WHERE len(w) >= k),
grams AS (SELECT doc_id, k, p, list_aggregate(w[p : p + k - 1], 'string_agg', ' ') AS s FROM pos),
hit AS (SELECT doc_id, p, g.k AS k, item FROM grams g JOIN win ON g.k = win.k AND g.s = win.s),
hw AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(generate_series(p, p + k - 1)) AS q FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hw.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(hi.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(hi.names, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

OP3 = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS hex FROM p),
b AS (SELECT *, list_aggregate(list_transform(string_split_regex(hex, ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), 'string_agg', '') AS bits FROM d),
e AS (SELECT *, list_aggregate(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        list_sum(list_transform(generate_series(0, 4), lambda j: CASE WHEN substr(bits, CAST(i * 5 + j + 1 AS INT), 1) = '1' THEN 1 << CAST(4 - j AS INT) ELSE 0 END))::INT + 1, 1)), 'string_agg', '') AS digest FROM b),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM e)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""

OP10 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

#: CRC-32 by a table of 256 words, each made by eight steps; turns by conversation, then a recursion backward over turns and one forward over edits.
OP11 = r"""
WITH RECURSIVE
steps(b, c, i) AS (SELECT b, b, 0 FROM range(256) t(b) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM steps WHERE i < 8),
tab AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE i = 8),
own AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')) AS k FROM conversations),
drawn AS (SELECT conv_id, turn, role, text,
                 xor(list_reduce(list_transform(generate_series(1, octet_length(k)), lambda i: CAST(('0x' || substr(hex(k), CAST(2 * i - 1 AS INT), 2)) AS BIGINT)),
                                 lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1]), 4294967295), 4294967295) % 20 AS d FROM own, tab),
dam AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
               CASE WHEN d = 1 THEN '' WHEN d = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(generate_series(1, CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy
        FROM drawn WHERE d <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce('=' || conv_id, '') || '|' || length(role) || ':' || role || text), copy) AS i FROM dam),
flt AS (SELECT *, substr(role, 1, 1) AS ini, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
               row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM num),
r AS (SELECT conv_id, turn, i, role, text, ini, prev, count(*) OVER (PARTITION BY conv_id) AS n,
             CASE WHEN bare = '' THEN 'b' WHEN again THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f FROM flt),
-- Cost to go before turn i: z nothing yet, s, u, a after that role. Behind the last: 0, 6, 3, 0.
back(conv_id, i, z, s, u, a) AS (
  SELECT DISTINCT conv_id, n + 1, 0, 6, 3, 0 FROM r
  UNION ALL
  SELECT conv_id, i, least(z, 3 + u, 6 + a), least(s, 3 + u, 6 + a), least(u, 3 + a, 6 + u), least(a, 3 + u) FROM (
    SELECT b.conv_id, r.i,
           least(4 + b.z, CASE WHEN f IN ('b', 'd') THEN 9999999 ELSE t + least(3 + b.u, CASE ini WHEN 's' THEN b.s WHEN 'u' THEN b.u ELSE 9999999 END) END) AS z,
           least(4 + b.s, CASE WHEN f IN ('b', 'd') THEN 9999999 ELSE t + least(3 + b.u, CASE ini WHEN 'u' THEN b.u ELSE 9999999 END) END) AS s,
           least(4 + b.u, CASE WHEN f IN ('b', 'd') THEN 9999999 ELSE t + least(3 + b.a, CASE ini WHEN 'a' THEN b.a ELSE 9999999 END) END) AS u,
           least(4 + b.a, CASE WHEN f IN ('b', 'd') THEN 9999999 ELSE t + least(3 + b.u, CASE ini WHEN 'u' THEN b.u ELSE 9999999 END) END) AS a
    FROM back b JOIN (SELECT *, CASE WHEN f = 't' THEN 3 ELSE 0 END AS t FROM r) r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i - 1)),
togo AS (SELECT conv_id, i, unnest(['z', 's', 'u', 'a']) AS st, unnest([z, s, u, a]) AS c FROM back),
-- All edits from a state before a turn that are on a cheapest way, the least of them.
edges AS (
  SELECT g.conv_id, g.i, g.st, 'D' AS e, 1 AS step, g.st AS nst, NULL AS line FROM togo g JOIN togo h ON h.conv_id IS NOT DISTINCT FROM g.conv_id AND h.i = g.i + 1 AND h.st = g.st WHERE g.c = 4 + h.c
  UNION ALL
  SELECT g.conv_id, g.i, g.st, 'I', 0, h.st, CASE WHEN h.st = 'u' THEN 'user:' ELSE 'assistant:' END FROM togo g JOIN togo h ON h.conv_id IS NOT DISTINCT FROM g.conv_id AND h.i = g.i AND h.st = CASE WHEN g.st = 'u' THEN 'a' ELSE 'u' END WHERE g.c = 3 + h.c
  UNION ALL
  SELECT g.conv_id, g.i, g.st, k.e, 1, h.st, CASE WHEN k.e = 'K' THEN role WHEN h.st = 'u' THEN 'user' ELSE 'assistant' END || ':' || text
  FROM togo g JOIN r ON r.conv_id IS NOT DISTINCT FROM g.conv_id AND r.i = g.i AND r.f NOT IN ('b', 'd') CROSS JOIN (VALUES ('K'), ('R')) k(e)
  JOIN togo h ON h.conv_id IS NOT DISTINCT FROM g.conv_id AND h.i = g.i + 1
       AND ((g.st = 'u' AND h.st = 'a') OR (g.st <> 'u' AND h.st = 'u') OR (k.e = 'K' AND g.st = 'z' AND h.st = 's'))
  WHERE (k.e = 'R' OR r.ini = h.st) AND g.c = (CASE WHEN k.e = 'R' THEN 3 ELSE 0 END) + (CASE WHEN f = 't' THEN 3 ELSE 0 END) + h.c),
best AS (SELECT conv_id, i, st, min(e) AS e FROM edges GROUP BY ALL),
nxt AS (SELECT edges.* FROM edges JOIN best ON best.conv_id IS NOT DISTINCT FROM edges.conv_id AND best.i = edges.i AND best.st = edges.st AND best.e = edges.e),
fwd(conv_id, i, st, audit, lines) AS (
  SELECT DISTINCT conv_id, CAST(1 AS BIGINT), 'z', '', CAST([] AS VARCHAR[]) FROM r
  UNION ALL
  SELECT f.conv_id, f.i + x.step, x.nst, f.audit || x.e, CASE WHEN x.line IS NULL THEN f.lines ELSE list_append(f.lines, x.line) END
  FROM fwd f JOIN nxt x ON x.conv_id IS NOT DISTINCT FROM f.conv_id AND x.i = f.i AND x.st = f.st),
done AS (SELECT conv_id, audit, sha256(array_to_string(lines, chr(10))) AS sha FROM fwd f
         WHERE i = 1 + (SELECT max(n) FROM r WHERE r.conv_id IS NOT DISTINCT FROM f.conv_id) AND st IN ('z', 'a')),
cnt AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE f = 'b') AS blank, count(*) FILTER (WHERE f = 'd') AS duplicate,
               count(*) FILTER (WHERE f = 't') AS truncated, count(*) FILTER (WHERE i > 1 AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(c, 0) AS BIGINT) AS cost,
       coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN cnt ON cnt.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN togo ON togo.conv_id IS NOT DISTINCT FROM o.conv_id AND togo.i = 1 AND togo.st = 'z'
"""

OP12 = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS bare FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size, row_number() OVER w = 1 AS kept, sha256(bare) AS text_sha256
FROM d WINDOW w AS (PARTITION BY bare ORDER BY chars DESC, doc_id NULLS LAST)
"""

OP13 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w,
                  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT *, CAST(len(w) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(x, i, 8) AS BIGINT)) AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                  WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(w[1 : a], '') AS pre, array_to_string(w[a + 1 : b], '') AS mid, array_to_string(w[b + 1 : n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

ORACLES: dict[str, str] = {"op2_decontamination": OP2, "op3_line_dedup": OP3, "op7_warc": OP7, "op10_topk_search": OP10, "op11_conversation_repair": OP11, "op12_exact_dedup": OP12, "op13_fill_in_middle": OP13}
