"""DuckDB SQL for the catalogue's queries, each over whole tables."""

from __future__ import annotations

from parley.functions.text import STOP_BASE, STOP_CLUSTER, STOP_KEYWORDS
from parley.functions.tokenise import RULES, SPACE
from parley.operators.chunker import CONNECTORS


def _listed(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


S1, S2, S3 = map(_listed, (STOP_BASE, STOP_CLUSTER, STOP_KEYWORDS))

#: Utterances: a conversation's lines in order.
U = r"""
raw AS (SELECT conv_id, turn, role, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_at FROM conversations),
u AS (SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, line_at, line) - 1 AS BIGINT) AS pos, role AS speaker,
             regexp_replace(line, '^\s+|\s+$', '', 'g') AS text, 'conv_' || conv_id AS file,
             regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(line, '^\s+|\s+$', '', 'g')), '[^a-z\s'']', '', 'g'), '''+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS tokenized
      FROM raw)"""


def q(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{U}{', ' + ctes if ctes else ''}\n{select}"


TOK = "t AS (SELECT doc_id, pos, unnest(regexp_extract_all(tokenized, '[a-z]+')) AS term FROM u)"
UTT = f"""
c AS (SELECT doc_id, pos, term, count(*) AS tf FROM (SELECT doc_id, pos, unnest(regexp_extract_all(tokenized, '[a-z]+')) AS term FROM u)
      WHERE NOT list_contains({S1}, term) GROUP BY ALL),
i AS (SELECT term, ln((1 + (SELECT count(*) FROM u)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY term),
r AS (SELECT doc_id, pos, term, tf * idf AS x FROM c JOIN i USING (term)),
v AS (SELECT doc_id, pos, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id, pos)) AS w FROM r)"""
KEY = f"""
d AS (SELECT doc_id, string_agg(tokenized, ' ' ORDER BY pos) AS text FROM u GROUP BY doc_id),
c AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[a-z]{{2,}}')) AS term FROM d)
      WHERE NOT list_contains({S3}, term) GROUP BY ALL),
i AS (SELECT term, ln((SELECT count(*) FROM d) / count(*)) + 1 AS idf FROM c GROUP BY term
      HAVING count(*) >= 0.1 * (SELECT count(*) FROM d) AND count(*) <= 0.8 * (SELECT count(*) FROM d)),
r AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS x FROM c JOIN i USING (term)),
v AS (SELECT doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS w FROM r),
k AS (SELECT term, coalesce(sum(w) FILTER (WHERE doc_id = (SELECT min(doc_id) FROM u)), 0) AS score FROM v GROUP BY term),
top AS (SELECT * FROM k ORDER BY round(score, 9) DESC, term LIMIT 50)"""
#: Words and pairs of neighbouring words of a list.
PAIRS = "list_concat({x}, list_transform(generate_series(1, len({x}) - 1), lambda j: {x}[j] || ' ' || {x}[j + 1]))"
CLU = f"""
d AS (SELECT doc_id, list_filter(regexp_extract_all(string_agg(tokenized, ' . ' ORDER BY pos), '[a-z]{{2,}}'), lambda w: NOT list_contains({S2}, w)) AS x FROM u GROUP BY doc_id),
c AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({PAIRS.format(x="x")}) AS term FROM d) GROUP BY ALL),
i AS (SELECT term, ln((1 + (SELECT count(*) FROM d)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY term
      HAVING count(*) >= 0.02 * (SELECT count(*) FROM d) AND count(*) <= 0.5 * (SELECT count(*) FROM d) ORDER BY sum(tf) DESC, term LIMIT 200000),
r AS (SELECT doc_id, term, tf * idf AS x FROM c JOIN i USING (term)),
v AS (SELECT doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS w FROM r)"""
LEX = """
c AS (SELECT doc_id, pos, term, count(*) AS tf FROM (SELECT doc_id, pos, unnest(regexp_extract_all(tokenized, '[a-z]+')) AS term FROM u) GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id),
i AS (SELECT doc_id, term, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM c JOIN n USING (doc_id) GROUP BY doc_id, term),
r AS (SELECT doc_id, pos, term, tf * idf AS x FROM c JOIN i USING (doc_id, term)),
v AS (SELECT doc_id, pos, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id, pos)) AS w FROM r)"""
OVER = f"""{LEX},
o AS (SELECT a.doc_id, a.pos AS i, b.pos AS j, count(*) AS n FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.term = b.term AND a.pos < b.pos GROUP BY ALL),
node AS (SELECT doc_id, pos, text, min(pos) OVER (PARTITION BY doc_id, text) AS node FROM u),
e AS (SELECT DISTINCT o.doc_id, least(x.node, y.node) AS a, greatest(x.node, y.node) AS b
      FROM o JOIN node x ON o.doc_id = x.doc_id AND o.i = x.pos JOIN node y ON o.doc_id = y.doc_id AND o.j = y.pos)"""
OCC = f"""{KEY},
o AS (SELECT doc_id, pos, term, count(*) AS n FROM (SELECT doc_id, pos, unnest({PAIRS.format(x="regexp_extract_all(tokenized, '[a-z]{2,}')")}) AS term FROM u)
      WHERE term IN (SELECT term FROM top) GROUP BY ALL),
co AS (SELECT a.term AS k1, b.term AS k2, CAST(sum(a.n * b.n) AS BIGINT) AS c FROM o a JOIN o b ON a.doc_id = b.doc_id AND a.term < b.term AND abs(a.pos - b.pos) < 10 GROUP BY ALL)"""
TILE = f"""
d AS (SELECT doc_id, regexp_extract_all(string_agg(text, chr(10) || chr(10) || chr(9) || ' ' ORDER BY pos), '[\\p{{L}}\\p{{N}}_]+') AS x FROM u GROUP BY doc_id),
g AS (SELECT doc_id, CAST(ceil(len(x) / 20) - 1 AS BIGINT) AS gaps FROM d),
w AS (SELECT doc_id, unnest(x) AS word, (generate_subscripts(x, 1) - 1) // 20 AS seq FROM d),
n AS (SELECT doc_id, seq, word, count(*) AS n FROM w WHERE NOT list_contains({S1}, word) GROUP BY ALL),
every AS (SELECT doc_id, gaps, unnest(generate_series(0, gaps - 1)) AS gap FROM g WHERE gaps > 0),
ws AS (SELECT *, CASE WHEN gap < 9 THEN gap + 1 WHEN gap > gaps - 10 THEN gaps - gap ELSE 10 END AS ws FROM every),
b AS (SELECT ws.doc_id, gap, word, sum(CASE WHEN seq <= gap THEN n ELSE 0 END) AS f1, sum(CASE WHEN seq > gap THEN n ELSE 0 END) AS f2
      FROM ws JOIN n ON ws.doc_id = n.doc_id AND n.seq BETWEEN gap - ws + 1 AND gap + ws GROUP BY ALL),
s0 AS (SELECT doc_id, gap, sum(f1 * f2) / nullif(sqrt(CAST(sum(f1 * f1) AS DOUBLE) * sum(f2 * f2)), 0) AS s FROM b GROUP BY ALL),
gs AS (SELECT ws.doc_id, ws.gap, gaps, coalesce(s, 0) AS score FROM ws LEFT JOIN s0 USING (doc_id, gap)),
sm0 AS (SELECT *, lag(score) OVER p AS a, lead(score) OVER p AS z, lead(score, 2) OVER p AS zz FROM gs WHERE gaps >= 3 WINDOW p AS (PARTITION BY doc_id ORDER BY gap)),
sm AS (SELECT doc_id, CASE WHEN gaps = 3 AND gap = 2 THEN 1 ELSE gap END AS gap, CASE WHEN gaps = 3 THEN 2 ELSE gaps END AS gaps,
              CASE WHEN gap = 0 AND gaps = 3 THEN (score + z + zz) / 3 WHEN gap = 0 THEN (3 * score + z - zz) / 3 WHEN gap = gaps - 1 THEN (a + 2 * score) / 3 ELSE (a + score + z) / 3 END AS score
       FROM sm0 WHERE NOT (gaps = 3 AND gap = 1)),
run AS (SELECT *, CASE WHEN lag(score) OVER p IS NULL OR score > lag(score) OVER p THEN score END AS st, CASE WHEN lead(score) OVER p IS NULL OR score > lead(score) OVER p THEN score END AS en
        FROM sm WINDOW p AS (PARTITION BY doc_id ORDER BY gap)),
pk AS (SELECT *, last_value(st IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY gap ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l,
              first_value(en IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY gap ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r,
              CAST(floor(least(greatest(gaps / 10, 2.0), 5.0)) AS BIGINT) AS clip FROM run),
dp AS (SELECT doc_id, gap, CASE WHEN gap >= clip AND gap < gaps - clip THEN l + r - 2 * score ELSE 0 END AS depth FROM pk),
ca AS (SELECT * FROM (SELECT *, avg(depth) OVER (PARTITION BY doc_id) - stddev_pop(depth) OVER (PARTITION BY doc_id) / 2 AS cutoff FROM dp) WHERE depth > cutoff)"""

#: Units of text, what is learned from them about full stops, and sentences. The table of texts is named in the braces, its keys with it.
UNITS = rf"[^{SPACE}]+[{SPACE}]*"
STOPS = rf"[.?!…][\"'”’»)\]}}]*[{SPACE}]*\z"


def _kind(unit: str) -> str:
    core = _core(unit)
    return f"CASE WHEN regexp_matches(regexp_replace({core}, '\\.+\\z', ''), '\\A[0-9.,:-]+\\z') AND regexp_matches({core}, '[0-9]') THEN '##' ELSE regexp_replace({core}, '\\.+\\z', '') END"


def _core(unit: str) -> str:
    return f"lower(regexp_replace(regexp_replace({unit}, '\\A[^\\p{{L}}\\p{{N}}]+', ''), '[^\\p{{L}}\\p{{N}}.]+\\z', ''))"


def _chance(k: str, n: str, p: str) -> str:
    return f"(CASE WHEN {k} > 0 THEN {k} * ln({p}) ELSE 0 END + CASE WHEN {n} - {k} > 0 THEN ({n} - {k}) * ln(1 - ({p})) ELSE 0 END)"


def _associated(k: str, a: str, b: str, n: str) -> str:
    ratio = f"2 * ({_chance(k, a, f'{k} / {a}')} + {_chance(f'({b} - {k})', f'({n} - {a})', f'({b} - {k}) / ({n} - {a})')} - {_chance(k, a, f'{b} / {n}')} - {_chance(f'({b} - {k})', f'({n} - {a})', f'{b} / {n}')})"
    return f"CASE WHEN {n} > {a} AND {k} * {n} > {a} * {b} THEN {ratio} ELSE 0 END"


def _units(name: str, table: str, keys: str) -> str:
    q1 = STOPS.replace("'", "''")
    return f"""
{name}0 AS (SELECT {keys}, regexp_extract_all(text, '{UNITS}') AS uu, length(regexp_extract(text, '\\A[{SPACE}]*')) AS ld FROM {table}),
{name}1 AS (SELECT {keys}, ld, unnest(uu) AS unit, generate_subscripts(uu, 1) - 1 AS i FROM {name}0),
{name}2 AS (SELECT *, lag(unit) OVER o AS prev, lead(unit) OVER o AS nxt FROM {name}1 WINDOW o AS (PARTITION BY {keys} ORDER BY i)),
{name} AS (SELECT *, {_kind("unit")} AS kind, {_kind("nxt")} AS nkind, regexp_matches({_core("unit")}, '[^.]\\.\\z') AS dotted, regexp_matches(unit, '{q1}') AS ends,
        regexp_extract(unit, '\\A[^\\p{{L}}\\p{{N}}]*(\\p{{L}})', 1) AS fst, regexp_extract(nxt, '\\A[^\\p{{L}}\\p{{N}}]*(\\p{{L}})', 1) AS nfst,
        prev IS NOT NULL AND NOT regexp_matches(prev, '{q1}') AS inside FROM {name}2)"""


LEARN = f"""{_units("un", "u", "doc_id, pos")},
tc AS (SELECT kind AS type, count(*) FILTER (WHERE dotted) AS n_dotted, count(*) FILTER (WHERE NOT dotted) AS n_plain, count(*) FILTER (WHERE regexp_matches(fst, '\\p{{Ll}}')) AS n_small,
              count(*) FILTER (WHERE regexp_matches(fst, '\\p{{Lu}}') AND inside) AS n_capital FROM un WHERE kind <> '' GROUP BY kind),
al AS (SELECT CAST(sum(n_dotted + n_plain) AS DOUBLE) AS n, CAST(sum(n_dotted) AS DOUBLE) AS stops FROM tc),
ab0 AS (SELECT type, n_dotted, n_plain, 2 * ({_chance("n_dotted", "(n_dotted + n_plain)", "0.99")} - {_chance("n_dotted", "(n_dotted + n_plain)", "stops / n")}) AS ratio,
               length(type) - length(replace(type, '.', '')) AS inn, length(replace(type, '.', '')) AS letters FROM tc, al WHERE n_dotted > 0 AND type <> '##'),
ab AS (SELECT type, n_dotted, n_plain, ratio * exp(-letters) * (inn + 1) * pow(CAST(letters AS DOUBLE), -n_plain) AS score FROM ab0),
sh AS (SELECT type FROM ab WHERE score >= 0.3),
pr AS (SELECT kind AS a, dotted, nkind AS b, count(*) AS n FROM un WHERE ends AND nxt IS NOT NULL AND nkind <> '' GROUP BY ALL),
pd AS (SELECT *, dotted AND (a IN (SELECT type FROM sh) OR regexp_matches(a, '\\A\\p{{L}}\\z') OR a = '##') AS doubt FROM pr),
sz AS (SELECT type, CAST(n_dotted + n_plain AS DOUBLE) AS size FROM tc),
cl AS (SELECT a AS first, b AS second, pd.n AS n, {_associated("CAST(pd.n AS DOUBLE)", "x.size", "y.size", "al.n")} AS ratio FROM pd JOIN sz x ON a = x.type JOIN sz y ON b = y.type, al WHERE doubt AND pd.n > 1),
co AS (SELECT * FROM cl WHERE ratio >= 7.88),
bg AS (SELECT b AS type, CAST(sum(n) AS BIGINT) AS n FROM pd WHERE NOT doubt GROUP BY b),
sa0 AS (SELECT bg.type, bg.n, {_associated("CAST(bg.n AS DOUBLE)", "(SELECT CAST(sum(n) AS DOUBLE) FROM bg)", "size", "al.n")} AS ratio FROM bg JOIN sz USING (type), al),
sa AS (SELECT * FROM sa0 WHERE ratio >= 30)"""


def _split(units: str, keys: str) -> str:
    return f"""
{units}d AS (SELECT un.*, dotted AND kind IN (SELECT type FROM sh) AS short, dotted AND (regexp_matches(kind, '\\A\\p{{L}}\\z') OR kind = '##') AS lone,
              regexp_matches({_core("unit")}, '\\.\\.\\z') OR regexp_matches(unit, '(\\.\\.|…)["''”’»)\\]}}]*[{SPACE}]*\\z') AS dots,
              coalesce(regexp_matches(nfst, '\\p{{Ll}}'), false) AS small, coalesce(regexp_matches(nfst, '\\p{{Lu}}'), false) AS large, coalesce(s.n_small, 0) AS nsm, coalesce(s.n_capital, 0) AS ncp,
              cc.first IS NOT NULL AS close, sa.type IS NOT NULL AS starter, regexp_matches(unit, '[.…]["''”’»)\\]}}]*[{SPACE}]*\\z') AS stop
       FROM {units} un LEFT JOIN tc s ON s.type = nkind LEFT JOIN (SELECT first, second FROM co) cc ON cc.first = kind AND cc.second = nkind LEFT JOIN sa ON sa.type = nkind),
{units}e AS (SELECT *, CASE WHEN nxt IS NULL THEN true WHEN NOT ends THEN false WHEN NOT stop OR NOT (short OR dots OR lone) THEN true WHEN close THEN false
              WHEN large AND nsm > 0 AND ncp = 0 THEN true WHEN small THEN false
              WHEN lone AND NOT short THEN NOT (kind = '##' OR (large AND nsm = 0) OR NOT large) OR starter WHEN short THEN large AND starter ELSE large END AS fin FROM {units}d),
{units}f AS (SELECT *, coalesce(sum(CAST(fin AS INT)) OVER (PARTITION BY {keys} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent,
              ld + coalesce(sum(length(unit)) OVER (PARTITION BY {keys} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot FROM {units}e),
{units}s AS (SELECT {keys}, CAST(sent AS BIGINT) AS sent, CAST(min(spot) AS BIGINT) AS begin, regexp_replace(string_agg(unit, '' ORDER BY i), '[{SPACE}]+\\z', '') AS text FROM {units}f GROUP BY ALL)"""


SENT = f"{LEARN}, {_split('un', 'doc_id, pos')}"


def _pieces(text: str) -> str:
    marked = f"translate({text}, chr(31), ' ')"
    for pattern, becomes, times in RULES:
        to = becomes.replace("#", "\x1f").replace("$", "\\")
        for _ in range(times):
            marked = f"regexp_replace({marked}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"
    return f"list_filter(string_split({marked}, chr(31)), lambda x: x <> '')"


TOKENS = f"""{SENT},
pc0 AS (SELECT doc_id, pos, sent, begin, {_pieces("text")} AS pp FROM uns),
pc1 AS (SELECT doc_id, pos, sent, begin, unnest(pp) AS token, generate_subscripts(pp, 1) AS p FROM pc0),
pc2 AS (SELECT doc_id, pos, sent, token, regexp_matches(token, '\\A[{SPACE}]+\\z') AS blank, p,
               CAST(begin + coalesce(sum(length(token)) OVER (PARTITION BY doc_id, pos, sent ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin FROM pc1),
tk AS (SELECT doc_id, pos, sent, CAST(row_number() OVER (PARTITION BY doc_id, pos, sent ORDER BY p) - 1 AS BIGINT) AS i, token, begin FROM pc2 WHERE NOT blank)"""

#: Runs of capitalised tokens with connectors within, their contexts, and three rounds of weights on either side.
CHUNKS = f"""{TOKENS},
k0 AS (SELECT *, regexp_matches(token, '\\A\\p{{Lu}}') AND token NOT IN ('I', 'A') AS cap FROM tk),
k1 AS (SELECT *, coalesce(lower(lag(token) OVER o), '^') AS lft, coalesce(lower(lead(token) OVER o), '$') AS rgt,
              cap OR (lower(token) IN ({", ".join(f"'{c}'" for c in CONNECTORS)}) AND coalesce(lag(cap) OVER o AND lead(cap) OVER o, false)) AS inside
       FROM k0 WINDOW o AS (PARTITION BY doc_id, pos, sent ORDER BY i)),
k2 AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, pos, sent ORDER BY i) AS og, i - row_number() OVER (PARTITION BY doc_id, pos, sent, cap ORDER BY i) AS ig FROM k1 WHERE inside),
k3 AS (SELECT doc_id, pos, sent, og, min(i) AS b, max(i) + 1 AS e, string_agg(token, ' ' ORDER BY i) AS entity, arg_min(lft, i) AS lft, arg_max(rgt, i) AS rgt FROM k2 GROUP BY ALL),
k4 AS (SELECT doc_id, pos, sent, og, ig, min(i) AS b, max(i) + 1 AS e, string_agg(token, ' ' ORDER BY i) AS entity, arg_min(lft, i) AS lft, arg_max(rgt, i) AS rgt FROM k2 WHERE cap GROUP BY ALL),
ks AS (SELECT doc_id, pos, sent, b, e, 0 AS depth, CAST(NULL AS BIGINT) AS pb, entity, lft, rgt FROM k3
       UNION ALL SELECT k4.doc_id, k4.pos, k4.sent, k4.b, k4.e, 1, k3.b, k4.entity, k4.lft, k4.rgt FROM k4 JOIN k3 USING (doc_id, pos, sent, og) WHERE k4.b > k3.b OR k4.e < k3.e),
km AS (SELECT entity, c, count(*) AS n FROM (SELECT entity, unnest(['< ' || lft, '> ' || rgt]) AS c FROM ks) GROUP BY ALL),
kf AS (SELECT entity, CAST(sum(n) / 2 AS BIGINT) AS n, 1 - sum(CASE WHEN c = '< ^' THEN n ELSE 0 END) / (sum(n) / 2) AS own FROM km GROUP BY entity),
kb AS (SELECT * FROM km WHERE c NOT IN ('< ^', '> $')),
w0 AS (SELECT entity, own AS w FROM kf)""" + "".join(f""",
c{r} AS (SELECT c, sum(n * w) / (sum(n) + 1.0) AS p FROM kb JOIN w{r - 1} USING (entity) GROUP BY c),
w{r} AS (SELECT entity, (own + coalesce(s, 0)) / (1.0 + coalesce(k, 0)) AS w FROM kf LEFT JOIN (SELECT entity, sum(n * p) AS s, sum(n) AS k FROM kb JOIN c{r} USING (c) GROUP BY entity) USING (entity))""" for r in (1, 2, 3))

PAGERANK = f"""WITH RECURSIVE {U},{OVER},
nodes AS (SELECT doc_id, node, text FROM node WHERE pos = node),
size AS (SELECT doc_id, count(*) AS n FROM nodes GROUP BY doc_id),
link AS (SELECT doc_id, a AS s, b AS d FROM e UNION ALL SELECT doc_id, b, a FROM e WHERE a <> b),
step AS (SELECT doc_id, s, d, 1.0 / count(*) OVER (PARTITION BY doc_id, s) AS p FROM link
         UNION ALL SELECT x.doc_id, x.node, y.node, 1.0 / n FROM nodes x JOIN nodes y ON x.doc_id = y.doc_id JOIN size z ON x.doc_id = z.doc_id
         WHERE NOT EXISTS (SELECT 1 FROM link l WHERE l.doc_id = x.doc_id AND l.s = x.node)),
pr AS (SELECT doc_id, node, CAST(1.0 / n AS DOUBLE) AS score, 0 AS k FROM nodes JOIN size USING (doc_id)
       UNION ALL
       SELECT step.doc_id, step.d, CAST(0.85 * sum(score * p) + 0.15 / any_value(n) AS DOUBLE), any_value(k) + 1
       FROM pr JOIN step ON pr.doc_id = step.doc_id AND pr.node = step.s JOIN size ON pr.doc_id = size.doc_id WHERE k < 20 GROUP BY step.doc_id, step.d)
SELECT doc_id, text, round(coalesce(score, 0.15 / n), 6) AS score FROM nodes JOIN size USING (doc_id) LEFT JOIN (SELECT * FROM pr WHERE k = 20) USING (doc_id, node)"""

#: Boundaries: candidates by descending depth and gap, one after the other.
BOUNDS = f"""{TILE},
cr AS (SELECT doc_id, gap, row_number() OVER (PARTITION BY doc_id ORDER BY round(depth, 12) DESC, gap DESC) AS r FROM ca),
bd AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS taken FROM ca
       UNION ALL
       SELECT bd.doc_id, cr.r, CASE WHEN len(list_filter(taken, lambda y: abs(y - gap) < 4)) > 0 THEN taken ELSE list_append(taken, gap) END
       FROM bd JOIN cr ON bd.doc_id = cr.doc_id AND cr.r = bd.r + 1),
bo AS (SELECT doc_id, unnest(arg_max(taken, r)) AS gap FROM bd GROUP BY doc_id)"""

#: Paragraph breaks, a hundred characters apart at least, the places of boundaries, and the nearest break of each.
NEAREST = f"""{BOUNDS},
jt AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) || chr(9) || ' ' ORDER BY pos) AS text FROM u GROUP BY doc_id),
pz AS (SELECT doc_id, text, list_transform(string_split(regexp_replace(text, '([ \\t\\r\\f\\v]*\\n[ \\t\\r\\f\\v]*\\n[ \\t\\r\\f\\v]*)', '\x1e\\1', 'g'), chr(30)), lambda x: length(x)) AS ls FROM jt),
py AS (SELECT doc_id, list_concat([CAST(0 AS HUGEINT)], list_transform(generate_series(1, len(ls) - 1), lambda i: list_sum(ls[1 : i]))) AS ps FROM pz),
br AS (SELECT doc_id, CAST(unnest(list_reduce(list_transform(ps, lambda x: [x]), lambda acc, x: CASE WHEN x[1] - acc[-1] >= 100 THEN list_concat(acc, x) ELSE acc END)) AS BIGINT) AS brk FROM py),
wl AS (SELECT doc_id, length(text) AS nc, list_transform(regexp_extract_all(text, '[ \\t\\n]*[^ \\t\\n]+'), lambda x: length(x)) AS ls FROM jt),
gp AS (SELECT doc_id, gap, nc, ls, CAST(greatest(gap, 1) * 20 + 1 AS BIGINT) AS k FROM bo JOIN wl USING (doc_id)),
gq AS (SELECT doc_id, gap, nc, CAST(list_sum(ls[1 : k]) AS BIGINT) AS fin FROM gp WHERE k <= len(ls)),
gr2 AS (SELECT doc_id, gap, nc, CAST(fin + 1 + CAST(gap = 1 AS INT) AS BIGINT) AS spot FROM gq WHERE fin < nc),
nb AS (SELECT g.doc_id, g.gap, g.spot, g.nc, b.brk AS before FROM (SELECT * FROM gr2 WHERE spot <= nc) g ASOF LEFT JOIN br b ON g.doc_id = b.doc_id AND g.spot >= b.brk),
na AS (SELECT g.*, b.brk AS after FROM nb g ASOF LEFT JOIN br b ON g.doc_id = b.doc_id AND g.spot < b.brk),
sn AS (SELECT * FROM (SELECT *, CASE WHEN after - spot < spot - before THEN after ELSE before END AS paragraph FROM na) WHERE abs(paragraph - spot) < nc),
ct AS (SELECT doc_id, list_sort(list_distinct(list(paragraph) FILTER (WHERE paragraph > 0))) AS cuts FROM sn GROUP BY doc_id),
ed AS (SELECT doc_id, text, list_concat([CAST(0 AS BIGINT)], coalesce(cuts, []), [length(text)]) AS e FROM jt LEFT JOIN ct USING (doc_id)),
sg AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS seg, replace(substr(text, CAST(e[i] + 1 AS INT), CAST(e[i + 1] - e[i] AS INT)), chr(10) || chr(10) || chr(9) || ' ', ' | ') AS text
       FROM (SELECT doc_id, text, e, unnest(generate_series(1, len(e) - 1)) AS i FROM ed))"""

#: The sentence of each segment whose smoothed column of word weights is longest.
LSA = f"""{NEAREST}, {LEARN},
sp AS (SELECT doc_id, seg, unnest(string_split(text, ' | ')) AS text, generate_subscripts(string_split(text, ' | '), 1) - 1 AS part FROM sg),
{_units("sv", "sp", "doc_id, seg, part")}, {_split("sv", "doc_id, seg, part")},
ww AS (SELECT doc_id, seg, part, sent, word, count(*) AS n FROM (SELECT doc_id, seg, part, sent, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM svs) GROUP BY ALL),
wm AS (SELECT *, max(n) OVER (PARTITION BY doc_id, seg, part, sent) AS m FROM ww),
wv AS (SELECT doc_id, seg, count(DISTINCT word) AS size FROM ww GROUP BY ALL),
wr AS (SELECT doc_id, seg, part, sent, sqrt(sum(pow(0.4 + 0.6 * n / m, 2)) + (any_value(size) - count(*)) * 0.16) AS rk FROM wm JOIN wv USING (doc_id, seg) GROUP BY ALL),
wb AS (SELECT doc_id, seg, text, row_number() OVER (PARTITION BY doc_id, seg ORDER BY round(coalesce(rk, 0), 9) DESC, part, sent) AS r FROM svs LEFT JOIN wr USING (doc_id, seg, part, sent))"""

#: Greedy cover: each step takes the candidate with which the sum is nearest to the centroid. ``cand``: (doc_id, pos).
GREEDY = """
ce AS (SELECT doc_id, term, sum(w) AS c FROM v GROUP BY ALL), le AS (SELECT doc_id, sqrt(sum(c * c)) AS l FROM ce GROUP BY doc_id),
{cand},
cv AS (SELECT v.* FROM v JOIN cand USING (doc_id, pos)),
tc AS (SELECT cand.doc_id, cand.pos, coalesce(sum(w * c), 0) AS toc, coalesce(sum(w * w), 0) AS own FROM cand LEFT JOIN v USING (doc_id, pos) LEFT JOIN ce USING (doc_id, term) GROUP BY ALL),
gr AS (SELECT a.doc_id, a.pos AS i, b.pos AS j, sum(a.w * b.w) AS g FROM cv a JOIN cv b ON a.doc_id = b.doc_id AND a.term = b.term GROUP BY ALL),
st AS (SELECT doc_id, pos, CAST(0 AS BIGINT) AS step, CAST(0 AS DOUBLE) AS ws, CAST(0 AS DOUBLE) AS norm2, CAST(0 AS DOUBLE) AS dot, CAST(NULL AS BIGINT) AS took, toc, own, l FROM tc LEFT JOIN le USING (doc_id)
       UNION ALL
       SELECT x.doc_id, x.pos, step + 1, ws + coalesce(g, 0), norm2 + 2 * bw + bo, dot + bt, best, toc, own, l
       FROM (SELECT *, first_value(pos) OVER p AS best, first_value(ws) OVER p AS bw, first_value(own) OVER p AS bo, first_value(toc) OVER p AS bt
             FROM (SELECT *, max(cosine) OVER (PARTITION BY doc_id) AS most
                   FROM (SELECT *, CASE WHEN l * sqrt(greatest(0, norm2 + 2 * ws + own)) > 1e-12 THEN (dot + toc) / (l * sqrt(greatest(0, norm2 + 2 * ws + own))) ELSE 0 END AS cosine FROM st WHERE step < 5))
             WINDOW p AS (PARTITION BY doc_id ORDER BY CASE WHEN cosine >= most - 1e-12 THEN 0 ELSE 1 END, pos)) x
       LEFT JOIN gr ON gr.doc_id = x.doc_id AND gr.i = x.pos AND gr.j = x.best)"""
COVER = "SELECT DISTINCT st.doc_id, step - 1 AS step, took AS pos, text FROM st JOIN u ON st.doc_id = u.doc_id AND st.took = u.pos WHERE step > 0"
COSINES = "cs AS (SELECT u.doc_id, u.pos, coalesce(s / l, 0) AS score FROM u LEFT JOIN (SELECT v.doc_id, pos, sum(w * c) AS s FROM v JOIN ce USING (doc_id, term) GROUP BY ALL) USING (doc_id, pos) LEFT JOIN le USING (doc_id))"
FRESH = f"{TOK}, f AS (SELECT *, min(pos) OVER (PARTITION BY doc_id, term) AS m FROM t), cs AS (SELECT u.doc_id, u.pos, coalesce(s, 0) AS score FROM u LEFT JOIN (SELECT doc_id, pos, sum(CASE WHEN idf > 4 THEN idf ELSE 0 END) AS s FROM f JOIN i USING (term) WHERE pos = m GROUP BY ALL) USING (doc_id, pos))"
TOP_CAND = "cand AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, pos) AS r FROM cs) WHERE r <= 5)"

#: Ranks until the change is below a millionth per node, 100 rounds at most. ``we``: (doc_id, a, b, w).
CONVERGED = """
nodes AS (SELECT doc_id, node, text FROM node WHERE pos = node),
size AS (SELECT doc_id, count(*) AS n FROM nodes GROUP BY doc_id),
link AS (SELECT doc_id, a AS s, b AS d, w FROM we UNION ALL SELECT doc_id, b, a, w FROM we WHERE a <> b),
step AS (SELECT doc_id, s, d, w / sum(w) OVER (PARTITION BY doc_id, s) AS p, false AS same FROM link
         UNION ALL SELECT x.doc_id, x.node, y.node, 1.0 / n, false FROM nodes x JOIN nodes y ON x.doc_id = y.doc_id JOIN size z ON x.doc_id = z.doc_id
         WHERE NOT EXISTS (SELECT 1 FROM link l WHERE l.doc_id = x.doc_id AND l.s = x.node)
         UNION ALL SELECT doc_id, node, node, 0, true FROM nodes),
pr AS (SELECT doc_id, node, CAST(1.0 / n AS DOUBLE) AS score, 0 AS k, true AS moving FROM nodes JOIN size USING (doc_id)
       UNION ALL
       SELECT doc_id, node, score, k, sum(abs(score - old)) OVER (PARTITION BY doc_id) >= n * 1e-6
       FROM (SELECT step.doc_id, step.d AS node, CAST(0.85 * sum(score * p) + 0.15 / any_value(n) AS DOUBLE) AS score, any_value(k) + 1 AS k, any_value(n) AS n, sum(score) FILTER (WHERE same) AS old
             FROM pr JOIN step ON pr.doc_id = step.doc_id AND pr.node = step.s JOIN size ON pr.doc_id = size.doc_id WHERE moving AND k < 100 GROUP BY step.doc_id, step.d)),
best AS (SELECT doc_id, text, score, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, node) AS rank
         FROM nodes JOIN (SELECT * FROM pr WHERE NOT moving OR k = 100) USING (doc_id, node) WHERE len(regexp_extract_all(text, '\\S+')) < 50)"""
PHRASES = "SELECT doc_id, CAST(rank AS INT) AS rank, text, round(score, 6) AS score FROM best WHERE rank <= 5"

#: Centrality: steps x + Wx, scaled to length 1.
CENTRAL = f"""{OCC},
wt AS (SELECT k1, k2, 400 * c / (SELECT sum(c) FROM co) AS w FROM co),
both_ends AS (SELECT k1 AS a, k2 AS b, w FROM wt UNION ALL SELECT k2, k1, w FROM wt UNION ALL SELECT term, term, 0 FROM top),
it AS (SELECT term, CAST(1.0 / (SELECT count(*) FROM top) AS DOUBLE) AS x, 0 AS k, true AS moving FROM top
       UNION ALL
       SELECT term, x, k, sum(abs(x - old)) OVER () >= count(*) OVER () * 1e-6
       FROM (SELECT term, y / sqrt(sum(y * y) OVER ()) AS x, k, old FROM (SELECT a AS term, sum(x * w) + sum(x) FILTER (WHERE a = b) AS y, any_value(k) + 1 AS k, sum(x) FILTER (WHERE a = b) AS old FROM it JOIN both_ends ON it.term = b WHERE moving AND k < 100 GROUP BY a)))"""

SPEAKER = "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS BIGINT) AS new_pos, speaker FROM u WHERE {}"
GRAMS = PAIRS.format(x="regexp_extract_all(tokenized, '[a-z]{2,}')")
HIT = "SELECT file, pos, text FROM u WHERE list_contains({}, '{}')"
ENTITY = r"unnest(regexp_extract_all(text, '\p{Lu}[\p{L}\p{N}]+(?: \p{Lu}[\p{L}\p{N}]+)*')) AS entity"
FIRST_ENTITIES = rf"""x0 AS (SELECT doc_id, pos, {ENTITY.removeprefix("unnest(").removesuffix(") AS entity")} AS es FROM u),
x AS (SELECT doc_id, pos, generate_subscripts(es, 1) AS j, unnest(es) AS entity FROM x0), e AS (SELECT entity, count(*) AS n, min([doc_id, pos, j]) AS f FROM x GROUP BY entity)"""
PCT = "SELECT unnest([25.0, 50.0, 75.0, 95.0, 100.0]::DOUBLE[]) AS pct, unnest(list_transform(quantile_cont(n, [0.25, 0.5, 0.75, 0.95, 1.0]), lambda x: round(x, 6))) AS value FROM l"

ORACLES: dict[str, str] = {
    "transcripts_reread": q("", "SELECT speaker, text, count(*) AS n FROM u GROUP BY ALL"),
    "utterances_load": q("", "SELECT doc_id, pos, CAST(row_number() OVER (ORDER BY doc_id, pos) - 1 AS BIGINT) AS line_no, speaker, text, tokenized, file, CAST(-1 AS DOUBLE) AS score FROM u"),
    "parse_speaker_lines": q("x AS (SELECT doc_id, pos, speaker || ': ' || text AS l FROM u)", "SELECT doc_id, pos, CASE WHEN strpos(l, ':') > 0 THEN trim(substr(l, 1, strpos(l, ':') - 1)) ELSE 'UNK' END AS speaker, CASE WHEN strpos(l, ':') > 0 THEN trim(substr(l, strpos(l, ':') + 1)) ELSE trim(l) END AS text FROM x"),
    "split_main_speakers": q("", SPEAKER.format("speaker = 'assistant'")),
    "split_other_speakers": q("", SPEAKER.format("speaker IS DISTINCT FROM 'assistant'")),
    "concat_documents": q("", "SELECT doc_id, string_agg(tokenized, ' ' ORDER BY pos) AS text FROM u GROUP BY doc_id"),
    "year_groups": q("f AS (SELECT DISTINCT 'talk_' || doc_id || '_' || (doc_id % 7 + 2010) || '.txt' AS file FROM u), y AS (SELECT DISTINCT substr(file, -8, 4) AS year FROM f)", "SELECT year, file FROM y JOIN f ON contains(file, year)"),
    "tokens_without_stopwords": q(TOK, f"SELECT doc_id, pos, term AS tok FROM t WHERE NOT list_contains({S1}, term)"),
    "described_documents": q("", "SELECT doc_id, 'Document of ' || count(*) || ' utterances' AS described FROM u GROUP BY doc_id"),
    "described_corpus": q("", "SELECT 'Corpus of ' || count(DISTINCT doc_id) || ' transcripts' AS described FROM u"),
    "shown_utterances": q("", "SELECT doc_id, pos, speaker || ': ' || text AS shown FROM u"),
    "clean_terms": q("", r"SELECT doc_id, pos, regexp_replace(lower(text), '[^a-z\s]', '', 'g') AS cleaned FROM u"),
    "count_docs": q("", "SELECT count(DISTINCT doc_id) AS n_docs FROM u"),
    "doc_words": q("w AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\S+')) AS w FROM u)", "SELECT d.doc_id, count(w) AS n_words, count(DISTINCT w) AS n_distinct FROM (SELECT DISTINCT doc_id FROM u) d LEFT JOIN w ON d.doc_id = w.doc_id GROUP BY d.doc_id"),
    "corpus_words": q("w AS (SELECT unnest(regexp_extract_all(text, '\\S+')) AS w FROM u)", "SELECT count(w) AS n_words, count(DISTINCT w) AS n_distinct FROM w"),
    "doc_lines": q("", "SELECT doc_id, count(*) AS n_lines FROM u GROUP BY doc_id"),
    "corpus_lines": q("", "SELECT count(*) AS n_lines FROM u"),
    "utterance_percentiles": q("l AS (SELECT len(regexp_extract_all(text, '\\S+')) AS n FROM u)", PCT),
    "doc_speakers": q("s AS (SELECT doc_id, speaker, count(*) AS n_utterances, min(pos) AS f FROM u GROUP BY ALL)", "SELECT doc_id, speaker, n_utterances, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n_utterances DESC, f) AS INT) AS rank FROM s"),
    "corpus_speakers": q("", "SELECT speaker, count(*) AS n_utterances FROM u GROUP BY speaker"),
    "main_speaker_total": q("", "SELECT count(*) AS n_utterances FROM u WHERE speaker = 'assistant'"),
    "entities_heuristic": q(f"x AS (SELECT {ENTITY} FROM u)", "SELECT entity, count(*) AS n FROM x GROUP BY entity"),
    "entities_by_document": q(f"x AS (SELECT doc_id, {ENTITY} FROM u)", "SELECT doc_id, entity, count(*) AS n FROM x GROUP BY ALL"),
    "entity_keywords": q(f"x AS (SELECT {ENTITY} FROM u), e AS (SELECT entity, count(*) AS n FROM x GROUP BY entity ORDER BY n DESC, entity LIMIT 75)", f"SELECT DISTINCT lower(entity) AS term FROM e WHERE n >= 5 AND NOT list_contains({S3}, lower(entity))"),
    "corpus_speakers_ranked": q("s AS (SELECT speaker, count(*) AS n_utterances, min([doc_id, pos]) AS f FROM u GROUP BY speaker)", "SELECT speaker, n_utterances, row_number() OVER (ORDER BY n_utterances DESC, f) AS rank FROM s"),
    "entities_ranked": q(FIRST_ENTITIES, "SELECT entity, n, row_number() OVER (ORDER BY n DESC, f) AS rank FROM e QUALIFY rank <= 75"),
    "entities_ranked_all": q(FIRST_ENTITIES, "SELECT entity, n, row_number() OVER (ORDER BY n DESC, f) AS rank FROM e"),
    "search_unigram": q("", HIT.format(GRAMS, "the")),
    "search_postings": q("", f"SELECT doc_id, pos FROM u WHERE list_contains({GRAMS}, 'of the')"),
    "search_bigram": q("", HIT.format(GRAMS, "of the")),
    "search_grouped": q("", f"SELECT file, count(*) AS n, string_agg(text, chr(10) ORDER BY pos) AS lines FROM u WHERE list_contains({GRAMS}, 'the') GROUP BY file"),
    "tfidf_utterance": q(UTT, "SELECT doc_id, pos, term, round(w, 6) AS w FROM v"),
    "tfidf_document_sublinear": q(KEY, "SELECT doc_id, term, round(w, 6) AS w FROM v"),
    "tfidf_cluster": q(CLU, "SELECT doc_id, term, round(w, 6) AS w FROM v"),
    "doc_distance_matrix": q(f"{CLU}, n AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS INT) AS other FROM (SELECT DISTINCT doc_id FROM u)), s AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(a.w * b.w) AS s FROM v a JOIN v b ON a.term = b.term AND a.doc_id <> b.doc_id GROUP BY ALL)",
                             "SELECT x.doc_id, y.other, round(CASE WHEN x.doc_id = y.doc_id THEN 0 ELSE 1 - coalesce(s, 0) END, 6) AS dist FROM n x, n y LEFT JOIN s ON s.a = x.doc_id AND s.b = y.doc_id"),
    "doc_cosine_distance": q(CLU, "SELECT a.doc_id AS a, b.doc_id AS b, round(1 - sum(a.w * b.w), 6) AS dist FROM v a JOIN v b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY ALL"),
    "lexrank_edges_naive": q(OVER, "SELECT doc_id, i, j, round(CASE WHEN n <> 1 THEN n / log10(n) ELSE 0 END, 6) AS sim FROM o"),
    "lexrank_edges_idfmod": q(f"{LEX}, m AS (SELECT doc_id, pos, sqrt(sum(x * x)) AS m FROM r GROUP BY ALL), s AS (SELECT a.doc_id, a.pos AS i, b.pos AS j, sum(a.x * b.x) AS s FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.term = b.term AND a.pos < b.pos GROUP BY ALL)",
                              "SELECT s.doc_id, i, j, round(s / (x.m * y.m), 6) AS sim FROM s JOIN m x ON s.doc_id = x.doc_id AND i = x.pos JOIN m y ON s.doc_id = y.doc_id AND j = y.pos"),
    "lexrank_edges_tfidf": q(LEX, "SELECT a.doc_id, a.pos AS i, b.pos AS j, round(sum(a.w * b.w), 6) AS sim FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.term = b.term AND a.pos < b.pos GROUP BY ALL"),
    "lexrank_pagerank_fixed": PAGERANK,
    "lexrank_pruned_nodes": q(OVER, "SELECT DISTINCT doc_id, node, text FROM node WHERE pos = node AND EXISTS (SELECT 1 FROM e WHERE e.doc_id = node.doc_id AND (e.a = node.node OR e.b = node.node))"),
    "keynet_keywords": q(KEY, "SELECT term, round(score, 6) AS score FROM top"),
    "keynet_cooccurrence": q(OCC, "SELECT k1, k2, c FROM co"),
    "keynet_edges": q(OCC, "SELECT k1, k2, round(400 * c / (SELECT sum(c) FROM co), 6) AS weight FROM co"),
    "centroid_cosine": q(f"{UTT}, ce AS (SELECT doc_id, term, sum(w) AS c FROM v GROUP BY ALL), le AS (SELECT doc_id, sqrt(sum(c * c)) AS l FROM ce GROUP BY doc_id), dt AS (SELECT v.doc_id, pos, sum(w * c) AS s FROM v JOIN ce USING (doc_id, term) GROUP BY ALL)",
                         "SELECT u.doc_id, u.pos, round(coalesce(s / l, 0), 6) AS score FROM u LEFT JOIN dt USING (doc_id, pos) LEFT JOIN le USING (doc_id)"),
    "centroid_new_vocab": q(f"{UTT}, {TOK}, f AS (SELECT *, min(pos) OVER (PARTITION BY doc_id, term) AS m FROM t), nv AS (SELECT doc_id, pos, sum(CASE WHEN idf > 4 THEN idf ELSE 0 END) AS s FROM f JOIN i USING (term) WHERE pos = m GROUP BY ALL)",
                            "SELECT u.doc_id, u.pos, round(coalesce(s, 0), 6) AS score FROM u LEFT JOIN nv USING (doc_id, pos)"),
    "texttile_gaps": q(TILE, "SELECT doc_id, gap, round(score, 6) AS score FROM gs"),
    "texttile_smooth": q(TILE, "SELECT doc_id, gap, round(score, 6) AS score FROM sm"),
    "texttile_depth": q(TILE, "SELECT doc_id, gap, round(depth, 6) AS depth FROM dp"),
    "texttile_candidates": q(TILE, "SELECT doc_id, gap, round(depth, 6) AS depth FROM ca"),
    "texttile_boundaries": q(BOUNDS, "SELECT doc_id, gap FROM bo", True),
    "texttile_plot": q(BOUNDS, "SELECT gs.doc_id, gs.gap, round(gs.score, 6) AS score, round(sm.score, 6) AS smooth, round(depth, 6) AS depth, CAST(bo.gap IS NOT NULL AS INT) AS boundary FROM gs LEFT JOIN sm USING (doc_id, gap) LEFT JOIN dp USING (doc_id, gap) LEFT JOIN bo ON bo.doc_id = gs.doc_id AND bo.gap = gs.gap", True),
    "paragraph_nearest": q(NEAREST, 'SELECT doc_id, gap, spot AS "at", paragraph FROM sn', True),
    "texttile_segments": q(NEAREST, "SELECT doc_id, seg, text FROM sg", True),
    "segment_lsa": q(LSA, "SELECT doc_id, seg, coalesce(wb.text, '') AS sentence FROM sg LEFT JOIN (SELECT * FROM wb WHERE r = 1) wb USING (doc_id, seg)", True),
    "abbreviation_scores": q(LEARN, "SELECT type, n_dotted, n_plain, round(score, 6) + 0.0 AS score, score >= 0.3 AS is_abbreviation FROM ab"),
    "sentence_collocations": q(LEARN, "SELECT first, second, n, round(ratio, 6) AS ratio FROM co"),
    "sentence_starters": q(LEARN, "SELECT type, n, round(ratio, 6) AS ratio FROM sa"),
    "sentences": q(SENT, "SELECT doc_id, pos, sent, begin, text FROM uns"),
    "entities_chunked": q(CHUNKS, "SELECT entity, n, round(w, 6) AS weight FROM kf JOIN w3 USING (entity) WHERE w >= 0.3"),
    "entity_tree": q(CHUNKS, "SELECT doc_id, pos, sent, b AS begin, e AS \"end\", depth, pb AS parent_begin, entity, round(w, 6) AS weight FROM ks JOIN w3 USING (entity) WHERE w >= 0.3"),
    "word_tokens": q(TOKENS, "SELECT doc_id, pos, sent, i, token, begin FROM tk"),
    "lexrank_keyphrases": q(f"{OVER}, we AS (SELECT doc_id, a, b, 1.0 AS w FROM e), {CONVERGED}", PHRASES, True),
    "lexrank_weighted": q(f"""{OVER}, sm AS (SELECT a.doc_id, a.pos AS i, b.pos AS j, sum(a.w * b.w) AS sim FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.term = b.term AND a.pos < b.pos GROUP BY ALL),
we AS (SELECT sm.doc_id, least(x.node, y.node) AS a, greatest(x.node, y.node) AS b, max(sim) AS w FROM sm JOIN node x ON sm.doc_id = x.doc_id AND i = x.pos JOIN node y ON sm.doc_id = y.doc_id AND j = y.pos GROUP BY ALL), {CONVERGED}""", PHRASES, True),
    "centroid_summary": q(f"{UTT}, {GREEDY.format(cand='cand AS (SELECT doc_id, pos FROM u WHERE pos < 250)')}", COVER, True),
    "centroid_summary_best": q(f"{UTT}, {GREEDY.format(cand=COSINES + ', ' + TOP_CAND)}", COVER, True),
    "centroid_summary_tfidf": q(f"{UTT}, {GREEDY.format(cand=FRESH + ', ' + TOP_CAND)}", COVER, True),
    "centroid_summary_all": q(f"{UTT}, {GREEDY.format(cand='cand AS (SELECT doc_id, pos FROM u)')}", COVER, True),
    "keynet_centrality": q(CENTRAL, "SELECT term, round(x, 6) AS centrality, round(x * x * 5000, 6) AS node_size FROM it WHERE k = (SELECT max(k) FROM it)", True),
    "dendrogram_labels": q("", "SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS leaf, doc_id, substr(min(file), -8, 4) AS year FROM u GROUP BY doc_id"),
}
