"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from .urlfilter import TRACKING

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


#: A line goes if it and a neighbour stood side by side before, or if it has 40 words and stood before; blank lines between such go too.
LINE_DEDUP = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, pos, line, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
p AS (SELECT doc_id, pos, next IS NOT NULL AND row_number() OVER (PARTITION BY line, next ORDER BY doc_id, pos) > 1 AS pair,
      len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) >= 40 AND row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) > 1 AS lone FROM f),
g AS (SELECT doc_id, pos, pair OR lone OR coalesce(lag(pair) OVER (PARTITION BY doc_id ORDER BY pos), false) AS gone FROM p),
a AS (SELECT l.doc_id, l.pos, line, CASE WHEN gone IS NOT NULL THEN gone ELSE coalesce(last_value(gone IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      AND first_value(gone IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) END AS gone FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.pos = l.pos),
o AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed FROM a GROUP BY doc_id)
SELECT d.doc_id, o.text, coalesce(o.n_lines, 0) AS n_lines, coalesce(o.n_removed, 0) AS n_removed FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id
"""

#: The flags of each document as bits, counts for each part and combination of flags, then all orders.
FILTER_AUDIT = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, doc_id > min(doc_id) OVER (PARTITION BY text) AS again FROM t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
      + 4 * (100 * len(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * len(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(again, false)::INT AS mask
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, mask),
a AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT '' AS filter_order, 0 AS step, 0 AS before, 0 AS bit UNION ALL SELECT filter_order || x, step + 1, o.before | o.bit, a.bit FROM o JOIN a ON (o.before | o.bit) & a.bit = 0),
s AS (SELECT whole.filter_order, o.step, o.before, o.bit FROM o JOIN o AS whole ON whole.step = 5 AND o.step > 0 AND starts_with(whole.filter_order, o.filter_order)),
r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
      coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
      coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
      FROM c CROSS JOIN s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""

#: Each window of 50 words, those that start in an earlier document too, and the words that none of these covers.
REPEATED_WINDOWS = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM w WHERE len(words) >= 50),
v AS (SELECT doc_id, s, array_to_string(words[s:s + 49], ' ') AS words FROM p),
g AS (SELECT doc_id, s, doc_id > min(doc_id) OVER (PARTITION BY words) AS again FROM v),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM g WHERE again),
x AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
o AS (SELECT x.doc_id, count(*) AS n_words, count(c.i) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY x.i) FILTER (c.i IS NULL), '')) AS kept FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.i = x.i GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept, sha256('')) AS kept_sha256 FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id
"""

#: Runs of seven letters or more with crc32 made from its table, words without a letter as join keys, then forms to their ends.
SPELLING_VARIANTS = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
u AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
c AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM u WHERE length(run) >= 7 GROUP BY ALL),
x AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM c),
b AS (SELECT run, n, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS bytes FROM x),
k AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, v: xor(c >> 8, t.t[(xor(c, v) & 255) + 1])), 4294967295) AS crc FROM b, t),
r AS (SELECT CASE WHEN crc % 31 = 0 THEN substr(run, 1, (crc % length(run))::INT) || substr(run, (crc % length(run))::INT + 2) ELSE run END AS word, n FROM k),
v AS (SELECT word, sum(n)::BIGINT AS n FROM r WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS (SELECT word, n, p, substr(word, 1, p) || substr(word, p + 2) AS part FROM (SELECT word, n, unnest(range(0, length(word)))::INT AS p FROM v)),
near AS (SELECT a.word, b.word AS other, b.n FROM d a JOIN d b ON a.p = b.p AND a.part = b.part AND a.word <> b.word
         UNION SELECT d.word, v.word, v.n FROM d JOIN v ON v.word = d.part UNION SELECT v.word, d.word, d.n FROM d JOIN v ON v.word = d.part),
best AS (SELECT word, count(*) AS n_near, max(n) AS top, min_by(other, (-n, other)) AS other FROM near GROUP BY word),
f AS (SELECT v.word, CASE WHEN top >= 10 * v.n THEN other END AS form, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * v.n THEN top END AS form_n FROM v LEFT JOIN best ON best.word = v.word),
s AS (SELECT word, word AS goal, 0 AS step FROM f UNION ALL SELECT s.word, f.form, step + 1 FROM s JOIN f ON f.word = s.goal WHERE f.form IS NOT NULL),
e AS (SELECT word, max_by(goal, step) AS root FROM s GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN e ON e.word = f.word
"""


def _host(u: str) -> str:
    return f"translate(coalesce(regexp_extract({u}, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _path(u: str) -> str:
    return f"coalesce(regexp_extract({u}, '://[^/?#]*([^?#]*)', 1), '')"


def _rule(host: str, path: str, rules, what: str) -> str:
    value = {"rule": lambda v, h, p: h + p, "verdict": lambda v, h, p: v}[what]
    whens = [f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{value(v, h, p)}'" for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))]
    return f"CASE {' '.join(whens)} END"


def _normal(u: str) -> str:
    host = f"regexp_replace(regexp_replace({_host(u)}, '^(?:www|m|amp)\\.', ''), ':(?:80|443)$', '')"
    path = f"regexp_replace(regexp_replace({_path(u)}, '(?:index)?\\.html?$', ''), '/+$', '')"
    query = f"array_to_string(list_filter(string_split(regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^{TRACKING}(?:=|$)')), '&')"
    return f"CASE WHEN contains({u}, '://') THEN {host} || {path} || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END END"


def _absolute(link: str, base: str) -> str:
    scheme = f"regexp_extract({base}, '(?s)^(.*?)://', 1)"
    folder = f"regexp_replace({_path(base)}, '[^/]*$', '')"
    return (
        f"CASE WHEN regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {link} WHEN starts_with({link}, '//') THEN {scheme} || ':' || {link} "
        f"WHEN starts_with({link}, '/') THEN {scheme} || '://' || {_host(base)} || {link} WHEN {link} <> '' THEN {scheme} || '://' || {_host(base)} || {folder} || CASE WHEN {_path(base)} = '' THEN '/' ELSE '' END || {link} END"
    )


def url_verdicts(rules) -> str:
    href = r"""\bhref\s*=\s*["'']?([^"''\s>]+)"""
    canonical = rf"""regexp_extract(regexp_extract(html, '(?i)<link\b[^>]*?\brel\s*=\s*["'']?canonical\b[^>]*>', 0), '(?i){href}', 1)"""
    refresh = r"""regexp_extract(html, '(?i)<meta\b[^>]*?http-equiv\s*=\s*["'']?refresh\b[^>]*?\burl\s*=\s*["'']?([^"''\s>]+)', 1)"""
    return f"""
WITH RECURSIVE p AS (SELECT page_id, url, {_host('url')} AS host, {_path('url')} AS path FROM pages),
l AS (SELECT DISTINCT url, link FROM (SELECT url, {canonical} AS link FROM pages UNION ALL SELECT url, {refresh} FROM pages) WHERE url IS NOT NULL AND link <> ''),
e AS (SELECT url, {_absolute('link', 'url')} AS target FROM l),
u AS (SELECT url FROM pages UNION SELECT url FROM e UNION SELECT target FROM e),
k AS (SELECT n, bool_or(v = 'allow') AS allows, bool_or(v = 'block') AS blocks FROM (SELECT {_normal('url')} AS n, {_rule(_host('url'), _path('url'), rules, 'verdict')} AS v FROM u) WHERE n IS NOT NULL GROUP BY n),
b AS (SELECT a, z FROM (SELECT {_normal('url')} AS a, {_normal('target')} AS z FROM e) WHERE a IS NOT NULL AND z IS NOT NULL),
s AS (SELECT a, z FROM b UNION SELECT z, a FROM b),
r AS (SELECT n, n AS o FROM k UNION SELECT r.n, s.z FROM r JOIN s ON s.a = r.o),
c AS (SELECT n, min(o) AS root FROM r GROUP BY n),
w AS (SELECT root, bool_or(allows) AS allows, bool_or(blocks) AS blocks FROM k JOIN c ON c.n = k.n GROUP BY root)
SELECT page_id, host, path, {_rule('host', 'path', rules, 'rule')} AS rule,
       coalesce({_rule('host', 'path', rules, 'verdict')}, CASE WHEN allows THEN 'allow' WHEN blocks THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN c ON c.n = {_normal('p.url')} LEFT JOIN w ON w.root = c.root
"""
