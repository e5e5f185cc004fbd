"""DuckDB SQL for the queries of this subpackage that SQL can express.

Training (1, 2, 3, 9), sanitisation by corpus statistics (6), packing (8), novelty (12)
and tokenizers (13) have no such form; tests hold them against brute force, round trips and held-out rows."""

from __future__ import annotations

from .queries import LISTED_LABELS, RULES

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

# base32 of the hexadecimal digest: five hexadecimal digits are four characters
_BASE32 = "list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, (i // 4) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1)), 'string_agg', '')"

OP4 = f"""WITH p AS (SELECT page_id, coalesce(html, '') t FROM pages), q AS (SELECT page_id, octet_length(encode(t)) payload_bytes, sha1(t) h, min(page_id) OVER (PARTITION BY t) first FROM p)
SELECT page_id, payload_bytes, {_BASE32} payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END record_type, CASE WHEN page_id <> first THEN first END refers_to FROM q"""

_RULES = sorted(RULES, key=lambda r: -len(r.name))
_FITS = {r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in _RULES}
OP5 = f"""WITH u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END rest FROM pages),
s AS (SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), {_LOWER}), '') host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, split_part(coalesce(url, ''), '#', 1) bare FROM u),
t AS (SELECT *, list_sort(list_filter(string_split(CASE WHEN contains(bare, '?') THEN substr(bare, strpos(bare, '?') + 1) ELSE '' END, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) q FROM s),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END canonical FROM t),
l AS (SELECT DISTINCT canonical FROM c WHERE list_has_any(string_split(host, '.'), [{", ".join(f"'{x}'" for x in LISTED_LABELS)}]) AND canonical IS NOT NULL)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {f} THEN '{r.name}'" for r, f in _FITS.items())} END AS rule,
CASE {" ".join(f"WHEN {f} THEN '{r.verdict}'" for r, f in _FITS.items())} WHEN canonical IN (SELECT canonical FROM l) THEN 'block' ELSE 'allow' END verdict FROM c"""

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP7 = f"""WITH d AS (SELECT row_number() OVER () r, doc_id, {_WORDS} w FROM documents), i AS (SELECT item_id, {_WORDS} w FROM benchmark),
k AS (SELECT item_id, least(len(w), 13) n, unnest(list_transform(range(greatest(len(w) - 12, 1)), lambda s: array_to_string(w[s + 1:s + 13], ' '))) g FROM i WHERE len(w) > 0),
n AS (SELECT DISTINCT n FROM k),
g AS (SELECT r, n, unnest(range(len(w) - n + 1)) s, w FROM d, n WHERE len(w) >= n),
m AS (SELECT g.r, k.item_id, g.s, g.n FROM (SELECT r, n, s, array_to_string(w[s + 1:s + n], ' ') g FROM g) g JOIN k ON g.g = k.g AND g.n = k.n),
h AS (SELECT r, count(DISTINCT x) n_hit FROM (SELECT r, unnest(range(s, s + n)) x FROM m) GROUP BY r),
t AS (SELECT r, count(*) n_items, string_agg(x, ',' ORDER BY x) ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) x FROM m) GROUP BY r)
SELECT doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)"""

_TOKENS = f"regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x20\\x09-\\x0D]+')"
OP10 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_TOKENS} w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(len(w) - 3), lambda i: array_to_string(w[i + 1:i + 4], ' '))) END g FROM d),
n AS MATERIALIZED (SELECT doc_id, len(g) n FROM s), x AS MATERIALIZED (SELECT doc_id, unnest(g) h FROM s),
e AS MATERIALIZED (SELECT a, b FROM (SELECT a.doc_id a, b.doc_id b, count(*) c FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL) p JOIN n i ON i.doc_id = a JOIN n j ON j.doc_id = b WHERE 100 * c >= 85 * (i.n + j.n - c)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id a, doc_id b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, n n_shingles, c component_id FROM n JOIN (SELECT a, min(b) c FROM r GROUP BY a) ON a = doc_id"""

# crc32 by a table of 256 remainders; words in one byte a letter, as edits are counted in bytes
_ONE_BYTE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#$%&()*+,-./:;<=>?@[]^_{|}~"
_LATIN = "".join(map(chr, range(0xC0, 0x100)))
OP11 = f"""WITH RECURSIVE k AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) crc),
g AS (SELECT id, run, count(*) c FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), {_LOWER}) run FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
b AS (SELECT *, list_transform(range(octet_length(encode(id || ':' || run))), lambda i: CAST('0x' || substr(hex(encode(id || ':' || run)), 2 * i + 1, 2) AS BIGINT)) bytes FROM g),
h AS (SELECT run, c, xor(list_reduce(list_concat([4294967295], bytes), lambda r, x: xor(r >> 8, crc[(xor(r, x) & 255) + 1])), 4294967295) h FROM b, k),
w AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END word, c FROM h) WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
v AS (SELECT word, word AS v FROM w UNION ALL SELECT word, unnest(list_transform(range(length(word)), lambda i: substr(word, 1, i) || substr(word, i + 2))) FROM w),
p AS MATERIALIZED (SELECT DISTINCT a.word x, b.word y FROM v a JOIN v b ON a.v = b.v AND a.word <> b.word WHERE levenshtein(translate(a.word, '{_LATIN}', '{_ONE_BYTE}'), translate(b.word, '{_LATIN}', '{_ONE_BYTE}')) = 1),
m AS (SELECT x, count(*) n_near, max(n) most FROM p JOIN w ON y = word GROUP BY x),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(m.n_near, 0) n_near, CASE WHEN m.most >= 5 * w.n THEN m.most END form_n, CASE WHEN m.most >= 5 * w.n THEN (SELECT min(y) FROM p JOIN w o ON p.y = o.word WHERE p.x = w.word AND o.n = m.most) END form FROM w LEFT JOIN m ON w.word = m.x),
t AS (SELECT word, word root, form following FROM f UNION ALL SELECT t.word, t.following, f.form FROM t JOIN f ON t.following = f.word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN t USING (word) WHERE following IS NULL"""

SQL: dict[str, str] = {"op4_warc": OP4, "op5_url_bloom": OP5, "op7_contamination": OP7, "op10_near": OP10, "op11_variants": OP11}
