"""DuckDB SQL of the queries that SQL can express on whole tables."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
#: Draw k of a document, as unit_hash gives it.
UNIT = "(('0x' || substring(md5((17 + k)::varchar || '|' || coalesce(doc_id::varchar, '~')), 1, 12))::bigint / 281474976710656.0::double)"

MIXING = f"""WITH sized AS (SELECT doc_id, source, len({WORDS})::bigint AS size FROM documents),
totals AS (SELECT source, sum(size)::bigint AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::int] AS weight, source_size * 2.0::double AS most, 1.5::double * sum(source_size) OVER () AS total FROM totals),
levels AS (SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::double)) / sum(weight) OVER (ORDER BY most / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
  row_number() OVER (ORDER BY most / weight, encode(source) NULLS LAST) AS place FROM weighed),
goal AS (SELECT source, source_size, CASE WHEN l IS NULL THEN most ELSE least(most, l * weight) END AS target FROM levels, (SELECT arg_min(level, place) FILTER (most > level * weight) AS l FROM levels)),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::double END AS rate FROM goal),
tries AS (SELECT source, k, abs(floor(rate) * source_size + sum(CASE WHEN u < rate - floor(rate) THEN size ELSE 0 END) - target) AS off FROM (SELECT r.source, r.source_size, r.target, r.rate, s.size, k, {UNIT} AS u FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source, range(0, 16) t(k)) GROUP BY source, k, source_size, target, rate),
drawn AS (SELECT source, arg_min(k, off * 1000.0 + k / 1000.0) AS k FROM tries GROUP BY source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN {UNIT} < rate - floor(rate) THEN 1 ELSE 0 END))::bigint AS taken
FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source JOIN drawn d ON s.source IS NOT DISTINCT FROM d.source"""

QUALITY = f"""WITH d AS (SELECT doc_id, source, md5(text) AS t, coalesce(text, '') AS text, {WORDS} AS w, row_number() OVER () AS r FROM documents),
voter AS (SELECT source, t, coalesce(min(doc_id), -1) AS v FROM d GROUP BY source, t),
lines AS (SELECT r, t, source, n, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS lw FROM (SELECT r, t, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM d)),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup FROM lines WHERE len(lw) > 0 GROUP BY r),
norm AS (SELECT r, t, source, lower(array_to_string(lw, ' ')) AS h, len(lw) AS k FROM lines WHERE len(lw) > 0),
hosts AS (SELECT source, count(DISTINCT v) AS docs FROM voter GROUP BY source),
often AS (SELECT n.source, h FROM norm n JOIN voter v ON n.source IS NOT DISTINCT FROM v.source AND n.t = v.t JOIN hosts o ON n.source IS NOT DISTINCT FROM o.source GROUP BY n.source, h, docs HAVING count(DISTINCT v) > greatest(50.0, 0.1 * docs)),
gone AS (SELECT r, sum(k)::bigint AS n FROM norm n WHERE EXISTS (SELECT 1 FROM often o WHERE o.h = n.h AND o.source IS NOT DISTINCT FROM n.source) GROUP BY r),
wins AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS c FROM wins) WHERE c > 1) GROUP BY r),
base AS (SELECT doc_id, len(w)::bigint AS n_words, length(array_to_string(w, ''))::bigint AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols, coalesce(n_dup, 0)::bigint AS n_dup_lines, coalesce(rep.n, 0)::bigint AS n_repeat_words, coalesce(gone.n, 0)::bigint AS n_removed
  FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_removed <= 70 * n_words AS kept FROM base"""

NEAR = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) WHEN len(w) = 1 THEN w ELSE [] END)) AS s FROM d),
cls AS (SELECT min(doc_id) AS rep, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
toks AS (SELECT rep, n, unnest(s) AS t FROM cls),
freq AS (SELECT t, count(*) AS f FROM toks GROUP BY t),
pre AS (SELECT rep, n, t FROM (SELECT rep, n, t, row_number() OVER (PARTITION BY rep ORDER BY f, t) AS k FROM toks JOIN freq USING (t)) WHERE k <= n - ceil(0.8 * n) + 1),
cand AS (SELECT DISTINCT a.rep AS x, b.rep AS y FROM pre a JOIN pre b ON a.t = b.t AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
link AS (SELECT x, y FROM (SELECT x, y, len(list_intersect(a.s, b.s)) AS i, a.n + b.n AS m FROM cand JOIN cls a ON a.rep = x JOIN cls b ON b.rep = y) WHERE 100 * i >= 80 * (m - i)),
reach AS (SELECT rep AS id, rep AS c FROM cls UNION SELECT CASE WHEN l.x = r.id THEN l.y ELSE l.x END, r.c FROM reach r JOIN link l ON r.id = l.x OR r.id = l.y),
comp AS (SELECT id, min(c) AS c FROM reach GROUP BY id)
SELECT doc_id, len(sets.s)::bigint AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept FROM sets LEFT JOIN cls ON sets.s = cls.s LEFT JOIN comp ON comp.id = cls.rep"""

FIXITY = r"""WITH n AS (SELECT chr(13) || chr(10) AS n),
r AS (SELECT page_id, md5(coalesce(page_id::varchar, '~') || '|' || coalesce(url, '')) AS u, coalesce(url, '') AS url, coalesce(html, '') AS body FROM pages),
i AS (SELECT *, '<urn:uuid:' || substring(u, 1, 8) || '-' || substring(u, 9, 4) || '-' || substring(u, 13, 4) || '-' || substring(u, 17, 4) || '-' || substring(u, 21, 12) || '>' AS id FROM r),
t AS (SELECT page_id, id, 'WARC/1.1' || n || 'WARC-Type: resource' || n || 'WARC-Record-ID: ' || id || n || 'WARC-Date: 2024-01-01T00:00:00Z' || n || 'WARC-Target-URI: ' || url || n || 'Content-Type: text/html' || n || 'Content-Length: ' || strlen(body) || n || n || body || n || n AS record FROM i, n),
o AS (SELECT page_id, id, sha256(record) AS sha256, strlen(record)::bigint AS length, ('0x' || substring(sha256(record), 1, 5))::bigint AS h, ('0x' || substring(md5(id), 1, 8))::bigint AS c FROM t),
f AS (SELECT *, coalesce(page_id // 512, -1 - h % 1048576) AS file, row_number() OVER (PARTITION BY page_id, sha256) - 1 AS copy FROM o),
p AS (SELECT *, CASE WHEN sum(length) OVER (PARTITION BY file) > 33554432 THEN ((h + copy) % ceil(sum(length) OVER (PARTITION BY file) / 16777216.0))::bigint ELSE 0 END AS part FROM f)
SELECT page_id, file, part, coalesce(sum(length) OVER w, 0)::bigint AS "offset", length, sha256, CASE WHEN c % 97 = 0 THEN 'missing' WHEN c % 89 = 0 THEN 'corrupt' ELSE 'ok' END AS status,
  CASE WHEN c % 97 <> 0 THEN coalesce(sum(CASE WHEN c % 97 <> 0 THEN length END) OVER w, 0)::bigint ELSE -1 END AS replica_offset
FROM p WINDOW w AS (PARTITION BY file, part ORDER BY page_id, sha256, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""

#: CRC-32 of the words of both tables once each, by its table of 256 entries, which the reversed polynomial gives.
IMPORTANCE = r"""WITH RECURSIVE bits AS (SELECT i, i AS c, 0 AS k FROM range(0, 256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
d AS (SELECT r, f, count(*) AS n FROM (SELECT r, unnest(w) AS f FROM w) GROUP BY r, f),
known AS (SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen(f) + 1), lambda i: ('0x' || substring(hex(encode(f)), 2 * i - 1, 2))::bigint)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) % 10000 AS b FROM (SELECT f FROM d UNION SELECT f FROM b), tab),
corpus AS (SELECT b, sum(n)::double AS s FROM d JOIN known USING (f) GROUP BY b),
target AS (SELECT b, count(*)::double AS t FROM b JOIN known USING (f) GROUP BY b),
sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM corpus) AS all_s, (SELECT coalesce(sum(t), 0) FROM target) AS all_t),
gain AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::bigint AS g FROM corpus LEFT JOIN target USING (b), sums),
weights AS (SELECT r, sum(n)::bigint AS n, floor(sum(n * g)::double / sum(n))::bigint AS weight FROM d JOIN known USING (f) JOIN gain USING (b) GROUP BY r),
scored AS (SELECT r, doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substring(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296.0::double)))::bigint AS score FROM w LEFT JOIN weights USING (r)),
ranks AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20 QUALIFY rank <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20))
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN ranks USING (r)"""

NEGATIVES = r"""WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label::bigint + 1) % 10 ELSE label::bigint END AS label, list_transform(embedding, lambda x: floor(256 * x::double)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, a.label AS l, r.id AS id, r.label AS label, list_dot_product(a.v, r.v)::bigint AS s FROM e a JOIN e r ON a.id % 100 = 0 AND a.id <> r.id),
p AS (SELECT a, id AS p, s AS ps FROM s WHERE label = l QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, id) <= 5),
n AS (SELECT p.a, p, ps, s.id AS n, s.s AS ns, row_number() OVER (PARTITION BY p.a, p ORDER BY s.s DESC, s.id) AS rank FROM p JOIN s ON s.a = p.a AND s.label <> s.l AND 80 * ps <= 100 * s.s AND s.s <= ps QUALIFY rank <= 5)
SELECT a AS anchor_id, p AS positive_id, rank::int AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n"""
