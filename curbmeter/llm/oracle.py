"""SQL with the same rows for the corpus queries that DuckDB can express."""

from __future__ import annotations

import corpus_pipeline
from curbmeter.llm.sharding import LIMIT
from curbmeter.llm.url_rules import LOWER, RULES, UPPER

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION = rf"""
WITH docs AS (SELECT row_number() OVER () AS rn, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
starts AS (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[s : s + n - 1], ' ') AS win FROM starts),
places AS (SELECT rn, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
hits AS (
  SELECT p.rn, p.s, p.n, i.item
  FROM (SELECT rn, n, s, array_to_string(w[s : s + n - 1], ' ') AS win FROM places) p JOIN windows i ON p.n = i.n AND p.win = i.win
),
covered AS (SELECT rn, count(DISTINCT x) AS n_hit FROM (SELECT rn, unnest(range(s, s + n)) AS x FROM hits) GROUP BY rn),
found AS (SELECT rn, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM hits GROUP BY rn)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN covered USING (rn) LEFT JOIN found USING (rn)
"""

SHARDS = f"""
WITH rows AS (
  SELECT row_number() OVER () AS rn, doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents
),
levels AS (SELECT rn, n_bytes, CAST(l AS INT) AS l, h >> (60 - CAST(l AS INT)) AS p FROM rows, range(0, 61) t(l)),
totals AS (SELECT l, p, CAST(sum(n_bytes) AS BIGINT) AS total FROM levels GROUP BY l, p),
fits AS (
  SELECT rn, l, p, total, row_number() OVER (PARTITION BY rn ORDER BY l) AS k
  FROM levels JOIN totals USING (l, p) WHERE total <= {LIMIT}
)
SELECT doc_id, n_bytes, CASE WHEN l = 0 THEN '' ELSE lpad(bin(p), l, '0') END AS shard, total AS shard_bytes
FROM rows JOIN fits USING (rn) WHERE k = 1
"""

_RULES = ", ".join(f"('{rule}', '{verdict}')" for rule, verdict in RULES)
URLS = f"""
WITH rests AS (
  SELECT row_number() OVER () AS rn, page_id,
    CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
),
urls AS (
  SELECT rn, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rests
),
rules AS (
  SELECT rule, verdict, substr(rule, 1, strpos(rule, '/') - 1) AS rule_host, substr(rule, strpos(rule, '/')) AS rule_path
  FROM (VALUES {_RULES}) t(rule, verdict)
),
fits AS (
  SELECT rn, rule, verdict, row_number() OVER (PARTITION BY rn ORDER BY length(rule) DESC, rule) AS k
  FROM urls JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM urls LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (rn)
"""

ARCHIVES = """
WITH rows AS (SELECT page_id, coalesce(html, '') AS body, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
kept AS (SELECT body, max(page_id) AS page FROM rows WHERE payload_bytes >= 1000 GROUP BY body)
SELECT page_id, payload_bytes, sha1(body) AS payload_digest,
  CASE WHEN page IS NOT NULL AND page_id IS DISTINCT FROM page THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM page THEN page END AS refers_to
FROM rows LEFT JOIN kept USING (body)
"""


def crc32(text: str) -> str:
    """The CRC-32 of the UTF-8 bytes of a SQL string, bit by bit."""
    byte = f"CAST('0x' || substr(hex(encode({text})), 2 * i - 1, 2) AS BIGINT)"
    bits = f"flatten(list_transform(range(1, strlen({text}) + 1), lambda i: [{byte}, 0, 0, 0, 0, 0, 0, 0]))"
    step = "xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), lambda a, x: {step}), 4294967295)"


RUNS = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    {crc32("CAST(doc_id AS VARCHAR)")} AS h
  FROM documents
),
places AS (SELECT *, len(w) AS n, CAST(h // 10 % greatest(len(w), 1) AS BIGINT) AS a, 3 + h // 10 % 8 AS k FROM texts),
planted AS (
  SELECT rn, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN
    list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // k) END]) ELSE w END AS w
  FROM places
),
words AS (SELECT rn, n, unnest(range(n)) AS i, unnest(w) AS word FROM planted),
pairs AS (SELECT x.rn, y.i, y.i - x.i AS q FROM words x JOIN words y ON x.rn = y.rn AND x.word = y.word AND x.i < y.i AND 4 * (y.i - x.i) <= x.n),
numbered AS (SELECT rn, q, i, i - row_number() OVER (PARTITION BY rn, q ORDER BY i) AS stretch FROM pairs),
matches AS (
  SELECT rn, q, min(i) - q AS s, max(i) - min(i) + 1 + q AS length FROM numbered GROUP BY rn, q, stretch
  HAVING max(i) - min(i) + 1 + q >= greatest(6, 4 * q)
),
runs AS (SELECT rn, s AS start, length, min(q) AS period FROM matches GROUP BY rn, s, length),
dropped AS (SELECT DISTINCT rn, unnest(range(start + period, start + length)) AS i FROM runs),
collapsed AS (SELECT rn, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN dropped USING (rn, i) GROUP BY rn),
listed AS (
  SELECT rn, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    arg_max(struct_pack(start, length, period), (length, -start, -period)) AS best
  FROM runs GROUP BY rn
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period,
  1000 * best.length // best.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM planted LEFT JOIN collapsed USING (rn) LEFT JOIN listed USING (rn)
"""

SPELLING = rf"""
WITH RECURSIVE found AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS w
  FROM documents
),
counted AS (SELECT id || ':' || w AS s, w, count(*) AS n FROM found WHERE length(w) >= 6 GROUP BY ALL),
hashed AS (SELECT w, n, {crc32("s")} AS h FROM counted),
spelled AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word, n FROM hashed
),
vocabulary AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelled WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest, length(word) AS l FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)),
near AS (
  SELECT x.word, y.word AS other FROM cuts x JOIN cuts y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT c.word, v.word FROM cuts c JOIN vocabulary v ON c.rest = v.word
  UNION SELECT v.word, c.word FROM cuts c JOIN vocabulary v ON c.rest = v.word
),
best AS (
  SELECT near.word, count(*) AS n_near, arg_min(other, (-v.n, other)) AS other, max(v.n) AS other_n
  FROM near JOIN vocabulary v ON v.word = other GROUP BY near.word
),
formed AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
  FROM vocabulary LEFT JOIN best USING (word)
),
chains AS (
  SELECT word, coalesce(form, word) AS root FROM formed
  UNION ALL SELECT chains.word, formed.form FROM chains JOIN formed ON formed.word = chains.root WHERE formed.form IS NOT NULL AND chains.root <> chains.word
)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, chains.root
FROM formed f JOIN chains USING (word) JOIN formed r ON r.word = chains.root WHERE r.form IS NULL
"""


def _level(k: int) -> str:
    """Discounted counts of the grams of one order, with the probability of each."""
    n = {i: f"count(*) FILTER (n = {i})" for i in range(1, 5)}
    cuts = ", ".join(f"greatest(0, {i} - {i + 1} * (n1 / (n1 + 2 * n2)) * n{i + 1} / n{i})" for i in range(1, 4))
    below = "JOIN p{0} b ON b.g = substr(c.g, 2)".format(k - 1) if k > 1 else "CROSS JOIN (SELECT 1.0::DOUBLE / (count(*) + 1) AS p FROM g1) b"
    return f"""
n{k} AS (SELECT {', '.join(f'CAST({n[i]} AS DOUBLE) AS n{i}' for i in n)} FROM g{k}),
d{k} AS (SELECT CASE WHEN least(n1, n2, n3, n4) > 0 THEN [{cuts}] ELSE [0.5, 1, 1.5] END AS d FROM n{k}),
c{k} AS (SELECT g, n, d[least(n, 3)] AS cut, substr(g, 1, {k - 1}) AS context FROM g{k}, d{k}),
w{k} AS (SELECT context, sum(n) AS total, sum(cut) AS mass FROM c{k} GROUP BY context),
p{k} AS MATERIALIZED (SELECT c.g, (c.n - c.cut) / w.total + w.mass / w.total * b.p AS p FROM c{k} c JOIN w{k} w USING (context) {below})"""


PERPLEXITY = rf"""
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS rn, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, regexp_extract_all(coalesce(text, ''), '(?s).') AS c
  FROM documents
),
lines AS (SELECT rn, line, count(*) AS n FROM (SELECT rn, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rn, line),
dups AS (SELECT rn, sum(n - 1) AS n_dup FROM lines GROUP BY rn),
windows AS (SELECT rn, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS win FROM texts),
repeated AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, win) AS k FROM windows) WHERE k > 1),
covered AS (SELECT rn, count(DISTINCT i + j) AS n_repeat FROM repeated, range(3) t(j) GROUP BY rn),
base AS (
  SELECT rn, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words
  FROM texts LEFT JOIN dups USING (rn) LEFT JOIN covered USING (rn)
),
padded AS (SELECT rn, list_concat([chr(57344), chr(57344), chr(57344)], c) AS c, len(c) AS n FROM texts),
grams AS MATERIALIZED (
  SELECT rn, g, count(*) AS n
  FROM (SELECT rn, unnest(list_transform(range(1, n + 1), lambda i: c[i] || c[i + 1] || c[i + 2] || c[i + 3])) AS g FROM padded) GROUP BY rn, g
),
g4 AS (SELECT g, CAST(sum(n) AS BIGINT) AS n FROM grams GROUP BY g),
g3 AS (SELECT substr(g, 2) AS g, count(*) AS n FROM g4 GROUP BY 1),
g2 AS (SELECT substr(g, 2) AS g, count(*) AS n FROM g3 GROUP BY 1),
g1 AS (SELECT substr(g, 2) AS g, count(*) AS n FROM g2 GROUP BY 1),
{','.join(_level(k) for k in range(1, 5))},
scored AS (SELECT rn, round(-sum(n * ln(p)) / sum(n), 9) AS x FROM grams JOIN p4 USING (g) GROUP BY rn),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base LEFT JOIN scored USING (rn)),
middle AS (SELECT lang, quantile_cont(x, 0.5) AS m FROM judged WHERE NOT base_failed GROUP BY lang),
spread AS (SELECT lang, quantile_cont(abs(x - m), 0.5) AS s FROM judged JOIN middle USING (lang) WHERE NOT base_failed GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(abs(x - m) <= greatest(4 * 1.4826 * s, 0.05 * m), false) AS kept
FROM judged LEFT JOIN middle USING (lang) LEFT JOIN spread USING (lang)
"""

ORACLE = {
    "op3_winnowing": CONTAMINATION,
    "op4_extendible_sharding": SHARDS,
    "op5_url_rules": URLS,
    "op7_warc_round_trip": ARCHIVES,
    "op11_periodic_runs": RUNS,
    "op12_spelling_variants": SPELLING,
    "op13_perplexity_rules": PERPLEXITY,
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
