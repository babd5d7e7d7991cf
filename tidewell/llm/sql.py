"""DuckDB SQL for the queries that SQL can express."""

from . import quality as q
from .sharding import RUN

_ROUND = "('0x' || substr(md5('0/{i}/' || {half}), 1, 13))::BIGINT"

SHARDING = rf"""
WITH RECURSIVE table256 AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS c FROM range(256) r(n))
), sized AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) + 16 AS BIGINT) AS size,
    xor(list_reduce(
      list_transform(range(coalesce(strlen(text), 0)), lambda i: ('0x' || substr(hex(encode(coalesce(text, ''))), 2 * i + 1, 2))::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
  FROM documents, table256
), runs AS (
  SELECT *, (row_number() OVER (PARTITION BY doc_id, size, text_crc32) - 1) // {RUN} AS run FROM sized
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(30)) || chr(31) || size || chr(31) || text_crc32 || chr(31) || run), 1, 3))::BIGINT,
    doc_id NULLS FIRST, size, text_crc32, run) - 1 AS r, count(*) OVER () AS n FROM runs
), parts AS (
  SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS a, CAST((n + ceil(sqrt(n)) - 1) AS BIGINT) // CAST(ceil(sqrt(n)) AS BIGINT) AS b FROM numbered
), walk AS (
  SELECT *, 0 AS step, r % a AS low, r // a AS high FROM parts
  UNION ALL
  SELECT doc_id, size, text_crc32, run, r, n, a, b, step + 1,
    CASE WHEN step % 2 = 0 THEN (low + {_ROUND.format(i="' || (step % 4) || '", half="high")}) % a ELSE low END,
    CASE WHEN step % 2 = 1 THEN (high + {_ROUND.format(i="' || (step % 4) || '", half="low")}) % b ELSE high END
  FROM walk WHERE step < 4 OR step % 4 <> 0 OR high * a + low >= n
), placed AS (
  SELECT *, high * a + low AS place FROM walk WHERE step > 0 AND step % 4 = 0 AND high * a + low < n
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place % 40 AS INTEGER) AS shard, CAST(place // 40 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""

_ESC = r"regexp_replace(coalesce({x}, ''), '([<\[])(\\*)(/?s>|/?INST\]|/?SYS\]|ROLE\])', '\1\\\2\3', 'g')"

CHAT = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
  SELECT *, length({_ESC.format(x="text")}) + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 17 + length({_ESC.format(x="role")}) END AS n FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


def _bucket(v: str) -> str:
    return f"(length(bin({v})) * {1 << q.BITS} + ({v} >> greatest(length(bin({v})) - {q.BITS}, 0)))"


def _quartiles(name: str, source: str, groups: str) -> str:
    by = f"{groups}, " if groups else ""
    floor = f"((bucket % {1 << q.BITS}) << greatest(bucket // {1 << q.BITS} - {q.BITS}, 0))"
    return f"""{name} AS (
  SELECT {by}measure, {", ".join(f"min({floor}) FILTER (upto * 4 >= total * {k}) AS q{k}" for k in (1, 2, 3))}, max(total) AS total
  FROM (SELECT *, sum(n) OVER (PARTITION BY {by}measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}measure) AS total
        FROM (SELECT {by}measure, bucket, sum(n) AS n FROM {source} GROUP BY ALL)) GROUP BY ALL
)"""


_PICK = "CASE WHEN s.total >= {n} THEN s.q{k} WHEN l.total >= {n} THEN l.q{k} ELSE a.q{k} END"

QUALITY = rf"""
WITH tokens AS (
  SELECT doc_id, text, lang, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), spots AS (
  SELECT doc_id, unnest(range(1, greatest(len(w) - 1, 1))) AS pos, w FROM tokens WHERE len(w) >= 3
), repeated AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, w[pos], w[pos + 1], w[pos + 2]) AS k FROM spots) WHERE k > 1
), hit AS (
  SELECT doc_id, count(DISTINCT pos + j) AS n FROM repeated, range(3) r(j) GROUP BY doc_id
), lines AS (
  SELECT doc_id, sum(k - 1) AS n FROM (
    SELECT doc_id, line, count(*) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL) GROUP BY doc_id
), counts AS (
  SELECT t.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_repeat_words
  FROM tokens t LEFT JOIN lines USING (doc_id) LEFT JOIN hit USING (doc_id)
), ruled AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    {{'_tw_m_words': n_words, '_tw_m_word_len': word_chars * 1000 // greatest(n_words, 1), '_tw_m_symbols': n_symbols * 1000 // greatest(word_chars, 1),
      '_tw_m_dup_lines': n_dup_lines * 1000 // greatest(n_words, 1), '_tw_m_repeats': n_repeat_words * 1000 // greatest(n_words, 1)}} AS m
  FROM counts
), long AS (
  SELECT lang, source, measure, {_bucket("value")} AS bucket, 1 AS n FROM (
    {" UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, m.{m} AS value FROM ruled WHERE NOT base_failed" for m in q.MEASURES)})
), {_quartiles("own", "long", "lang, source")}, {_quartiles("by_lang", "long", "lang")}, {_quartiles("by_all", "long", "")},
picked AS (
  SELECT s.lang, s.source, measure, {", ".join(f"{_PICK.format(n=q.LEAST_ROWS, k=k)} AS q{k}" for k in (1, 2, 3))}
  FROM own s JOIN by_lang l USING (measure) JOIN by_all a USING (measure) WHERE s.lang IS NOT DISTINCT FROM l.lang
), wide AS (
  SELECT lang, source, {", ".join(f"max(q{k}) FILTER (measure = '{m}') AS {m}_q{k}" for m in q.MEASURES for k in (1, 2, 3))} FROM picked GROUP BY ALL
), limits AS (
  SELECT lang, source, {", ".join(f"{limit.replace(' div ', ' // ')} AS {m}_limit" for m, limit in q.LIMITS.items())} FROM wide
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce({" OR ".join(f"m.{m} {'<' if s < 0 else '>'} {m}_limit" for m, s in q.MEASURES.items())}, false) AS kept
FROM ruled r LEFT JOIN limits t ON r.lang IS NOT DISTINCT FROM t.lang AND r.source IS NOT DISTINCT FROM t.source
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 13) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
spots AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, n, w, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, (SELECT DISTINCT n FROM b))
),
met AS (SELECT doc_id, item_id, i, s.n FROM spots s JOIN windows USING (win, n)),
hits AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM met, range(13) r(j) WHERE j < n GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

JACCARD = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 2], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS i FROM d)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)
"""

_POINT = "list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - c.v[i]) * (a.v[i] - c.v[i])))"


def _round(k: int) -> str:
    """Assignment to the centroids c{k} and their floors of means, c{k + 1}."""
    return f"""n{k} AS (SELECT r, vec_id, a.v, arg_min(c.c, (d, c.c)) AS cluster, min(d) AS distance FROM (SELECT a.*, c.c, {_POINT} AS d FROM kept a, c{k} c) a JOIN c{k} c USING (c) GROUP BY r, vec_id, a.v),
s{k} AS (SELECT cluster, i, sum(v[i]) AS s, count(*) AS n FROM n{k}, range(1, 65) t(i) GROUP BY cluster, i),
m{k} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{k} GROUP BY cluster),
c{k + 1} AS (SELECT c, coalesce(m{k}.v, c{k}.v) AS v FROM c{k} LEFT JOIN m{k} ON cluster = c)"""


PLANES = f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS INTEGER) AS c, v FROM kept ORDER BY sha256('1:' || vec_id) LIMIT 16),
{_round(0)},
{_round(1)},
{_round(2)},
{_round(3)}
SELECT vec_id, cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM n3 JOIN c3 ON c = cluster
"""


def urls(rules: list[tuple[str, str, str]], listed_host: str, thin: int) -> str:
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    return rf"""
WITH u AS (
  SELECT page_id, html, CASE WHEN spot > 0 THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN spot > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM (SELECT page_id, html, coalesce(instr(url, '://'), 0) AS spot, substr(url, instr(url, '://') + 3) AS rest FROM pages)
), rules(verdict, h, p) AS (VALUES {values}),
ruled AS (
  SELECT page_id, h || p AS rule, verdict FROM (SELECT DISTINCT page_id, host, path FROM u) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  QUALIFY row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || p) DESC, length(h) DESC, h || p DESC) = 1
), hosts AS (
  SELECT DISTINCT coalesce(nullif(regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1), ''), host) AS d FROM u WHERE regexp_matches(host, '{listed_host}')
), thin AS (SELECT DISTINCT host, path FROM u WHERE host <> '' AND length(html) < {thin}),
l AS (SELECT u.*, EXISTS (SELECT 1 FROM hosts WHERE host = d OR ends_with(host, '.' || d)) OR EXISTS (SELECT 1 FROM thin t WHERE t.host = u.host AND t.path = u.path) AS listed FROM u)
SELECT l.page_id, host, path, rule, coalesce(verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM l LEFT JOIN ruled USING (page_id)
"""


INFILL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l, sha256('7:' || doc_id) AS h FROM documents
), k AS (
  SELECT *, len(l) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k
), p AS (
  SELECT *, coalesce(array_to_string(l[1:a], ''), '') AS prefix, coalesce(array_to_string(l[a + 1:b], ''), '') AS middle, coalesce(array_to_string(l[b + 1:], ''), '') AS suffix FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
