"""DuckDB SQL for the operators that SQL can express."""

OP1 = r"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(concat_ws('|', 'mix-1', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM s),
w AS (SELECT *, CASE rnk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM r),
c AS (
  SELECT *, sum(source_size) OVER ()::HUGEINT AS words,
    coalesce(sum(source_size) OVER (ORDER BY source_size * 3 / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT * 3 AS spent,
    (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size * 3 / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::HUGEINT AS open
  FROM w),
f AS (
  SELECT *, bool_and(source_size::HUGEINT * 3 * open < weight * (words - spent)) OVER (ORDER BY source_size * 3 / weight, rnk) AS capped FROM c),
t AS (
  SELECT source, source_size,
    CASE WHEN capped THEN (source_size * 3)::DOUBLE
         ELSE (weight * (words - 3 * coalesce(sum(CASE WHEN capped THEN source_size END) OVER (), 0)))::DOUBLE
              / sum(CASE WHEN NOT capped THEN weight END) OVER () END AS target
  FROM f),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM t),
q AS (SELECT *, target - copies * source_size AS rest FROM p),
g AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
cum AS (
  SELECT g.source, g.h, g.words, q.rest, sum(g.words) OVER (PARTITION BY g.source ORDER BY g.h) AS upto
  FROM g JOIN q ON g.source IS NOT DISTINCT FROM q.source),
edge AS (
  SELECT source, min(h) AS h FROM cum WHERE upto > rest GROUP BY source),
till AS (
  SELECT e.source, CASE WHEN c.upto - c.rest < c.rest - (c.upto - c.words) THEN e.h + 1 ELSE e.h END AS h
  FROM edge e JOIN cum c ON c.source IS NOT DISTINCT FROM e.source AND c.h = e.h)
SELECT d.doc_id, d.size, q.source_size, q.target,
       ((q.copies + CASE WHEN d.h < coalesce(till.h, 0) THEN 1 ELSE 0 END) * d.size)::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
LEFT JOIN till ON d.source IS NOT DISTINCT FROM till.source
"""

OP3 = r"""
WITH l AS (
  SELECT doc_id, rid, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM (SELECT *, row_number() OVER () AS rid FROM documents)),
k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
gone AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines,
       count(gone.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE gone.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN gone ON k.key = gone.key
GROUP BY rid
"""

OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS sh
  FROM w WHERE len(ws) > 0),
c AS (SELECT min(doc_id) AS cid, count(*) AS mult, any_value(list_sort(sh)) AS sh FROM s GROUP BY list_sort(sh)),
m AS (SELECT s.doc_id, c.cid, c.mult FROM s JOIN c ON list_sort(s.sh) = c.sh),
x AS (SELECT cid, mult, len(sh) AS n, unnest(sh) AS g FROM c),
i AS (
  SELECT a.cid AS u, b.cid AS v, any_value(a.n) AS na, any_value(b.n) AS nb, any_value(b.mult) AS mv, count(*) AS k
  FROM x a JOIN x b ON a.g = b.g AND a.cid <> b.cid GROUP BY 1, 2),
l AS (SELECT u, v, mv FROM i WHERE k * 10 >= 8 * (na + nb - k)),
r AS (
  SELECT cid AS node, cid AS reach FROM c
  UNION SELECT r.node, l.v FROM r JOIN l ON l.u = r.reach),
t AS (SELECT node, min(reach) AS label FROM r GROUP BY node),
n AS (SELECT u, sum(mv) AS links FROM l GROUP BY u)
SELECT d.doc_id, coalesce(t.label, d.doc_id) AS class_id,
       coalesce(m.mult - 1 + coalesce(n.links, 0), 0)::BIGINT AS n_links,
       d.doc_id = coalesce(t.label, d.doc_id) AS kept
FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id LEFT JOIN t ON t.node = m.cid LEFT JOIN n ON n.u = m.cid
"""

OP7 = r"""
WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
l AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS reach FROM embeddings UNION SELECT r.node, l.v FROM r JOIN l ON l.u = r.reach),
t AS (SELECT node, min(reach) AS c FROM r GROUP BY node),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, t.c AS component_id, vec_id = t.c AS kept
FROM embeddings JOIN t ON t.node = vec_id LEFT JOIN n ON n.u = vec_id
"""

OP4 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (
  SELECT rid, i, md5(substr(h, 2 * i + 1, 400)) AS m
  FROM (SELECT rid, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d WHERE len(h) >= 400)),
s AS (SELECT rid, i FROM p WHERE m IN (SELECT m FROM p GROUP BY m HAVING count(*) > 1)),
n AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM s),
g AS (SELECT *, sum(new) OVER (PARTITION BY rid ORDER BY i) AS g FROM n),
r AS (SELECT rid, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY rid, g),
k AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS was FROM r),
t AS (
  SELECT d.rid, count(*) AS n_spans, sum(b - a) AS gone,
         string_agg(substr(h, 2 * was + 1, 2 * (a - was)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM d JOIN k ON d.rid = k.rid GROUP BY d.rid)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN t ON d.rid = t.rid
"""


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _op9() -> str:
    """Every template at every place of its first key phrase's first word."""
    from .licenses import BASE, COMMON, TEMPLATES

    rows = []
    for t in TEMPLATES:
        parts = t.text.split()
        keys = [(next(i for i in range(len(parts)) if parts[i : i + len(k.split())] == k.split()), k.split()) for k in t.key]
        stand = "[" + ", ".join(f"{{'at': {i}, 'words': {_list(k)}}}" for i, k in keys) + "]"
        rows.append(f"('{t.label}', {_list(parts)}, {stand}, '{keys[0][1][0]}', {keys[0][0]}, {min(2, len(set(parts) - COMMON))})")
    base = ", ".join(f"('{label}', {_list(phrase.split())})" for phrase, label in BASE.items())
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
x AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM d),
phrases AS (SELECT * FROM (VALUES {base}) v(label, words)),
b AS (
  SELECT x.rid, label, pos FROM x JOIN phrases ON x.word = words[1] JOIN d ON d.rid = x.rid WHERE w[pos + 1 : pos + len(words)] = words),
bs AS (SELECT rid, count(*) AS n, min(pos) AS lo, max(pos) AS hi, list_sort(list_distinct(list(label))) AS labels FROM b GROUP BY rid),
templates AS (SELECT * FROM (VALUES {", ".join(rows)}) v(label, parts, keys, opens, place, least)),
c AS (SELECT x.rid, label, parts, keys, least, pos - place AS off, w FROM x JOIN templates ON x.word = opens JOIN d ON d.rid = x.rid),
f AS (
  SELECT *, list_filter(generate_series(1, len(parts)), lambda j: off + j > 0 AND off + j <= len(w) AND w[greatest(off + j, 1)] = parts[j]) AS placed
  FROM c WHERE list_bool_and(list_transform(keys, lambda k: off + k['at'] >= 0 AND w[greatest(off + k['at'], 0) + 1 : off + k['at'] + len(k['words'])] = k['words']))),
m AS (
  SELECT rid, label, len(placed) / len(parts) AS share FROM f
  WHERE len(list_distinct(list_filter(list_transform(placed, lambda j: parts[j]), lambda v: NOT list_contains({_list(sorted(COMMON))}, v)))) >= least),
ms AS (SELECT rid, list(label) AS labels, max(share) AS share FROM m GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(bs.n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
       coalesce(array_to_string(bs.labels, ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(bs.labels, []), coalesce(ms.labels, [])))), ',') AS labels,
       CASE WHEN bs.n > 0 THEN 1.0 ELSE coalesce(ms.share, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN bs ON d.rid = bs.rid LEFT JOIN ms ON d.rid = ms.rid
"""


OP9 = _op9()
