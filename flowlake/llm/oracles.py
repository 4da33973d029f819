"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations


def pack_lengths(n_buckets: int, budget: int) -> str:
    """The dynamic program as one common table per number of buckets; texts of fewer than 2,048 words keep their length."""
    step = "(CASE WHEN n < 2048 THEN 1 ELSE CAST(pow(2, length(bin(n)) - 11) AS BIGINT) END)"
    layers = ["best1 AS (SELECT j, pad0j AS best, 0 AS split FROM cost WHERE i = 0)"]
    for k in range(2, n_buckets + 1):
        layers.append(f"best{k} AS (SELECT c.j, min(b.best + pad0j) AS best, arg_min(c.i, (b.best + pad0j) * 1000000 + c.i) AS split "
                      f"FROM cost c JOIN best{k - 1} b ON b.j = c.i WHERE c.i >= {k - 1} GROUP BY c.j)")
    chain, k_used = [], f"(SELECT least({n_buckets}, count(*)) FROM hist)"
    chain.append("ends0 AS (SELECT (SELECT count(*) FROM hist) AS j, " + k_used + " AS k)")
    for s in range(1, n_buckets):
        cases = " ".join(f"WHEN {k} THEN (SELECT split FROM best{k} b WHERE b.j = e.j)" for k in range(2, n_buckets + 1))
        chain.append(f"ends{s} AS (SELECT CASE k {cases} END AS j, k - 1 AS k FROM ends{s - 1} e WHERE k > 1)")
    ends = " UNION ALL ".join(f"SELECT j FROM ends{s}" for s in range(n_buckets))
    return f"""
WITH l AS (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n FROM documents),
q AS (SELECT doc_id, n, CAST(ceil(n / {step}) * {step} AS BIGINT) AS b FROM l),
hist AS (SELECT b, count(*) AS c, row_number() OVER (ORDER BY b) AS j FROM q GROUP BY b),
sums AS (SELECT j, b, sum(c) OVER (ORDER BY j) AS n, sum(c * b) OVER (ORDER BY j) AS t FROM hist
         UNION ALL SELECT 0, 0, 0, 0),
cost AS (SELECT lo.j AS i, hi.j AS j, CAST(hi.b * (hi.n - lo.n) - (hi.t - lo.t) AS BIGINT) AS pad0j
         FROM sums lo JOIN sums hi ON lo.j < hi.j),
{", ".join(layers)},
{", ".join(chain)},
bounds AS (SELECT h.b AS hi, coalesce(lag(h.b) OVER (ORDER BY h.b), -1) AS lo, row_number() OVER (ORDER BY h.b) AS bucket
           FROM hist h WHERE h.j IN ({ends})),
ranked AS (SELECT q.doc_id, q.n, x.bucket, x.hi,
                  row_number() OVER (PARTITION BY x.bucket ORDER BY md5(coalesce(CAST(q.doc_id AS VARCHAR), '')), q.n) - 1 AS r,
                  greatest(1, {budget} // greatest(x.hi, 1)) AS fit
           FROM q JOIN bounds x ON q.b > x.lo AND q.b <= x.hi)
SELECT doc_id, n AS n_tokens, CAST(bucket AS INTEGER) AS bucket, hi AS bucket_len, CAST(r // fit AS BIGINT) AS batch,
       CAST(r % fit AS BIGINT) AS slot FROM ranked
"""


NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
       ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
g AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(x, y) AS (SELECT a, b FROM g UNION SELECT r.x, g.b FROM r JOIN g ON r.y = g.a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m.y, s.doc_id)) AS component_id,
       s.doc_id = least(s.doc_id, coalesce(m.y, s.doc_id)) AS kept
FROM s LEFT JOIN (SELECT x, min(y) AS y FROM r GROUP BY x) m ON m.x = s.doc_id
"""

_ASSIGN = (r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
           r"[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)")
_KINDS = [("assign", _ASSIGN, 6), ("access", r"(AKIA[A-Z0-9]+)", 20), ("hex", r"([0-9a-f]+)", 24),
          ("pem", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1), ("forge", r"(gh[pousr]_[A-Za-z0-9]{36,})", 1)]


def _spans(at: int, kind: str, pattern: str, least: int) -> str:
    """All matches of one kind: gaps and matches in turn, whose summed lengths are the places."""
    return f"""
SELECT doc_id, {at} AS place, '{kind}' AS kind, CAST(list_sum(list_transform(full_[1:i], lambda x: length(x))) AS BIGINT) AS e,
       length(whole[i]) AS m FROM (
  SELECT doc_id, full_, whole, part, unnest(range(1, len(full_) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(body, '((?s:.*?))({pattern})', 0) AS full_,
           regexp_extract_all(body, '((?s:.*?))({pattern})', 2) AS whole,
           regexp_extract_all(body, '((?s:.*?))({pattern})', 3) AS part
    FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents))) WHERE length(part[i]) >= {least}"""


SECRET_SCAN = f"""
WITH m AS ({" UNION ALL ".join(_spans(i, *k) for i, k in enumerate(_KINDS))}),
t AS (SELECT doc_id, place, kind, e - m AS s, kind || ':' || (e - m) || ':' || e AS txt FROM m),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k,
             count(*) FILTER (kind = 'hex') AS h, string_agg(txt, ',' ORDER BY s, place) FILTER (place < 3) AS base,
             string_agg(txt, ',' ORDER BY s, place) AS spans FROM t GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS n, sha256(body) AS digest FROM p),
l AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS leader FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN leader = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN leader = page_id THEN NULL ELSE leader END AS refers_to, CAST(NULL AS VARCHAR) AS problem FROM l
"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""

FILL_IN_MIDDLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
                  sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
d AS (SELECT doc_id, body, u, CAST(len(u) AS BIGINT) AS n, list_transform(range(0, 4), lambda i: CAST('0x' || substr(h, CAST(8 * i + 1 AS INTEGER), 8) AS BIGINT)) AS x FROM t),
c AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
             CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') THEN 'plain'
                  WHEN x[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT doc_id, n, form, body, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid,
             coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM p
"""
