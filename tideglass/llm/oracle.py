"""DuckDB texts for the operators that SQL can express."""

from __future__ import annotations

LETTERS = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def words(text: str) -> str:
    return rf"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def shingles(table: str, key: str) -> str:
    own = words(LETTERS.format("coalesce(text, '')"))
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM (SELECT {key}, {own} AS w FROM {table})"""


SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {words("coalesce(text, '')")} AS w FROM documents),
wd AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
win AS (SELECT doc_id, start, md5(array_to_string(w[start:start + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS start FROM d)),
late AS (SELECT doc_id, start FROM (SELECT *, min(struct_pack(d := doc_id, s := start)) OVER (PARTITION BY h) AS m FROM win) WHERE struct_pack(d := doc_id, s := start) > m),
gone AS (SELECT DISTINCT doc_id, start + o AS pos FROM late, range(20) t(o)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n FROM wd ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

LM_SCORE = f"""
WITH d AS (SELECT doc_id, {words("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS pos FROM d),
n AS (SELECT doc_id, pos, a, CASE WHEN pos >= 2 THEN concat(lag(a) OVER p, ' ', a) END AS b, CASE WHEN pos >= 3 THEN concat(lag(a, 2) OVER p, ' ', lag(a) OVER p, ' ', a) END AS c
  FROM g WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
k AS (SELECT doc_id, pos, b, c, count(*) OVER (PARTITION BY a) - count(*) OVER (PARTITION BY doc_id, a) AS ka, count(*) OVER (PARTITION BY b) - count(*) OVER (PARTITION BY doc_id, b) AS kb,
  count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY doc_id, c) AS kc, count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS rest FROM n),
s AS (SELECT doc_id, CASE WHEN c IS NOT NULL AND kc > 0 THEN ln(kc / lag(kb) OVER p) WHEN b IS NOT NULL AND kb > 0 THEN ln(kb / lag(ka) OVER p) + ln(0.4)
  ELSE ln(greatest(ka, 0.5) / greatest(rest, 1)) + 2 * ln(0.4) END AS s FROM k WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
t AS (SELECT doc_id, sum(s) AS s FROM s GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(s, 0.0), 6) AS log_score, CASE WHEN len(w) > 0 THEN round(s / len(w), 6) END AS mean_log_score FROM d LEFT JOIN t USING (doc_id)"""

REACH = """reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE i AS ({shingles("documents", "doc_id")}), q AS (SELECT doc_id, count(*) AS n FROM i GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM i x JOIN i y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
linked AS (SELECT a, b FROM pairs JOIN q x ON x.doc_id = a JOIN q y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
links AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked), nodes AS (SELECT doc_id AS id FROM documents),
{REACH}
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, id = component_id AS kept FROM comp LEFT JOIN q ON q.doc_id = id"""

EMBEDDING_DUPLICATES = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
  AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.9),
nodes AS (SELECT vec_id AS id FROM embeddings), deg AS (SELECT a, count(*) AS n FROM links GROUP BY a),
{REACH}
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM comp LEFT JOIN deg ON a = id"""

MIX_SOURCES = """
WITH st AS (SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM st) * w / (SELECT sum(w) FROM st) / n AS rate FROM st),
pmf AS (SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 20) AS BIGINT) + 1)) AS k FROM r)),
cdf AS (SELECT source, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf),
u AS (SELECT doc_id, source, (CAST('0x' || substr(md5('mix:' || doc_id || ':1'), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM documents),
n AS (SELECT doc_id, u.source, CAST(count(*) AS INTEGER) AS copies FROM u JOIN cdf ON cdf.source IS NOT DISTINCT FROM u.source AND c <= u GROUP BY doc_id, u.source)
SELECT d.*, copies, CAST(copy AS INTEGER) AS copy, md5('mix:' || doc_id || ':copy:' || copy) AS shuffle_key FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM n) JOIN documents d USING (doc_id)"""

DECONTAMINATE = f"""
WITH d AS ({shingles("documents", "doc_id")}), i AS ({shingles("benchmark", "item_id")}), q AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id)
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_shared, count(*) / n AS containment FROM d JOIN i USING (s) JOIN q USING (item_id) GROUP BY doc_id, item_id, n HAVING count(*) >= 0.75 * n"""

SHARD = """
WITH RECURSIVE tab AS (SELECT list(c ORDER BY x) AS t FROM (SELECT x, list_reduce(list_prepend(x, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(x))),
tx AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
crc AS (SELECT doc_id, octet_length(encode(text)) + 8 AS size, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
  lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) AS crc FROM tx, tab),
j AS (SELECT doc_id, CAST(doc_id AS HUGEINT) AS k, CAST(0 AS BIGINT) AS b FROM documents
  UNION ALL SELECT doc_id, k2, CAST(floor((b + 1) * (CAST(2147483648 AS DOUBLE) / CAST(k2 // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT doc_id, b, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM j WHERE b <= 24)),
s AS (SELECT doc_id, CAST(max(b) FILTER (WHERE b < 24) AS INTEGER) AS shard, CAST(max(b) FILTER (WHERE b < 25) AS INTEGER) AS grown_shard FROM j GROUP BY doc_id)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY (doc_id % 256 + crc) % 256, doc_id) - 1 AS slot, grown_shard FROM crc JOIN s USING (doc_id)"""

SQL = {
    "op1_substring_dedup": SUBSTRING_DEDUP, "op2_embedding_duplicates": EMBEDDING_DUPLICATES, "op3_lm_score": LM_SCORE, "op4_mix_sources": MIX_SOURCES, "op7_near_duplicates": NEAR_DUPLICATES,
    "op9_decontaminate": DECONTAMINATE, "op10_shard": SHARD,
}
