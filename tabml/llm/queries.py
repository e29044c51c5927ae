"""Registered queries of the subpackage, one per operator, and their DuckDB SQL.

Every query applies its operator with production parameters to its whole table; the
contract columns are derived from the operator's real outputs.
"""

from __future__ import annotations

import public_tokenizers

from . import centroids, chat, decontaminate, filter_audit, language, nearest, ngram_join, quality, secret_scan, sentencepieces, sharding, suffix_dedup, toxicity
from .frames import table

UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: The tokenizer of op4 and of the pipeline.
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_sharding(spark, sf_dir):
    return sharding.digest(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark, sf_dir):
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_sentencepiece(spark, sf_dir):
    return sentencepieces.digest(table(spark, sf_dir, "documents"), PIECES)


def op5_language(spark, sf_dir):
    return language.digest(table(spark, sf_dir, "documents"))


def op6_chat(spark, sf_dir):
    return chat.digest(table(spark, sf_dir, "conversations"))


def op7_quality(spark, sf_dir):
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_nearest(spark, sf_dir):
    return nearest.digest(table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark, sf_dir):
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_ngram_join(spark, sf_dir):
    return ngram_join.digest(table(spark, sf_dir, "documents"))


def op11_secrets(spark, sf_dir):
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op12_centroids(spark, sf_dir):
    return centroids.digest(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark, sf_dir):
    return filter_audit.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_language": op5_language,
    "op6_chat": op6_chat,
    "op7_quality": op7_quality,
    "op8_nearest": op8_nearest,
    "op9_toxicity": op9_toxicity,
    "op10_ngram_join": op10_ngram_join,
    "op11_secrets": op11_secrets,
    "op12_centroids": op12_centroids,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE = {}

ORACLE["op3_decontaminate"] = rf"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
spot AS (
  SELECT item_row, item_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS s
  FROM (SELECT row_number() OVER () AS item_row, item_id, w, least(len(w), 13) AS l,
               unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i
        FROM item WHERE len(w) > 0)),
win AS (SELECT DISTINCT item_id, l, s FROM spot),
doc AS (
  SELECT row_number() OVER () AS rid, doc_id,
    coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
word AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM doc),
ahead AS (
  SELECT rid, pos, list(word) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS f
  FROM word),
met AS (
  SELECT a.rid, a.pos, spot.l, spot.item_id, spot.item_row, spot.i
  FROM (SELECT rid, pos, lens.l, array_to_string(f[1:lens.l], ' ') AS s
        FROM ahead, (SELECT DISTINCT l FROM win) lens WHERE len(f) >= lens.l) a
  JOIN spot ON spot.l = a.l AND spot.s = a.s),
occ AS (SELECT DISTINCT rid, pos, l, item_id FROM met),
match AS (
  SELECT rid, CAST(item_id AS VARCHAR) AS item, min(pos) - 1 AS place, count(*) + max(l) - 1 AS n
  FROM (SELECT *, pos - row_number() OVER (PARTITION BY rid, item_row, pos - i ORDER BY pos) AS stretch FROM met)
  GROUP BY rid, item_row, item_id, pos - i, stretch),
best AS (
  SELECT rid, item, place, n
  FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY n DESC, place, item) AS k FROM match) WHERE k = 1),
hit AS (
  SELECT rid, count(DISTINCT p) AS n_hit
  FROM (SELECT rid, unnest(range(pos, pos + l)) AS p FROM (SELECT DISTINCT rid, pos, l FROM occ)) GROUP BY rid),
found AS (
  SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
  CAST(coalesce(n, 0) AS BIGINT) AS longest_words, item AS longest_item, CAST(place AS BIGINT) AS longest_at
FROM doc LEFT JOIN hit USING (rid) LEFT JOIN found USING (rid) LEFT JOIN best USING (rid)"""

ORACLE["op10_ngram_join"] = rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOW}'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
word AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM doc),
shingle AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, n, pos,
      array_to_string(list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING), ' ') AS s
    FROM word) WHERE pos <= greatest(n - 3, 1)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
link AS (
  SELECT x.a, x.b FROM (
    SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM shingle p JOIN shingle q ON p.s = q.s AND p.doc_id <> q.doc_id
    GROUP BY p.doc_id, q.doc_id) x
  JOIN size sa ON sa.doc_id = x.a JOIN size sb ON sb.doc_id = x.b
  WHERE 100 * x.c >= 85 * (sa.n + sb.n - x.c)),
reach AS (
  SELECT DISTINCT a, a AS b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS k FROM link GROUP BY a)
SELECT doc.doc_id, coalesce(size.n, 0) AS n_shingles, coalesce(comp.c, doc.doc_id) AS component_id, coalesce(degree.k, 0) AS n_links
FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN comp ON comp.a = doc.doc_id LEFT JOIN degree ON degree.a = doc.doc_id"""

ORACLE["op2_suffix_dedup"] = r"""
WITH doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w
  FROM (SELECT DISTINCT doc_id, text FROM documents)),
word AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM doc WHERE len(w) >= 50),
win AS (
  SELECT doc_id, pos, md5(array_to_string(f, ' ')) AS h
  FROM (SELECT doc_id, n, pos, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS f FROM word)
  WHERE pos + 50 <= n),
met AS (
  SELECT doc_id, pos, count(*) OVER (PARTITION BY h) AS c, row_number() OVER (PARTITION BY h ORDER BY doc_id NULLS LAST, pos) AS k
  FROM win),
part AS (
  SELECT DISTINCT doc_id, 'r' AS kind, unnest(range(pos, pos + 50)) AS p FROM met WHERE c > 1
  UNION ALL SELECT DISTINCT doc_id, 'c', unnest(range(pos, pos + 50)) FROM met WHERE k > 1),
island AS (
  SELECT doc_id, kind, min(p) AS a, max(p) + 1 AS z
  FROM (SELECT doc_id, kind, p, p - row_number() OVER (PARTITION BY doc_id, kind ORDER BY p) AS g FROM part)
  GROUP BY doc_id, kind, g)
SELECT doc_id, CAST(sum(z - a) FILTER (kind = 'r') AS BIGINT) AS n_repeated,
  CAST(coalesce(sum(z - a) FILTER (kind = 'c'), 0) AS BIGINT) AS n_cut,
  string_agg(a || '-' || z, ',' ORDER BY a) FILTER (kind = 'r') AS repeated_spans,
  coalesce(string_agg(a || '-' || z, ',' ORDER BY a) FILTER (kind = 'c'), '') AS cut_spans
FROM island GROUP BY doc_id"""


def _secret_sql() -> str:
    """Places from the lengths of the pieces between matches, rule by rule; the base rules as the contract states them."""
    rules = [("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
             ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24), *[(r.kind, r.pattern, r.group, r.least) for r in secret_scan.ADDED]]

    def quoted(x):
        return "'" + x.replace("'", "''") + "'"

    each = " UNION ALL ".join(
        f"""SELECT rid, {k} AS place, '{kind}' AS kind, len(m[i]) AS size, len(g[i]) AS kept,
          list_sum(list_transform(p[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS a
        FROM (SELECT rid, m, g, p, unnest(range(1, len(m) + 1)) AS i FROM (
          SELECT rid, regexp_extract_all(t, {quoted(pattern)}) AS m, regexp_extract_all(t, {quoted(pattern)}, {group}) AS g,
            string_split_regex(t, {quoted(pattern)}) AS p FROM doc WHERE regexp_matches(t, {quoted(pattern)})))"""
        for k, (kind, pattern, group, _) in enumerate(rules))
    least = " ".join(f"WHEN {k} THEN {n}" for k, (_, _, _, n) in enumerate(rules))
    base = ", ".join(f"'{r.kind}'" for r in secret_scan.BASE)
    return f"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
span AS (
  SELECT rid, place, kind, CAST(a AS BIGINT) AS a, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + size AS BIGINT) AS s
  FROM ({each}) WHERE kept >= CASE place {least} END),
found AS (
  SELECT rid, {', '.join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secret_scan.BASE)},
    string_agg(s, ',' ORDER BY a, place) FILTER (kind IN ({base})) AS b, string_agg(s, ',' ORDER BY a, place) AS spans
  FROM span GROUP BY rid)
SELECT doc_id, {', '.join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secret_scan.BASE)}, sha256(coalesce(b, '')) AS base_sha256,
  coalesce(spans, '') AS spans, sha256(t) AS blob_sha256
FROM doc LEFT JOIN found USING (rid)"""


ORACLE["op11_secrets"] = _secret_sql()

ORACLE["op13_filter_audit"] = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
mask AS (
  SELECT part,
    (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
      + 4 * (100 * len(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * len(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
      + 16 * coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)::INT AS m,
    (doc_id IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL))::INT AS good,
    (doc_id IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL))::INT AS toxic
  FROM doc),
cell AS (SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM mask GROUP BY ALL),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
orders AS (
  SELECT '' AS filter_order UNION ALL SELECT o.filter_order || f FROM orders o JOIN letter ON NOT contains(o.filter_order, f)),
steps AS (
  SELECT filter_order, CAST(s AS INT) AS step, filter_order[s] AS f FROM orders, range(1, 6) r(s) WHERE len(filter_order) = 5),
applied AS (
  SELECT x.filter_order, x.step, x.f, l.b, CAST(coalesce(sum(e.b), 0) AS INT) AS before
  FROM steps x JOIN letter l ON l.f = x.f LEFT JOIN letter e ON contains(left(x.filter_order, x.step - 1), e.f)
  GROUP BY ALL),
metric AS (
  SELECT part, filter_order, step, f,
    CAST(coalesce(sum(n) FILTER (m & (before | b) = 0), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (m & before = 0 AND m & b <> 0), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (m & before <> 0 AND m & b <> 0), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (m = b), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (m & before = 0 AND m & b <> 0), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(toxic) FILTER (m & before = 0 AND m & b <> 0), 0) AS BIGINT) AS toxic_lost
  FROM cell, applied GROUP BY part, filter_order, step, f)
SELECT * EXCLUDE (f), CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM metric"""


def _centroid_sql() -> str:
    """The rounds one after the other, centroids as rows of (centroid, component)."""
    def assigned(k):
        return f"""
d{k} AS (SELECT v.rid, c.j, sum((v.x - c.x) * (v.x - c.x)) AS d FROM flat v JOIN c{k} c ON c.i = v.i GROUP BY v.rid, c.j),
a{k} AS (SELECT rid, j, d FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY d, j) AS r FROM d{k}) WHERE r = 1)"""

    def moved(k):
        return f"""
s{k} AS (SELECT a.j, v.i, sum(v.x) AS s, count(*) AS n FROM a{k} a JOIN flat v USING (rid) GROUP BY a.j, v.i),
c{k + 1} AS (SELECT c.j, c.i, CAST(coalesce((s.s - ((s.s % s.n) + s.n) % s.n) // s.n, c.x) AS HUGEINT) AS x FROM c{k} c LEFT JOIN s{k} s USING (j, i))"""

    n = centroids.ROUNDS
    rounds = ",".join(assigned(k) + "," + moved(k) for k in range(n)) + "," + assigned(n)
    return f"""
WITH vec AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
flat AS (SELECT rid, CAST(floor(64 * x) AS HUGEINT) AS x, i FROM (SELECT rid, unnest(e) AS x, unnest(range(64)) AS i FROM vec)),
seed AS (SELECT rid, row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, e) - 1 AS j FROM vec QUALIFY j < 16),
c0 AS (SELECT j, i, x FROM seed JOIN flat USING (rid)),{rounds}
SELECT vec_id, CAST(a.j AS INT) AS cluster, CAST(a.d AS BIGINT) AS distance,
  CAST(sum(a.d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM a{n} a JOIN vec USING (rid)
JOIN (SELECT j, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{n} GROUP BY j) h ON h.j = a.j"""


ORACLE["op12_centroids"] = _centroid_sql()
