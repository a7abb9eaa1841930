"""SQL with the same results as the queries of this package, for those that SQL can express."""

P1_FOUND = """
WITH a AS (
  SELECT DISTINCT row_id, vix_ix, chrom_id, least(start, "end") AS lo, greatest(start, "end") AS hi,
    coalesce(abs(CAST(length AS BIGINT)), greatest(start, "end") - least(start, "end")) AS len,
    CASE WHEN k IN ('ins', 'insertion') THEN 'INS' WHEN k IN ('del', 'deletion') THEN 'DEL'
         WHEN k IN ('dup', 'duplication') THEN 'DUP' WHEN k IN ('inv', 'inversion') THEN 'INV' END AS type
  FROM (SELECT *, lower(trim(split_part(regexp_replace(kind, '[<>\\s]', '', 'g'), ':', 1))) AS k FROM approx))
SELECT l.row_id AS lhs_row_id, r.row_id AS rhs_row_id
FROM a l JOIN a r ON l.chrom_id = r.chrom_id AND l.type = r.type AND l.row_id < r.row_id AND l.vix_ix <> r.vix_ix
  AND abs(l.lo - r.lo) <= 25 AND abs(l.hi - r.hi) <= 25
  AND (abs(l.len - r.len) <= 25 OR least(l.len, r.len) * 10 >= greatest(l.len, r.len) * 9)
"""

_MEMBERS = """
WITH m AS (
  SELECT DISTINCT regexp_replace(variant_id, '^[ \\t]+|[ \\t]+$', '', 'g') AS variant_id, row_id, vix_ix, called_at,
    CASE WHEN regexp_full_match(alt_seq, '[ACGTNacgtn]+') THEN length(regexp_replace(alt_seq, '[Nn]', '', 'g')) ELSE 0 END AS ws,
    coalesce((SELECT count(DISTINCT w) FROM (SELECT unnest(regexp_split_to_array(lower(criteria), '[^a-z0-9]+')) AS w)
              WHERE w IN ('exact', 'locus', 'here', 'there', 'near')), 0) AS wc
  FROM merge_rows WHERE variant_id IS NOT NULL)
"""

P2_FOUND = f"""{_MEMBERS}
SELECT variant_id, field, row_id FROM (
  SELECT variant_id, 'alt_seq' AS field, row_id, row_number() OVER
    (PARTITION BY variant_id ORDER BY ws DESC, called_at DESC NULLS LAST, vix_ix, row_id) AS n FROM m WHERE ws > 0
  UNION ALL
  SELECT variant_id, 'criteria', row_id, row_number() OVER
    (PARTITION BY variant_id ORDER BY wc DESC, called_at DESC NULLS LAST, vix_ix, row_id) FROM m WHERE wc > 0)
WHERE n = 1
"""

# A member's layer is the length of the longest chain of members above it, each dominating the next.
P2_MERGED = """
WITH RECURSIVE m0 AS (SELECT DISTINCT regexp_replace(variant_id, '^[ \\t]+|[ \\t]+$', '', 'g') AS variant_id, row_id, vix_ix, alt_seq, criteria, kind, chrom, start, length, called_at,
    CASE WHEN regexp_full_match(alt_seq, '[ACGTNacgtn]+') THEN length(regexp_replace(alt_seq, '[Nn]', '', 'g')) ELSE 0 END AS ws,
    coalesce((SELECT count(DISTINCT w) FROM (SELECT unnest(regexp_split_to_array(lower(criteria), '[^a-z0-9]+')) AS w)
              WHERE w IN ('exact', 'locus', 'here', 'there', 'near')), 0) AS wc, coalesce(epoch_us(called_at), -4611686018427387904) AS rec
  FROM merge_rows WHERE variant_id IS NOT NULL),
m AS MATERIALIZED (SELECT *, row_number() OVER () AS id FROM m0),
d AS MATERIALIZED (SELECT a.id AS above, b.id AS below FROM m a JOIN m b ON a.variant_id = b.variant_id AND a.ws >= b.ws AND a.wc >= b.wc AND a.rec >= b.rec
    AND (a.vix_ix < b.vix_ix OR a.vix_ix = b.vix_ix AND a.row_id <= b.row_id)
    AND NOT (a.ws = b.ws AND a.wc = b.wc AND a.rec = b.rec AND a.vix_ix = b.vix_ix AND a.row_id = b.row_id)),
c AS (SELECT id, 1 AS n FROM m UNION SELECT d.below, c.n + 1 FROM c JOIN d ON d.above = c.id),
l AS (SELECT id, max(n) AS layer FROM c GROUP BY id),
x AS (SELECT m.*, layer, ROW(-layer, ws + wc, rec, -vix_ix, -row_id) AS policy FROM m JOIN l USING (id))
SELECT variant_id, arg_max(alt_seq, ROW(ws, rec, -vix_ix, -row_id)) FILTER (WHERE ws > 0) AS alt_seq, arg_max(criteria, ROW(wc, rec, -vix_ix, -row_id)) FILTER (WHERE wc > 0) AS criteria,
  arg_max(kind, policy) FILTER (WHERE kind IS NOT NULL) AS kind, arg_max(chrom, policy) FILTER (WHERE chrom IS NOT NULL) AS chrom,
  arg_max(start, policy) FILTER (WHERE start IS NOT NULL) AS start, arg_max(length, policy) FILTER (WHERE length IS NOT NULL) AS length,
  arg_max(called_at, policy) FILTER (WHERE called_at IS NOT NULL) AS called_at,
  CAST(greatest(1, min(layer) FILTER (WHERE kind IS NOT NULL), min(layer) FILTER (WHERE chrom IS NOT NULL), min(layer) FILTER (WHERE start IS NOT NULL),
    min(layer) FILTER (WHERE length IS NOT NULL), min(layer) FILTER (WHERE called_at IS NOT NULL)) AS INTEGER) AS n_layers
FROM x GROUP BY variant_id
"""

P4_FOUND = """
WITH RECURSIVE e AS (
  SELECT DISTINCT lhs_row_key AS u, rhs_row_key AS v FROM union_pairs WHERE lhs_row_key IS NOT NULL AND rhs_row_key IS NOT NULL
  UNION SELECT rhs_row_key, lhs_row_key FROM union_pairs WHERE lhs_row_key IS NOT NULL AND rhs_row_key IS NOT NULL),
r AS (
  SELECT u AS k, u AS g FROM e
  UNION
  SELECT e.v, r.g FROM r JOIN e ON e.u = r.k WHERE r.g < e.v)
SELECT k AS row_key, min(g) AS new_row_key FROM r GROUP BY k
"""

SQL = {"p1_found": P1_FOUND, "p2_found": P2_FOUND, "p2_merged": P2_MERGED, "p4_found": P4_FOUND}
