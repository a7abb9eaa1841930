"""DuckDB SQL of the queries over drifting schemas: headers taken apart by regular expressions, files compared by lag.

Renamed fields are paired by the order of their names within one description, which is the cheapest pairing wherever a
description has one field gone and one new. p5_wide has no SQL, since its columns depend on the data.
"""

from __future__ import annotations

QUOTED = r'''"(?:[^"\\]|\\.)*"'''
_FIELDS = rf"""
h AS (SELECT file_id, series, written_at, header, first_info FROM vcf_reader WHERE file_id IS NOT NULL AND series IS NOT NULL AND length(trim(header)) > 0),
hd AS (SELECT DISTINCT ON (series, file_id) * FROM h ORDER BY series, file_id, written_at),
ln AS (SELECT file_id, series, written_at, i, trim(line, ' ' || chr(9) || chr(13)) AS line FROM (SELECT file_id, series, written_at, unnest(string_split(header, chr(10))) AS line, generate_subscripts(string_split(header, chr(10)), 1) AS i FROM hd)),
la AS (SELECT *, regexp_extract(line, '^##(INFO|FORMAT)=<', 1) AS section, regexp_replace(regexp_replace(line, '(ID|Number|Type)\s*=\s*"([^"]*)"', '\1=\2', 'g'), '{QUOTED}', '', 'g') AS bare FROM ln WHERE regexp_matches(line, '^##(INFO|FORMAT)=<.*>$')),
fd AS (SELECT file_id, series, written_at, i, section, trim(regexp_extract(bare, '[<,]\s*ID\s*=([^,>]*)', 1)) AS id, trim(regexp_extract(bare, '[<,]\s*Number\s*=([^,>]*)', 1)) AS number,
  lower(trim(regexp_extract(bare, '[<,]\s*Type\s*=([^,>]*)', 1))) AS type, lower(regexp_replace(regexp_extract(line, 'Description\s*=\s*({QUOTED})', 1), '[^A-Za-z0-9]', '', 'g')) AS said FROM la),
f AS (SELECT DISTINCT ON (series, file_id, section, id) * FROM fd WHERE id <> '' ORDER BY series, file_id, section, id, i),
o AS (SELECT series, file_id, lag(file_id) OVER (PARTITION BY series ORDER BY written_at, file_id) AS before, row_number() OVER (PARTITION BY series ORDER BY written_at, file_id) AS n FROM hd),
gone AS (SELECT o.series, o.file_id, a.section, a.id, a.number, a.type, a.said FROM o JOIN f a ON a.series = o.series AND a.file_id = o.before
  WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.series = o.series AND b.file_id = o.file_id AND b.section = a.section AND b.id = a.id)),
new AS (SELECT o.series, o.file_id, b.section, b.id, b.number, b.type, b.said FROM o JOIN f b ON b.series = o.series AND b.file_id = o.file_id WHERE o.before IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM f a WHERE a.series = o.series AND a.file_id = o.before AND a.section = b.section AND a.id = b.id)),
ren AS (SELECT g.series, g.file_id, g.section, g.id AS was, n.id, g.number <> n.number OR g.type <> n.type AS retyped FROM
  (SELECT *, row_number() OVER (PARTITION BY file_id, series, section, said ORDER BY id) AS k FROM gone WHERE said <> '') g JOIN
  (SELECT *, row_number() OVER (PARTITION BY file_id, series, section, said ORDER BY id) AS k FROM new WHERE said <> '') n USING (series, file_id, section, said, k)),
kept AS (SELECT o.series, o.file_id, a.section, a.id, a.number <> b.number OR a.type <> b.type AS retyped FROM o JOIN f a ON a.series = o.series AND a.file_id = o.before
  JOIN f b ON b.series = o.series AND b.file_id = o.file_id AND b.section = a.section AND b.id = a.id)"""
P5_FOUND = f"""WITH {_FIELDS}
SELECT file_id, section, id AS field, 'renamed' AS change FROM ren UNION SELECT file_id, section, id, 'retyped' FROM ren WHERE retyped
UNION SELECT file_id, section, id, 'retyped' FROM kept WHERE retyped
UNION SELECT file_id, section, id, 'removed' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.series = g.series AND r.file_id = g.file_id AND r.section = g.section AND r.was = g.id)
UNION SELECT file_id, section, id, 'added' FROM new n WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE r.series = n.series AND r.file_id = n.file_id AND r.section = n.section AND r.id = n.id)"""
_TABLE = f"""WITH RECURSIVE {_FIELDS},
w AS (SELECT o.series, o.n, o.file_id, f.section, f.id, f.number, f.type FROM o JOIN f ON f.series = o.series AND f.file_id = o.file_id),
link AS MATERIALIZED (SELECT w.series, w.n, w.section, w.id, coalesce(r.was, k.id) AS was FROM w LEFT JOIN ren r ON r.series = w.series AND r.file_id = w.file_id AND r.section = w.section AND r.id = w.id
  LEFT JOIN kept k ON k.series = w.series AND k.file_id = w.file_id AND k.section = w.section AND k.id = w.id),
nm AS (SELECT series, n, section, id, id AS first FROM link WHERE was IS NULL
  UNION ALL SELECT l.series, l.n, l.section, l.id, nm.first FROM nm JOIN link l ON l.series = nm.series AND l.n = nm.n + 1 AND l.section = nm.section AND l.was = nm.id),
kv AS (SELECT series, file_id, unnest(string_split(first_info, ';')) AS pair FROM hd),
vs AS (SELECT series, file_id, split_part(pair, '=', 1) AS id, CASE WHEN contains(pair, '=') THEN substr(pair, strpos(pair, '=') + 1) ELSE '' END AS value FROM kv WHERE pair <> ''),
t AS (SELECT w.file_id, w.series, w.section, nm.first AS field, w.id AS declared, w.number, w.type, v.value,
  CASE WHEN type = 'flag' AND number = '0' THEN 'boolean' WHEN type = 'integer' AND number = '1' THEN 'bigint' WHEN type = 'float' AND number = '1' THEN 'double' ELSE 'string' END AS kind
  FROM w JOIN nm ON nm.series = w.series AND nm.n = w.n AND nm.section = w.section AND nm.id = w.id
  LEFT JOIN vs v ON w.section = 'INFO' AND v.series = w.series AND v.file_id = w.file_id AND v.id = w.id),
c AS (SELECT series, section, field, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) WHEN count(DISTINCT kind) = 2 AND min(kind) = 'bigint' AND max(kind) = 'double' THEN 'double' ELSE 'string' END AS common_type
  FROM t GROUP BY ALL),
p5 AS (SELECT t.* EXCLUDE (kind), common_type, CASE WHEN common_type = 'bigint' THEN TRY_CAST(value AS BIGINT) END AS value_int,
  CASE WHEN common_type = 'double' THEN TRY_CAST(value AS DOUBLE) END AS value_float, CASE WHEN common_type = 'boolean' THEN value IS NOT NULL END AS value_flag
  FROM t JOIN c USING (series, section, field))"""
P5_TABLE = f"{_TABLE} SELECT DISTINCT * FROM p5"
SQL = {"p5_found": P5_FOUND, "p5_table": P5_TABLE}
