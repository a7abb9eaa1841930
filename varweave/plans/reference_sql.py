"""DuckDB SQL for the queries of ``reference_queries``, written from their definitions."""

from __future__ import annotations

_KIND = """CASE k WHEN 'INSERTION' THEN 'INS' WHEN 'DELETION' THEN 'DEL' WHEN 'DUPLICATION' THEN 'DUP'
  WHEN 'INVERSION' THEN 'INV' WHEN 'BREAKEND' THEN 'BND' ELSE k END"""
V = f"""v AS (SELECT DISTINCT row_num, chrom_id, chrom, start, "end", {_KIND} AS kind, length, chrom2_id, chrom2, end2, alt_seq, seq_hash,
  vix_ix, row_id, row_key, vix_set, vix_count, criteria
  FROM (SELECT *, upper(split_part(regexp_replace(kind, '[<>\\s]', '', 'g'), ':', 1)) AS k FROM approx))"""
G = f"""{V}, g AS (SELECT v.* EXCLUDE (row_key), m.row_key FROM v JOIN (SELECT row_id, min(row_key) AS row_key FROM merge_rows GROUP BY row_id) m USING (row_id))"""
P = f"""{G}, f AS (SELECT DISTINCT ON (row_key) row_key, start AS primary_start, "end" AS primary_end, end2 AS primary_end2, length AS primary_length
  FROM g ORDER BY row_key, vix_ix, row_id), p AS (SELECT g.*, f.* EXCLUDE (row_key) FROM g JOIN f USING (row_key))"""

_PAIR = """l.row_key AS lhs_row_key, l.vix_set AS lhs_vix_set, l.vix_count AS lhs_vix_count,
  r.row_key AS rhs_row_key, r.vix_set AS rhs_vix_set, r.vix_count AS rhs_vix_count"""
_DISJOINT = "l.row_id < r.row_id AND l.vix_set & r.vix_set = 0 AND l.vix_count < 64 AND r.vix_count < 64"
_LENGTHS = """coalesce(least(abs({a}), abs({b}))::DOUBLE / nullif(greatest(abs({a}), abs({b})), 0) >= 0.9, false)
  OR coalesce(greatest(abs({a}), abs({b})) - least(abs({a}), abs({b})) <= 25, false)"""


def _pairs(on: str) -> str:
    return f"WITH {V} SELECT {_PAIR} FROM v l JOIN v r ON {on}"


_EXACT = _pairs(
    f"""l.chrom_id = r.chrom_id AND l.start = r.start AND l."end" = r."end" AND l.kind = r.kind AND l.length = r.length AND l.kind <> 'BND'
  AND {_DISJOINT} AND (l.kind <> 'INS' OR l.seq_hash = r.seq_hash)"""
)


def _bnd(w: int, w2: int) -> str:
    return _pairs(
        f"""l.chrom_id = r.chrom_id AND l.chrom2_id = r.chrom2_id AND l.kind = 'BND' AND r.kind = 'BND' AND {_DISJOINT}
  AND l.row_key <> r.row_key AND abs(l."end" - r."end") < {w} AND abs(l.end2 - r.end2) < {w2}"""
    )


#: (name, sequence) of queries and features, and their k-mers on both strands.
SEQUENCES = f"""{V}, qs AS (SELECT lower(printf('%x', seq_hash)) AS name, min(alt_seq) AS sequence FROM v
  WHERE kind = 'INS' AND length(alt_seq) > 0 AND seq_hash IS NOT NULL GROUP BY 1),
fs AS (SELECT name, sequence, row_number() OVER (ORDER BY name) - 1 AS nix FROM (
  SELECT DISTINCT 'f' || row_key || '_' || substr(md5(upper(alt_seq)), 1, 12) AS name, upper(alt_seq) AS sequence FROM merge_rows
  WHERE regexp_full_match(alt_seq, '[ACGTNacgtn*]*') AND length(alt_seq) >= 11))"""


def _code(text: str) -> str:
    return f"list_reduce(list_transform(string_split(translate({text}, 'ACGTU', '01233'), ''), lambda c: CAST(c AS BIGINT)), lambda a, b: a * 4 + b)"


def kmers_of(source: str, out: str, k: int = 11) -> str:
    return f"""{out}_w AS (SELECT name, i, upper(substr(sequence, i, {k})) AS w FROM (SELECT name, sequence, unnest(range(1, length(sequence) - {k - 2})) AS i FROM {source})),
{out}_b AS (SELECT name, i, {_code("w")} AS kmer, {_code("reverse(translate(w, 'ACGTU', 'TGCAA'))")} AS rc FROM {out}_w WHERE regexp_full_match(w, '[ACGTU]{{{k}}}')),
{out} AS (SELECT name, '+' AS strand, kmer, count(*) AS count FROM {out}_b GROUP BY ALL UNION ALL SELECT name, '-', rc, count(*) FROM {out}_b GROUP BY ALL)"""


_Q = f"WITH {SEQUENCES}, {kmers_of('qs', 'q')}"
_QF = f"{_Q}, {kmers_of('fs', 's')}, qp AS (SELECT * FROM q WHERE strand = '+'), sp AS (SELECT * FROM s WHERE strand = '+')"
_RANK = f"""{_QF}, qm AS (SELECT name, strand, sqrt(sum(count * count)) AS m FROM q GROUP BY ALL), sm AS (SELECT name, sqrt(sum(count * count)) AS m FROM sp GROUP BY ALL),
d AS (SELECT q.name AS query_name, q.strand, sp.name, sum(q.count * sp.count) AS dot FROM q JOIN sp USING (kmer) GROUP BY ALL),
c AS (SELECT d.query_name, d.name, d.strand, dot / (qm.m * sm.m) AS score FROM d JOIN qm ON qm.name = d.query_name AND qm.strand = d.strand JOIN sm ON sm.name = d.name),
r AS (SELECT query_name, fs.nix, c.name, coalesce(max(score) FILTER (WHERE strand = '+'), 0.0) AS fwd, coalesce(max(score) FILTER (WHERE strand = '-'), 0.0) AS rev
  FROM c JOIN fs ON fs.name = c.name GROUP BY ALL)"""
_BEST = f"""{_RANK}, x AS (SELECT query_name, nix, name, '+' AS strand, fwd AS score FROM r UNION ALL SELECT query_name, nix, name, '-', rev FROM r),
best AS (SELECT DISTINCT ON (query_name) query_name, name AS class, strand, score FROM x ORDER BY query_name, score DESC, strand, nix)"""
_VID = """concat_ws('_', kind, chrom, start, "end", length, chrom2, end2, lower(printf('%x', seq_hash)))"""
_SIDE = "CASE WHEN (row_num >> {n}) & 1 = 1 THEN 'Before' ELSE 'After' END"
_ALLELES = f"""WITH {V}, b AS (SELECT *, {_SIDE.format(n=0)} AS side, {_SIDE.format(n=1)} AS side2 FROM v
  WHERE kind = 'BND' AND chrom2 IS NOT NULL AND end2 IS NOT NULL)"""


def _allele(side: str, side2: str, chrom: str, end: str, base: str) -> str:
    mark = f"CASE WHEN {side2} = 'After' THEN '[' ELSE ']' END"
    mate = f"{mark} || {chrom} || ':' || {end} || {mark}"
    return f"CASE WHEN {side} = 'Before' THEN {mate} || '{base}' ELSE '{base}' || {mate} END"


def report_columns(source: str) -> str:
    return f"""o AS (SELECT *, abs(start - primary_start) AS so, abs("end" - primary_end) AS eo, abs(end2 - primary_end2) AS e2 FROM {source}),
  report AS (SELECT row_id, so AS start_offset, eo AS end_offset, e2 AS end2_offset, CASE kind WHEN 'INS' THEN so WHEN 'BND' THEN so + e2 ELSE so + eo END AS total_offset,
  round(least(abs(length), abs(primary_length))::DOUBLE / nullif(greatest(abs(length), abs(primary_length)), 0) * 100) / 100 AS length_ratio,
  greatest(abs(length), abs(primary_length)) - least(abs(length), abs(primary_length)) AS length_difference, alt_seq FROM o)"""


def _hex_number(text: str) -> str:
    return f"list_reduce(list_transform(string_split({text}, ''), lambda c: CAST(strpos('0123456789abcdef', c) - 1 AS UHUGEINT)), lambda a, b: a * 16 + b)"


def _short_hash(text: str) -> str:
    """The first seven base 62 digits of the first 16 bytes of a text's SHA-256."""
    powers = ", ".join(f"CAST('{62**i}' AS UHUGEINT)" for i in range(21, -1, -1))
    digits = f"list_transform([{powers}], lambda p: substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', CAST(({_hex_number(f'substr(sha256({text}), 1, 32)')}) // p % 62 AS INTEGER) + 1, 1))"
    return f"left(ltrim(array_to_string({digits}, ''), '0'), 7)"


#: The rounds: criterion and the condition of its pairs, over the table as the rounds before left it.
_ROUNDS = [
    ("exact", f"""l.chrom_id = r.chrom_id AND l.start = r.start AND l."end" = r."end" AND l.kind = r.kind AND l.length = r.length AND l.kind <> 'BND'
      AND {_DISJOINT} AND (l.kind <> 'INS' OR l.seq_hash = r.seq_hash)"""),
    ("locus", f"""l.chrom_id = r.chrom_id AND l.start = r.start AND l."end" = r."end" AND l.kind = 'INS' AND r.kind = 'INS' AND {_DISJOINT}
      AND ({_LENGTHS.format(a="l.length", b="r.length")})"""),
    ("exact", f"""l.chrom_id = r.chrom_id AND l.start = r.start AND l."end" = r."end" AND l.kind = 'BND' AND r.kind = 'BND'
      AND l.chrom2_id = r.chrom2_id AND l.end2 = r.end2 AND {_DISJOINT}"""),
    *[(name, f"""l.chrom_id = r.chrom_id AND l.chrom2_id = r.chrom2_id AND l.kind = 'BND' AND r.kind = 'BND' AND {_DISJOINT}
      AND l.row_key <> r.row_key AND abs(l."end" - r."end") < {w} AND abs(l.end2 - r.end2) < {w2}""") for name, w, w2 in (("here", 25, 150), ("there", 150, 25))],
    ("near", f"""l.chrom_id = r.chrom_id AND l.kind = r.kind AND l.kind <> 'BND' AND l.row_id < r.row_id AND l.vix_count < 64 AND r.vix_count < 64
      AND l.row_key <> r.row_key AND l.vix_ix <> r.vix_ix AND abs(l.start - r.start) <= 25 AND abs(l."end" - r."end") <= 25
      AND ({_LENGTHS.format(a="coalesce(l.length, 0)", b="coalesce(r.length, 0)")})"""),
]


def _round(i: int, criterion: str, on: str, lower_wins: bool = False) -> str:
    """CTEs of one round, from t{i} to t{i+1}: the pairs, their linked groups, and in each the pairs folded in order.

    The state of a fold is a list of sets, each with root, rank, files and members; a pair whose sets are one or share a file
    leaves it as it is.
    """
    tie = "least(x.root, y.root)" if lower_wins else "x.root"

    def find(side: str) -> str:
        alone = f"{{'root': o.{side}_row_key, 'rank': 0, 'files': o.{side}_vix_set, 'members': [o.{side}_row_key]}}"
        return f"coalesce(list_filter(f.sets, lambda s: list_contains(s.members, o.{side}_row_key))[1], {alone})"

    merged = """{'root': CASE WHEN x.rank < y.rank THEN y.root WHEN x.rank > y.rank THEN x.root ELSE TIE END, 'rank': CASE WHEN x.rank = y.rank THEN x.rank + 1 ELSE greatest(x.rank, y.rank) END,
          'files': x.files | y.files, 'members': list_concat(x.members, y.members)}""".replace("TIE", tie)
    return f"""p{i} AS MATERIALIZED (SELECT DISTINCT {_PAIR} FROM t{i} l JOIN t{i} r ON {on}),
    e{i} AS MATERIALIZED (SELECT lhs_row_key AS u, rhs_row_key AS v FROM p{i} UNION SELECT rhs_row_key, lhs_row_key FROM p{i}),
    c{i} AS (SELECT u AS k, u AS g FROM e{i} UNION SELECT e.v, c.g FROM c{i} c JOIN e{i} e ON e.u = c.k WHERE c.g < e.v),
    k{i} AS MATERIALIZED (SELECT k, min(g) AS g FROM c{i} GROUP BY k),
    o{i} AS MATERIALIZED (SELECT p.*, g, row_number() OVER (PARTITION BY g ORDER BY lhs_vix_count + rhs_vix_count DESC, lhs_row_key, rhs_row_key) AS n FROM p{i} p JOIN k{i} ON k = lhs_row_key),
    f{i} AS (SELECT DISTINCT g, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(root BIGINT, rank INTEGER, files BIGINT, members BIGINT[])[]) AS sets FROM o{i} UNION ALL
      SELECT g, n, CASE WHEN x.root = y.root OR x.files & y.files <> 0 THEN sets
        ELSE list_append(list_filter(sets, lambda s: s.root <> x.root AND s.root <> y.root), {merged}) END
      FROM (SELECT f.g, o.n, f.sets, {find("lhs")} AS x, {find("rhs")} AS y FROM f{i} f JOIN o{i} o ON o.g = f.g AND o.n = f.n + 1)),
    s{i} AS MATERIALIZED (SELECT unnest(arg_max(sets, n)) AS s FROM f{i} GROUP BY g),
    u{i} AS MATERIALIZED (SELECT unnest(s.members) AS k, s.root AS root, s.files AS files, CAST(bit_count(s.files) AS INTEGER) AS files_count FROM s{i}),
    t{i + 1} AS MATERIALIZED (SELECT t.* REPLACE (coalesce(root, row_key) AS row_key, coalesce(files, vix_set) AS vix_set, coalesce(files_count, vix_count) AS vix_count,
      CASE WHEN root IS NULL THEN criteria WHEN criteria IS NULL OR criteria = '' THEN '{criterion}' ELSE criteria || ',{criterion}' END AS criteria)
      FROM t{i} t LEFT JOIN u{i} u ON u.k = t.row_key)"""


def _merge(rounds: int, lower_wins: bool = False) -> str:
    steps = ",\n    ".join(_round(i, *r, lower_wins) for i, r in enumerate(_ROUNDS[:rounds]))
    return f"WITH RECURSIVE {V}, t0 AS MATERIALIZED (SELECT * FROM v),\n    {steps}"


_MERGED = "row_id, row_key, vix_set, vix_count, criteria"

SQL = {
    "merge_round_exact": f"{_merge(1)} SELECT {_MERGED} FROM t1",
    "merge_round_lower": f"{_merge(1, True)} SELECT {_MERGED} FROM t1",
    "merge_all_rounds": f"{_merge(6)} SELECT {_MERGED} FROM t6",
    "merge_group_sizes": f"{_merge(6)}, z AS (SELECT row_key, count(*) AS members FROM t6 GROUP BY row_key) SELECT members, count(*) AS n_groups FROM z GROUP BY members",
    "base62": f"WITH {V} SELECT row_id, {_short_hash(_VID)} AS vid_hash FROM v",
    "variant_id": f"""WITH {G}, f AS (SELECT DISTINCT ON (row_key) row_key, kind, {_VID} AS vid FROM g ORDER BY row_key, vix_ix, row_id),
        n AS (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY row_key) - 1 AS rep FROM f),
        i AS (SELECT row_key, concat_ws('_', 'VW', kind, {_short_hash("concat_ws('_', vid, rep)")}) AS variant_id FROM n)
        SELECT row_id, g.row_key, variant_id FROM g JOIN i ON i.row_key = g.row_key""",
    "variant_core": f"WITH {V} SELECT * REPLACE (lower(printf('%x', seq_hash)) AS seq_hash), CAST(vix_ix + 100 * row_num AS BIGINT) AS encoded, vix_set = CASE WHEN vix_ix = 63 THEN -9223372036854775808 ELSE 1::BIGINT << vix_ix END AS bit_agrees FROM v",
    "union_files": f"""WITH {V} SELECT row_num, chrom_id, start, kind, CAST(vix_ix % 2 AS INTEGER) AS vix_ix, CAST(vix_ix % 2 + 100 * row_num AS BIGINT) AS row_id,
        CAST(vix_ix % 2 + 100 * row_num AS BIGINT) AS row_key, 1::BIGINT << (vix_ix % 2) AS vix_set, 1::INTEGER AS vix_count, NULL::VARCHAR AS criteria FROM v""",
    "contig_check": """WITH f AS (SELECT file_id, regexp_extract_all(header, '##contig=<ID=([^,>]+)', 1) AS names FROM vcf_reader WHERE contains(header, '##contig=<ID='))
        SELECT DISTINCT file_id, names = (SELECT arg_min(names, file_id) FROM f) AS agrees FROM f""",
    "row_key_encode_decode": f"WITH {V} SELECT row_id, CAST(row_id % 100 AS INTEGER) AS vix_ix, row_id // 100 AS row_num FROM v",
    "kind_filter": f"WITH {V} SELECT row_id, kind, vix_count FROM v WHERE kind <> 'BND' AND vix_count < 64",
    "exact_indel_pairs": _EXACT,
    "locus_ins_pairs": _pairs(f"""l.chrom_id = r.chrom_id AND l.start = r.start AND l."end" = r."end" AND l.kind = 'INS' AND r.kind = 'INS' AND {_DISJOINT}
        AND ({_LENGTHS.format(a="l.length", b="r.length")})"""),
    "exact_bnd_pairs": _pairs(f"""l.chrom_id = r.chrom_id AND l.start = r.start AND l."end" = r."end" AND l.kind = 'BND' AND r.kind = 'BND'
        AND l.chrom2_id = r.chrom2_id AND l.end2 = r.end2 AND {_DISJOINT}"""),
    "bnd_here_there_pairs": _bnd(25, 150),
    "bnd_there_here_pairs": _bnd(150, 25),
    "near_pairs": _pairs(f"""l.chrom_id = r.chrom_id AND l.kind = r.kind AND l.kind <> 'BND' AND l.row_id < r.row_id AND l.vix_count < 64 AND r.vix_count < 64
        AND l.row_key <> r.row_key AND l.vix_ix <> r.vix_ix AND abs(l.start - r.start) <= 25 AND abs(l."end" - r."end") <= 25
        AND ({_LENGTHS.format(a="coalesce(l.length, 0)", b="coalesce(r.length, 0)")})"""),
    "overlap_join": f"""WITH {V} SELECT l.row_id AS lhs_row_id, r.row_id AS rhs_row_id FROM v l JOIN v r ON l.chrom_id = r.chrom_id
        AND l.kind = 'DEL' AND r.kind = 'DUP' AND l.start <= r."end" + 1000000 AND r.start - 1000000 <= l."end" """,
    "nearest": f"""WITH {V}, k AS (SELECT DISTINCT start::BIGINT AS place FROM v WHERE kind = 'INS'), x AS (SELECT row_id, start::BIGINT AS x FROM v WHERE kind = 'BND'),
        lo AS (SELECT x.*, k.place AS below FROM x ASOF LEFT JOIN k ON x.x >= k.place), hi AS (SELECT lo.*, k.place AS above FROM lo ASOF LEFT JOIN k ON lo.x <= k.place)
        SELECT row_id, x, CASE WHEN below IS NULL THEN above WHEN above IS NULL THEN below WHEN above - x < x - below THEN above ELSE below END AS nearest FROM hi""",
    "within": f"""WITH {V}, k AS (SELECT DISTINCT start::BIGINT AS place FROM v WHERE kind = 'INS'), x AS (SELECT row_id, start::BIGINT AS x FROM v WHERE kind = 'BND')
        SELECT row_id, x, place AS near_key, CAST(row_number() OVER (PARTITION BY row_id, x ORDER BY abs(place - x), place) AS INTEGER) AS rank
        FROM x JOIN k ON place > x.x - 20000 AND place < x.x + 20000""",
    "pair_order": f"""SELECT *, row_number() OVER (ORDER BY lhs_vix_count + rhs_vix_count DESC, lhs_row_key, rhs_row_key) - 1 AS place
        FROM (SELECT DISTINCT * FROM ({_EXACT}))""",
    "breakend_pairing": f"""WITH {V}, b AS (SELECT row_id, vix_ix, chrom, "end", chrom2, end2 FROM v WHERE kind = 'BND'
          UNION ALL SELECT -row_id, vix_ix, chrom2, end2, chrom, "end" FROM v WHERE kind = 'BND' AND row_num % 3 = 0),
        t AS (SELECT *, concat_ws('_', chrom, "end", chrom2, end2) AS here, concat_ws('_', chrom2, end2, chrom, "end") AS there FROM b)
        SELECT row_id, EXISTS (SELECT 1 FROM t m WHERE m.vix_ix = t.vix_ix AND m.there = t.here) AS paired_bnd FROM t""",
    "primary_row": f"WITH {G} SELECT DISTINCT ON (row_key) row_key, row_id FROM g ORDER BY row_key, vix_ix, row_id",
    "primary_columns": f"WITH {P} SELECT row_id, row_key, primary_start, primary_end, primary_end2, primary_length FROM p",
    "report_offsets": f"WITH {P}, {report_columns('p')} SELECT * FROM report",
    "variant_id_text": f"WITH {V} SELECT row_id, {_VID} AS vid FROM v",
    "variant_id_rep": f"""WITH {G}, f AS (SELECT DISTINCT ON (row_key) row_key, kind, {_VID} AS vid FROM g ORDER BY row_key, vix_ix, row_id)
        SELECT *, CAST(row_number() OVER (PARTITION BY vid ORDER BY row_key) - 1 AS INTEGER) AS vid_rep FROM f""",
    "criteria_longest": f"""WITH {G} SELECT DISTINCT ON (row_key) row_key, count(*) OVER (PARTITION BY row_key) AS n_members, criteria FROM g
        ORDER BY row_key, length(coalesce(criteria, '')) DESC, vix_ix, row_id""",
    "alt_seq_list": f"WITH {G} SELECT row_key, coalesce(string_agg(alt_seq, ',' ORDER BY vix_ix, row_id), '') AS alt_seqs FROM g GROUP BY row_key",
    "qual_max": f"WITH {G} SELECT row_key, greatest(max((row_num % 1000 - 100) / 10.0), 0.0)::DOUBLE AS qual FROM g GROUP BY row_key",
    "filter_union": f"""WITH {G}, t AS (SELECT *, concat_ws('_', chrom, "end", chrom2, end2) AS here, concat_ws('_', chrom2, end2, chrom, "end") AS there FROM g),
        b AS (SELECT *, kind = 'BND' AND EXISTS (SELECT 1 FROM t m WHERE m.kind = 'BND' AND m.vix_ix = t.vix_ix AND m.there = t.here) AS paired FROM t),
        n AS (SELECT row_key, coalesce(criteria, 'PASS') AS f FROM b UNION SELECT row_key, 'UNPAIRED_BND' FROM b GROUP BY row_key
          HAVING coalesce(arg_min(kind, (vix_ix, row_id)) = 'BND', false) AND NOT bool_or(paired))
        SELECT row_key, string_agg(f, ';' ORDER BY f) AS filters FROM n GROUP BY row_key""",
    "paired_groups": f"""WITH {G}, t AS (SELECT *, concat_ws('_', chrom, "end", chrom2, end2) AS here, concat_ws('_', chrom2, end2, chrom, "end") AS there FROM g),
        b AS (SELECT *, coalesce(kind = 'BND', false) AND EXISTS (SELECT 1 FROM t m WHERE m.kind = 'BND' AND m.vix_ix = t.vix_ix AND m.there = t.here) AS paired FROM t)
        SELECT row_key, bool_or(paired) AS paired, coalesce(arg_max(kind || '+', (vix_ix, row_id)) FILTER (WHERE row_num % 3 = 0 AND kind <> ''), '') AS label FROM b GROUP BY row_key""",
    "output_order": f"WITH {P} SELECT row_id, row_number() OVER (ORDER BY chrom_id, primary_start, primary_end, row_key, row_id) - 1 AS place FROM p",
    "original_ids": f"WITH {G} SELECT row_key, string_agg('id' || row_id, ',' ORDER BY vix_ix, row_id) AS ids FROM g GROUP BY row_key",
    "merge_difference_summary": f"""WITH {G} SELECT row_key, kind, count(*) AS n_members, min(start) AS min_start, max(start) AS max_start, max(start) - min(start) AS delta_start,
        min("end") AS min_end, max("end") AS max_end, max("end") - min("end") AS delta_end, min(length) AS min_length, max(length) AS max_length,
        max(length) - min(length) AS delta_length FROM g GROUP BY row_key, kind""",
    "occurrence_number": f"WITH {V} SELECT row_id, CAST(row_number() OVER (PARTITION BY chrom_id, kind, start ORDER BY row_key) - 1 AS INTEGER) AS occurrence FROM v",
    "breakend_parse": f"""{_ALLELES}, t AS (SELECT row_id, {_allele("side", "side2", "chrom2", "end2", "N")} AS alt, chrom2, CAST(end2 AS BIGINT) AS end2, side, side2 FROM b)
        SELECT * FROM t""",
    "breakend_flip": f"""{_ALLELES} SELECT row_id, chrom2 AS chrom, end2 AS "end", {_allele("side2", "side", "chrom", '"end"', "A")} AS alt FROM b""",
    "is_seq": "SELECT DISTINCT row_id, alt_seq, CAST(regexp_full_match(alt_seq, '[ACGTNacgtn*]*') AS INTEGER) AS is_seq FROM merge_rows",
    "infer_kind": f"""WITH {V} SELECT row_id, CASE WHEN row_num % 2 = 0 AND kind IS NOT NULL THEN kind WHEN kind IN ('INS', 'DEL', 'BND') THEN
        CASE WHEN kind = 'INS' AND NOT regexp_full_match('A' || coalesce(alt_seq, 'CG'), '[ACGTNacgtn*]{{2,}}') THEN NULL ELSE kind END END AS kind FROM v""",
    "del_end_repair": f"""WITH {V} SELECT row_id, CASE WHEN kind = 'DEL' AND length IS NOT NULL THEN start + abs(length) ELSE "end" END AS "end" FROM v""",
    "pmin_pmax": f"""WITH {V} SELECT row_id, CASE WHEN length IS NOT NULL AND end2 IS NOT NULL THEN least(length, end2) END AS least,
        least(start, "end") AS lo, greatest(start, "end") AS hi FROM v""",
    "ifelse": f"WITH {V} SELECT row_id, CASE WHEN length < 0 THEN 'minus' WHEN length >= 0 THEN 'plus' END AS sign FROM v",
    "criteria_append": f"WITH {V} SELECT row_id, CASE WHEN criteria IS NULL OR criteria = '' THEN 'near' ELSE criteria || ',near' END AS criteria FROM v",
    "length_agrees": f"WITH {P} SELECT row_id, {_LENGTHS.format(a='length', b='primary_length')} AS agrees FROM p",
    "kmer_counts": f"{_Q} SELECT name, kmer, count FROM q WHERE strand = '+'",
    "kmer_counts_stranded": f"{_Q} SELECT * FROM q",
    "kmer_lists": f"{_Q} SELECT qs.name, coalesce(string_agg(kmer, ',' ORDER BY i), '') AS kmers FROM qs LEFT JOIN q_b ON q_b.name = qs.name GROUP BY qs.name",
    "kmer_positions": f"{_Q} SELECT name, kmer, rc AS rc_kmer, CAST(i + 9 AS INTEGER) AS last FROM q_b",
    "kmer_frequency_vector": f"""WITH {SEQUENCES}, {kmers_of("qs", "q", 3)}, a AS (SELECT name, c FROM qs, (SELECT unnest(range(64)) AS c)),
        n AS (SELECT name, kmer, sum(count) AS n FROM q GROUP BY ALL)
        SELECT a.name, string_agg(CAST(coalesce(n, 0) AS BIGINT), ',' ORDER BY c) AS freqs FROM a LEFT JOIN n ON n.name = a.name AND n.kmer = a.c GROUP BY a.name""",
    "kmer_revcomp": f"""{_Q} SELECT DISTINCT q_b.kmer, rc, {_code("reverse(w)")} AS reversed FROM q_b JOIN q_w USING (name, i)""",
    "kmer_hamming": f"""{_Q} SELECT DISTINCT kmer, CAST(list_sum(list_transform(range(11), lambda j: CASE WHEN (kmer >> (2 * j)) & 3 <> (rc >> (2 * j)) & 3 THEN 1 ELSE 0 END)) AS INTEGER) AS ham FROM q_b""",
    "kmer_text": f"{_Q} SELECT DISTINCT kmer, translate(w, 'U', 'T') AS bases FROM q_b JOIN q_w USING (name, i)",
    "kmer_longest": f"""WITH {SEQUENCES}, w AS (SELECT name, i, translate(upper(substr(sequence, i, 32)), 'U', 'T') AS w FROM (SELECT name, sequence, unnest(range(1, length(sequence) - 30)) AS i FROM qs))
        SELECT name, CAST(i + 30 AS INTEGER) AS last, w AS bases, reverse(translate(w, 'ACGT', 'TGCA')) AS rc_bases, true AS agrees FROM w WHERE regexp_full_match(w, '[ACGT]{{32}}')""",
    "kmer_distinct": f"{_Q} SELECT name, count(DISTINCT kmer) AS n_kmers FROM q GROUP BY name",
    "kmer_lists_reverse": f"{_Q} SELECT qs.name, coalesce(string_agg(rc, ',' ORDER BY i), '') AS kmers FROM qs LEFT JOIN q_b ON q_b.name = qs.name GROUP BY qs.name",
    "cosine_distance": f"""{_QF}, qm AS (SELECT name, sqrt(sum(count * count)) AS m FROM qp GROUP BY name), sm AS (SELECT name, sqrt(sum(count * count)) AS m FROM sp GROUP BY name),
        d AS (SELECT qp.name AS query_name, sp.name AS subject_name, CAST(sum(qp.count * sp.count) AS BIGINT) AS dot FROM qp JOIN sp USING (kmer) GROUP BY ALL)
        SELECT query_name, subject_name, dot AS distance_numerator, round(1.0 - dot / (qm.m * sm.m), 6) AS distance FROM d JOIN qm ON qm.name = query_name JOIN sm ON sm.name = subject_name""",
    "chi_squared_distance": f"""{_QF}, c AS (SELECT qp.name AS query_name, sp.name AS subject_name, sum((qp.count - sp.count) ** 2 / (qp.count + sp.count)) AS chi, count(*) AS shared
          FROM qp JOIN sp USING (kmer) GROUP BY ALL),
        qt AS (SELECT name, count(*) AS n, coalesce(sum(count) FILTER (WHERE kmer NOT IN (SELECT kmer FROM sp)), 0) AS missing FROM qp GROUP BY name),
        st AS (SELECT name, count(*) AS n, coalesce(sum(count) FILTER (WHERE kmer NOT IN (SELECT kmer FROM qp)), 0) AS missing FROM sp GROUP BY name)
        SELECT query_name, subject_name, round(0.5 * (chi + qt.missing + st.missing), 6)::DOUBLE AS chi_squared, qt.n + st.n - shared AS df
        FROM c JOIN qt ON qt.name = query_name JOIN st ON st.name = subject_name""",
    "feature_index": f"""WITH {SEQUENCES}, {kmers_of("fs", "s")}, m AS (SELECT name, sqrt(sum(count * count)) AS mags FROM s WHERE strand = '+' GROUP BY name)
        SELECT nix, fs.name, sequence, round(coalesce(mags, 0.0), 6) AS mags FROM fs LEFT JOIN m ON m.name = fs.name""",
    "feature_kmers": f"""WITH {SEQUENCES}, {kmers_of("fs", "s")} SELECT kmer, nix, CAST(count AS INTEGER) AS count FROM s JOIN fs ON fs.name = s.name WHERE strand = '+'""",
    "feature_rank": f"{_RANK} SELECT query_name, nix, name, round(fwd, 6) AS fwd, round(rev, 6) AS rev FROM r",
    "find_similar": f"""{_RANK} SELECT query_name, nix, name, CAST(row_number() OVER (PARTITION BY query_name
          ORDER BY greatest(CASE WHEN fwd >= 0.5 THEN fwd ELSE 0.0 END, CASE WHEN rev >= 0.5 THEN rev ELSE 0.0 END) DESC, nix) AS INTEGER) AS place, CASE WHEN fwd >= 0.5 THEN round(fwd, 6) ELSE 0.0 END AS fwd, CASE WHEN rev >= 0.5 THEN round(rev, 6) ELSE 0.0 END AS rev
        FROM r WHERE fwd >= 0.5 OR rev >= 0.5""",
    "best_classification": f"{_BEST} SELECT query_name, class, strand, round(1.0 - score, 6) AS distance FROM best WHERE score > 0.5",
    "attach_classification": f"""{_BEST}, ok AS (SELECT * FROM best WHERE score > 0.5)
        SELECT row_id, coalesce(class, '') AS class, coalesce(strand, '') AS strand FROM v LEFT JOIN ok ON ok.query_name = lower(printf('%x', seq_hash))""",
}
