"""Loading raw delimited lines while setting apart those that cannot be read.

Blocks of lines go through Arrow's CSV parser. A block that it rejects, or that breaks the strict quoting rule, is halved
until the bad lines stand alone in blocks of a few lines; only those are read by the strict character-level reader,
which names the fault. Values are then checked on the JVM side as column expressions.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["row_num", "chrom", "start", "end", "kind", "length", "chrom2", "end2", "alt_seq", "rnames"]
BLOCK_LINES = 512
STRICT_LINES = 8

#: A line whose every field is bare without any quote, or quoted from its first to its last character.
_WELL_QUOTED = r'(?s)^(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*$'


def strict_fields(line: str) -> list[str] | None:
    """The fields of one line, or None if a quote stands where none may."""
    fields, at, n = [], 0, len(line)
    while True:
        if at < n and line[at] == '"':
            parts, at = [], at + 1
            while True:
                close = line.find('"', at)
                if close < 0:
                    return None
                parts.append(line[at:close])
                at = close + 1
                if at < n and line[at] == '"':
                    parts.append('"')
                    at += 1
                else:
                    break
            if at < n and line[at] != ",":
                return None
            fields.append("".join(parts))
        else:
            stop = line.find(",", at)
            stop = n if stop < 0 else stop
            bare = line[at:stop]
            if '"' in bare:
                return None
            fields.append(bare)
            at = stop
        if at >= n:
            return fields
        at += 1


def _parse_block(lines: pa.Array, names: list[str]) -> pa.Table | None:
    """The block as a table of strings if every line is sound, else None."""
    if lines.null_count or pc.any(pc.match_substring_regex(lines, "^$|[\r\n]")).as_py():
        return None
    quoted = pc.match_substring(lines, '"')
    if pc.any(quoted).as_py() and not pc.all(pc.match_substring_regex(lines.filter(quoted), _WELL_QUOTED)).as_py():
        return None
    raw = "\n".join(lines.to_pylist()).encode()
    try:
        table = pacsv.read_csv(
            io.BytesIO(raw + b"\n"),
            read_options=pacsv.ReadOptions(column_names=names, use_threads=False, block_size=max(len(raw) + 2, 1 << 10)),
            parse_options=pacsv.ParseOptions(newlines_in_values=False, ignore_empty_lines=False),
            convert_options=pacsv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=False),
        )
    except pa.ArrowInvalid:
        return None
    return table if table.num_rows == len(lines) else None


def parse_lines(lines: pa.Array, names: list[str]) -> tuple[list[pa.Array], pa.Array]:
    """Columns of all lines (null where a line failed) and the fault of each line: null, ``quoting`` or ``columns``."""
    pieces: list[pa.Table] = []
    faults: list[str | None] = []
    schema = pa.schema([(c, pa.string()) for c in names])

    def strictly(block: pa.Array) -> None:
        rows: list[list[str] | None] = []
        for line in block.to_pylist():
            fields = [] if line is None else strict_fields(line)
            ok = fields is not None and len(fields) == len(names)
            rows.append(fields if ok else None)
            faults.append(None if ok else "quoting" if fields is None else "columns")
        pieces.append(pa.table([pa.array([r[i] if r else None for r in rows], pa.string()) for i in range(len(names))], schema=schema))

    def visit(block: pa.Array) -> None:
        if not len(block):
            return
        if len(block) > STRICT_LINES:
            table = _parse_block(block, names)
            if table is None:
                half = len(block) // 2
                visit(block.slice(0, half))
                visit(block.slice(half))
            else:
                pieces.append(table.cast(schema))
                faults.extend([None] * table.num_rows)
            return
        table = _parse_block(block, names)
        if table is None:
            strictly(block)
        else:
            pieces.append(table.cast(schema))
            faults.extend([None] * table.num_rows)

    for at in range(0, len(lines), BLOCK_LINES):
        visit(lines.slice(at, BLOCK_LINES))
    if not pieces:
        return [pa.array([], pa.string()) for _ in names], pa.array([], pa.string())
    whole = pa.concat_tables(pieces).combine_chunks()
    columns = [c.chunk(0) if c.num_chunks else pa.array([], pa.string()) for c in whole.columns]
    return columns, pa.array(faults, pa.string())


def read_lines(df: DataFrame, line_col: str, id_cols: list[str], names: list[str]) -> DataFrame:
    """``id_cols``, then ``names`` as strings (an empty field is null), then ``fault``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, fault = parse_lines(batch.column(len(id_cols)).cast(pa.string()), names)
            columns = [pc.if_else(pc.equal(c, ""), pa.scalar(None, pa.string()), c) for c in columns]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(id_cols))], *columns, fault], names=[*id_cols, *names, "fault"])

    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in id_cols], *[f"`{c}` string" for c in names], "fault string"])
    return df.select(*id_cols, line_col).mapInArrow(run, schema)


def value_fault(contig_length: Column) -> Column:
    """The first impossible value of a parsed line, or null. ``contig_length`` is that of chrom2, null if undeclared."""
    bnd = F.col("kind").eqNullSafe("BND")
    digits = F.coalesce(F.col("end2").rlike(r"^[0-9]+\z"), F.lit(False))
    plain = F.regexp_replace(F.col("end2"), "^0+", "")
    position = F.when(digits & (F.length(plain) <= 18), F.expr("try_cast(regexp_replace(end2, '^0+', '') AS BIGINT)"))
    in_contig = F.coalesce((position >= 1) & (position <= contig_length), F.lit(False))
    return (
        F.when(F.when(bnd, contig_length.isNull()).otherwise(F.col("chrom2").isNotNull()), "chrom2")
        .when(F.when(bnd, ~in_contig).otherwise(F.col("end2").isNotNull()), "end2")
        .when(F.col("alt_seq").isNotNull() & (~F.col("kind").eqNullSafe("INS") | ~F.col("alt_seq").rlike(r"^[ACGTNacgtn*]+\z")), "alt_seq")
    )


def load_variant_lines(lines: DataFrame, contigs: DataFrame, line_col: str = "raw_line", id_cols: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """Every line with its ten fields and ``reason``: null for a valid line, else the first fault that applies.

    Reasons in order: ``quoting``, ``columns``, ``chrom2``, ``end2``, ``alt_seq``. A null or empty line has the wrong number
    of columns. An empty field, quoted or not, is null. A contig declared twice takes its greatest length. ``lines``
    may be empty and may have further columns of any name; repeated lines are each reported.
    """
    parsed = read_lines(lines, line_col, list(id_cols), COLUMNS)
    known = contigs.filter(F.col("chrom").isNotNull()).groupBy(F.col("chrom").alias("__chrom")).agg(F.max("contig_length").alias("__contig_length"))
    met = parsed.join(known, parsed["chrom2"] == known["__chrom"], "left")
    reason = F.coalesce(F.col("fault"), value_fault(F.col("__contig_length")))
    return met.select(*id_cols, *COLUMNS, reason.alias("reason"))


def valid_variants(loaded: DataFrame, id_cols: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """The valid lines with typed columns; a number that cannot be read as one is null."""
    typed = {"row_num": "BIGINT", "start": "INT", "end": "INT", "length": "INT", "end2": "INT"}
    return loaded.filter(F.col("reason").isNull()).select(
        *id_cols, *[F.expr(f"try_cast(`{c}` AS {typed[c]})").alias(c) if c in typed else F.col(c) for c in COLUMNS]
    )
