"""Reading structural variants from VCF files: strict typed records, the core table and inserted sequences.

A Python data source with one partition per file, since a record's number in its file is part of its identity.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from varweave import errors as E
from varweave.functions.exprs import BREAKENDS, digest56, is_seq
from varweave.schema import CORE, MAX_FILES, contig_check, with_merge_state
from varweave.sources.header import Header, read_header, scan

RAW = (
    "file string, contig string, pos int, ids array<string>, ref string, alts array<string>, qual float, filters array<string>, "
    "info array<struct<key:string,value:string>>, keys array<string>, samples array<array<string>>"
)
SCHEMA = f"vix_ix int, {CORE}, {RAW}"

_SEQ = re.compile(r"[ACGTNacgtn*]*\Z")
_MATES = [re.compile(pattern) for pattern, _, _ in BREAKENDS]


def mate_of(alt: str) -> tuple[str, int] | None:
    """Contig and position of a breakend allele's mate."""
    if alt[:1] in "[]" and alt or alt[-1:] in "[]" and alt:
        for pattern in _MATES:
            m = pattern.search(alt)
            if m:
                return m[1], int(m[2])
    return None


def _typed(value: str, kind: str) -> None:
    if value == ".":
        return
    if kind == "Integer":
        int(value)
    elif kind == "Float":
        float(value)
    elif kind == "Character" and len(value) != 1:
        raise ValueError(value)


def check_info(header: Header, info: list[tuple[str, str | None]]) -> None:
    """Every INFO value must be of its declared type; undeclared fields are text."""
    for key, value in info:
        number, kind = header.infos.get(key, (".", "String"))
        try:
            if kind == "Flag":
                if value is not None:
                    raise ValueError(value)
            elif value is None:
                if key in header.infos:
                    raise ValueError("no value")
            else:
                for v in value.split(",") if number != "1" else [value]:
                    _typed(v, kind)
        except ValueError as e:
            raise E.BadInfo(str(e), (f"INFO {key}",)) from None


def check_samples(header: Header, keys: list[str], samples: list[list[str]]) -> None:
    for name, values in zip(header.samples, samples):
        for key, value in zip(keys, values):
            number, kind = header.formats.get(key, (".", "String"))
            try:
                for v in value.split(",") if number != "1" else [value]:
                    _typed(v, kind)
            except ValueError as e:
                raise E.BadFormat(str(e), (f"sample {name}", f"FORMAT {key}")) from None


def as_text(info: dict[str, str | None], key: str) -> str | None:
    """A single text value; a list of one counts as one."""
    value = info.get(key)
    if value is not None and "," in value:
        raise E.BadInfoType(value, (f"INFO {key}",))
    return value


def as_int(info: dict[str, str | None], key: str) -> int | None:
    value = as_text(info, key)
    if value is None or value == ".":
        return None
    try:
        return int(value)
    except ValueError:
        raise E.BadNumber(value, (f"INFO {key}",)) from None


def kind_of(svtype: str | None, ref: str, alts: list[str]) -> str:
    if svtype:
        return svtype.split(":", 1)[0]
    if len(alts) == 1:
        alt = alts[0]
        if len(ref) == 1 and len(alt) > 1 and _SEQ.match(alt):
            return "INS"
        if len(ref) > 1 and len(alt) == 1 and _SEQ.match(alt):
            return "DEL"
        if mate_of(alt):
            return "BND"
    raise E.MissingType(",".join(alts))


def core_of(row_num: int, chrom: str, pos: int, ref: str, alts: list[str], info: dict[str, str | None], contigs: dict[str, int]) -> tuple:
    """The core row of one record."""
    if chrom not in contigs:
        raise E.BadChrom(chrom)
    kind = kind_of(as_text(info, "SVTYPE"), ref, alts)
    length, said_end = as_int(info, "SVLEN"), as_int(info, "END")
    if pos > 0:
        end = said_end if said_end is not None else pos + len(ref) - 1
    else:
        end = said_end if said_end is not None else pos + length if length is not None else 0
    if kind == "DEL" and length is not None:
        end = pos + abs(length)
    mate = mate_of(alts[0]) if alts else None
    chrom2, end2 = as_text(info, "CHR2"), None
    if chrom2 is not None and mate and mate[0] != chrom2:
        raise E.Chr2Mismatch(f"{chrom2} and {mate[0]}")
    if chrom2 is None and mate:
        chrom2 = mate[0]
    if kind == "BND":
        if chrom2 is None:
            raise E.MissingChr2()
        if mate is None:
            raise E.MissingAlt()
        end2 = mate[1]
    alt_seq = seq_hash = None
    if kind == "INS" and alts:
        if _SEQ.match(alts[0]):
            alt_seq = alts[0][1:]
            seq_hash = digest56(alt_seq)
        else:
            seq_hash = digest56(alts[0])
    return (row_num, contigs[chrom], chrom, pos, end, kind, length, contigs.get(chrom2) if chrom2 else None, chrom2, end2, alt_seq, seq_hash)


def parse_record(header: Header, contigs: dict[str, int], row_num: int, line: str) -> tuple:
    """Core and raw columns of one record line; every field is read by its declared type."""
    f = line.split("\t")
    if len(f) < 8 or (header.samples and len(f) != 9 + len(header.samples)):
        raise E.BadRecord(f"{len(f)} columns")
    chrom, pos_text, ref = f[0], f[1], f[3]
    try:
        pos = int(pos_text) if pos_text != "." else 0
        qual = None if f[5] == "." else float(f[5])
    except ValueError as e:
        raise E.BadNumber(str(e), (f"variant {chrom}:{pos_text}",)) from None
    try:
        ids = [] if f[2] == "." else f[2].split(";")
        alts = [] if f[4] == "." else f[4].split(",")
        filters = [] if f[6] == "." else f[6].split(";")
        pairs = [] if f[7] == "." else [tuple(x.split("=", 1)) if "=" in x else (x, None) for x in f[7].split(";") if x]
        keys = f[8].split(":") if len(f) > 8 else []
        samples = [x.split(":") for x in f[9:]]
        core = core_of(row_num, chrom, pos, ref, alts, dict(pairs), contigs)
        check_info(header, pairs)
        check_samples(header, keys, samples)
    except E.VariantError as e:
        raise e.within(f"variant {chrom}:{pos_text}") from None
    return (*core, chrom, pos, ids, ref, alts, qual, filters, pairs, keys, samples)


class _File(InputPartition):
    def __init__(self, vix_ix: int, path: str):
        super().__init__(vix_ix)
        self.vix_ix, self.path = vix_ix, path


class VcfReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [_File(i, p) for i, p in enumerate(self.paths)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        header, records = scan(partition.path)
        contigs = {c: i for i, c in enumerate(header.contigs)}
        for row_num, line in enumerate(records):
            try:
                row = parse_record(header, contigs, row_num, line)
            except E.VariantError as e:
                raise e.within(f"file {partition.path}") from None
            yield (partition.vix_ix, *row[:12], partition.path, *row[12:])


class VcfSource(DataSource):
    """``spark.read.format("sv_vcf").option("paths", "a.vcf,b.vcf.gz").load()``"""

    @classmethod
    def name(cls) -> str:
        return "sv_vcf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return VcfReader([p for p in self.options.get("paths", self.options.get("path", "")).split(",") if p])


def read_vcfs(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[Header]]:
    """All records of the files with merge state and raw columns, and the files' headers.

    At most 64 files, all with the same contigs in the same order. A file without records is allowed.
    """
    if not 1 <= len(paths) <= MAX_FILES:
        raise E.TooManyFiles(str(len(paths)))
    headers = [read_header(p) for p in paths]
    contig_check([h.contigs for h in headers])
    spark.dataSource.register(VcfSource)
    return with_merge_state(spark.read.format("sv_vcf").option("paths", ",".join(paths)).load()), headers


def info_value(key: str) -> Column:
    """The value of one INFO field of the raw columns, null if it is absent."""
    return F.try_element_at(F.transform(F.filter("info", lambda x: x["key"] == key), lambda x: x["value"]), F.lit(1))


def inserted_sequences(records: DataFrame, prefix: str = "VW") -> DataFrame:
    """(name, sequence) of insertions: the first allele longer than one base that is a sequence, else the first listed sequence.

    Named contig:position:id, with _ where there is no id. Records of other types and without a sequence are left out.
    """
    name = F.concat_ws(":", "contig", F.col("pos").cast("string"), F.coalesce(F.try_element_at("ids", F.lit(1)), F.lit("_")))
    allele = F.try_element_at(F.filter("alts", lambda a: (F.length(a) > 1) & is_seq(a)), F.lit(1))
    listed = F.split_part(info_value(f"{prefix}_ALT_SEQ"), F.lit(","), F.lit(1))
    return records.filter("kind = 'INS'").select(name.alias("name"), F.coalesce(allele, listed).alias("sequence")).filter("sequence IS NOT NULL")
