"""Reading FASTA files, and looking up single bases of a reference."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from varweave.sources.storage import open_text

CHUNK = 1 << 20


def read_records(path: str) -> Iterator[tuple[str, str]]:
    """(definition without its mark, sequence) of a plain or gzip file."""
    name, parts = None, []
    with open_text(path) as f:
        for line in f:
            line = line.strip()
            if line.startswith(">"):
                if name is not None:
                    yield name, "".join(parts)
                name, parts = line[1:], []
            elif line:
                parts.append(line)
    if name is not None:
        yield name, "".join(parts)


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class FastaReader(DataSourceReader):
    def __init__(self, paths: list[str], chunked: bool):
        self.paths, self.chunked = paths, chunked

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for number, (name, sequence) in enumerate(read_records(partition.path)):
            if self.chunked:
                for i in range(0, max(len(sequence), 1), CHUNK):
                    yield name.split()[0] if name.split() else "", i // CHUNK, len(sequence), sequence[i : i + CHUNK]
            else:
                yield name, sequence, number


class FastaSource(DataSource):
    """``spark.read.format("sv_fasta").option("paths", "a.fa")``: name, sequence and its number in the file; with option chunked,
    pieces of a fixed length."""

    @classmethod
    def name(cls) -> str:
        return "sv_fasta"

    def _chunked(self) -> bool:
        return self.options.get("chunked", "false") == "true"

    def schema(self) -> str:
        return "contig string, chunk long, contig_size long, bases string" if self._chunked() else "name string, sequence string, number long"

    def reader(self, schema: object) -> DataSourceReader:
        return FastaReader([p for p in self.options.get("paths", self.options.get("path", "")).split(",") if p], self._chunked())


def read_fasta(spark: SparkSession, paths: list[str], chunked: bool = False) -> DataFrame:
    spark.dataSource.register(FastaSource)
    return spark.read.format("sv_fasta").option("paths", ",".join(paths)).option("chunked", str(chunked).lower()).load()


def reference_bases(places: DataFrame, chunks: DataFrame) -> DataFrame:
    """(contig, pos, base) of distinct places, looked up in the chunked reference; N at or beyond the contig's last base.

    The join is on contig and chunk, so a whole contig never travels to one task.
    """
    asked = places.select("contig", "pos").distinct().withColumn("chunk", F.floor((F.col("pos") - 1) / F.lit(CHUNK)).cast("long"))
    met = asked.join(chunks, ["contig", "chunk"], "left")
    base = F.substring("bases", ((F.col("pos") - 1) % CHUNK + 1).cast("int"), F.lit(1))
    inside = (F.col("pos") >= 1) & (F.col("pos") < F.col("contig_size"))
    return met.select("contig", "pos", F.when(inside, base).otherwise("N").alias("base"))
