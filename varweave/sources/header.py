"""VCF headers: what the readers and the writer need of them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from varweave.operators.annotate import UNPAIRED
from varweave.sources.storage import open_text

_META = re.compile(r"^##([A-Za-z]+)=<(.*)>$")
_PART = re.compile(r'([A-Za-z0-9_.]+)=("(?:[^"\\]|\\.)*"|[^,]*)')


@dataclass
class Header:
    lines: list[str] = field(default_factory=list)
    contigs: list[str] = field(default_factory=list)
    lengths: dict[str, int] = field(default_factory=dict)
    infos: dict[str, tuple[str, str]] = field(default_factory=dict)
    formats: dict[str, tuple[str, str]] = field(default_factory=dict)
    filters: list[str] = field(default_factory=list)
    samples: list[str] = field(default_factory=list)

    def add(self, line: str) -> None:
        m = _META.match(line)
        if m:
            parts = {k: v.strip('"') for k, v in _PART.findall(m[2])}
            name = parts.get("ID", "")
            if m[1] == "contig":
                self.contigs.append(name)
                if parts.get("length", "").isdigit():
                    self.lengths[name] = int(parts["length"])
            elif m[1] == "INFO":
                self.infos[name] = (parts.get("Number", "."), parts.get("Type", "String"))
            elif m[1] == "FORMAT":
                self.formats[name] = (parts.get("Number", "."), parts.get("Type", "String"))
            elif m[1] == "FILTER":
                self.filters.append(name)
        self.lines.append(line)


def scan(path: str) -> tuple[Header, Iterator[str]]:
    """The header of a VCF file and an iterator over its record lines."""
    stream = open_text(path)
    header = Header()
    for line in stream:
        line = line.rstrip("\r\n")
        if line.startswith("##"):
            header.add(line)
        elif line.startswith("#"):
            header.samples = line.split("\t")[9:]
            break
        else:
            break

    def records() -> Iterator[str]:
        with stream:
            for line in stream:
                line = line.rstrip("\r\n")
                if line:
                    yield line

    return header, records()


def read_header(path: str) -> Header:
    header, records = scan(path)
    records.close() if hasattr(records, "close") else None
    return header


#: What the merged file declares beside the first file's header: name, type, description, and whether the prefix stands
#: before the name. Names and types are fixed values.
ADDED = [
    ("CHR2", "String", "Contig on which the mate of a breakend lies", False),
    ("END2", "Integer", "Place of the mate of a breakend", False),
    ("ORIGINAL_IDS", "String", "Identifiers of the merged records in their files", False),
    ("CRITERIA", "String", "Rounds of the merge that joined these records", True),
    ("ALT_SEQ", "String", "Inserted or deleted sequences for which tags stand", True),
    ("ALT_CLASS", "String", "Class of the most similar indexed feature, with its strand", True),
]

def merged_header(first: Header, samples: list[str], prefix: str, unwanted: tuple[str, ...]) -> list[str]:
    """Header lines of the merged file: the first file's, what the merge adds, without unwanted INFO fields."""
    out = [x for x in first.lines if not any(x.startswith(f"##INFO=<ID={u},") for u in unwanted)]
    if UNPAIRED[0] not in first.filters:
        out.append(f'##FILTER=<ID={UNPAIRED[0]},Description="{UNPAIRED[1]}">')
    for name, kind, said, own in ADDED:
        name = f"{prefix}_{name}" if own else name
        if name not in first.infos and name not in unwanted:
            out.append(f'##INFO=<ID={name},Number=.,Type={kind},Description="{said}">')
    columns = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *samples] if samples else [])]
    return [*out, "\t".join(columns)]
