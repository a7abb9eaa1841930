"""Typed errors. Each carries where it arose - file, variant, INFO field, sample, FORMAT field - outermost first."""

from __future__ import annotations


class VariantError(ValueError):
    """The base of all errors of the engine."""

    what = "invalid variant data"

    def __init__(self, detail: str = "", context: tuple[str, ...] = ()):
        self.detail, self.context = detail, context
        super().__init__(detail, context)

    def within(self, place: str) -> VariantError:
        """The same error, seen from one level further out."""
        return type(self)(self.detail, (place, *self.context))

    def __str__(self) -> str:
        said = f"{self.what}: {self.detail}" if self.detail else self.what
        return ": ".join([*self.context, said])


def _kind(name: str, what: str) -> type[VariantError]:
    return type(name, (VariantError,), {"what": what, "__doc__": what.capitalize() + "."})


BadChrom = _kind("BadChrom", "undeclared contig")
BadBreakend = _kind("BadBreakend", "malformed breakend")
BadInfoType = _kind("BadInfoType", "INFO value of the wrong type")
BadInfo = _kind("BadInfo", "INFO value that cannot be read")
BadFormat = _kind("BadFormat", "sample value that cannot be read")
BadRecord = _kind("BadRecord", "line that is no record")
BadNumber = _kind("BadNumber", "number that cannot be read")
MissingType = _kind("MissingType", "no SVTYPE and none that can be inferred")
MissingChr2 = _kind("MissingChr2", "breakend without a second contig")
MissingAlt = _kind("MissingAlt", "breakend without an alternate allele")
MissingK = _kind("MissingK", "feature index without its k-mer length")
Chr2Mismatch = _kind("Chr2Mismatch", "CHR2 differs from the breakend's contig")
ContigMismatch = _kind("ContigMismatch", "contigs differ from those of the first file")
TooManyFiles = _kind("TooManyFiles", "more than 64 files")
MultiAllelic = _kind("MultiAllelic", "more than one alternate allele")
DuplicateKey = _kind("DuplicateKey", "keys occur more than once")
OptionError = _kind("OptionError", "invalid options")
