"""Command line: merge, index-features, find-similar."""

from __future__ import annotations

import argparse
import sys

from varweave.errors import OptionError
from varweave.options import IndexOptions, MergeOptions, QueryOptions
from varweave.session import local_session


def _flag(text: str) -> bool:
    if text.lower() not in ("true", "false"):
        raise argparse.ArgumentTypeError(f"{text} is neither true nor false")
    return text.lower() == "true"


def _add_flag(p: argparse.ArgumentParser, name: str, default: bool | None) -> None:
    """``--name``, ``--name true``, ``--name=false`` and ``--no-name``."""
    dest = name.replace("-", "_")
    p.add_argument(f"--{name}", dest=dest, type=_flag, nargs="?", const=True, default=default)
    p.add_argument(f"--no-{name}", dest=dest, action="store_false", default=argparse.SUPPRESS)


def _names(text: str) -> list[str]:
    return [x for x in text.split(",") if x]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="varweave", allow_abbrev=False)
    p.add_argument("--threads", type=int, default=4, help="tasks at once, 0 for all cores")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, said: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=said, allow_abbrev=False)
        c.add_argument("--threads", type=int, default=argparse.SUPPRESS)
        return c

    m = command("merge", "merge VCF files into one")
    m.add_argument("-o", "--out", required=True)
    m.add_argument("--position-window", type=int, default=25)
    m.add_argument("--end2-window", type=int, default=150)
    m.add_argument("--length-ratio", type=float, default=0.9)
    m.add_argument("--length-window", type=int, default=25)
    m.add_argument("--merge-table", "--write-merge-table")
    m.add_argument("-u", "--unwanted-info", type=_names, action="extend", default=[], help="INFO fields to drop, separated by commas")
    m.add_argument("-r", "--reference")
    m.add_argument("--annotation-index", "--annotate-insertions")
    _add_flag(m, "force-alt-tags", True)
    _add_flag(m, "use-ref-alleles", True)
    _add_flag(m, "fill-in-refs", None)
    m.add_argument("vcf", nargs="+")
    i = command("index-features", "index a FASTA file by k-mers")
    i.add_argument("-k", "--k", type=int, default=11)
    i.add_argument("--name-pattern", "--pattern")
    i.add_argument("--name-replacement", "--name", default="$0")
    i.add_argument("-o", "--out", required=True)
    i.add_argument("-f", "--features", dest="named_fasta")
    i.add_argument("fasta", nargs="?")
    f = command("find-similar", "rank indexed features against sequences")
    f.add_argument("-f", "--index", "--features", required=True)
    f.add_argument("-k", "--k", type=int, help="accepted; the k of the index holds")
    f.add_argument("--query", "-q")
    f.add_argument("--query-fasta", "--query-file")
    f.add_argument("-v", "--query-vcf", "--vcf")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from varweave.plans import merge_vcf

    spark = local_session(args.threads or "*", max(args.threads, 4))
    if args.command == "merge":
        options = MergeOptions(
            position_window=args.position_window,
            end2_window=args.end2_window,
            length_ratio=args.length_ratio,
            length_window=args.length_window,
            merge_table=args.merge_table,
            unwanted_info=tuple(args.unwanted_info),
            reference=args.reference,
            annotation_index=args.annotation_index,
            force_alt_tags=args.force_alt_tags,
            use_ref_alleles=args.use_ref_alleles,
            fill_in_refs=args.fill_in_refs,
        )
        merge_vcf.merge_vcfs(spark, args.vcf, args.out, options)
    elif args.command == "index-features":
        fasta = args.named_fasta or args.fasta
        if not fasta:
            raise OptionError("name the FASTA file of the features")
        merge_vcf.index_fasta(spark, fasta, args.out, IndexOptions(args.k, args.name_pattern, args.name_replacement))
    else:
        asked = QueryOptions(args.query, args.query_fasta, args.query_vcf)
        for r in merge_vcf.similar_features(spark, args.index, asked.query, asked.query_fasta, asked.query_vcf).toLocalIterator():
            print(r["query_name"], r["name"], f"{r['fwd']:.6f}", f"{r['rev']:.6f}", sep="\t")
    return 0


if __name__ == "__main__":
    sys.exit(main())
