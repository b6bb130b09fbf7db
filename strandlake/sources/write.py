"""One writer for all kinds of results, told apart by their columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from .checks import check_output
from .fastq import write_reads
from .sam import write_sam
from .tables import auto_comments as made_comments
from .tables import write_counts
from .text import copy_file


def kind_of(x: DataFrame | str) -> str:
    """reads, alignments, counts, or file for a path."""
    if isinstance(x, str):
        return "file"
    columns = set(x.columns)
    for kind, needed in (("reads", {"header", "seq", "qual", "mate"}), ("alignments", {"qname", "flag", "rname", "cigar"}), ("counts", {"feature"})):
        if needed <= columns:
            return kind
    raise TypeError(f"nothing that can be written has the columns {x.columns}")


def subsampled_name(path: str) -> str:
    """The name of an output of a subsampled run: the marker stands before the extensions of FASTQ files, and last in other names."""
    for ext in (".fq", ".fq.gz", ".fq.bz2"):
        if path.endswith(ext):
            return f"{path.removesuffix(ext)}.subsampled{ext}"
    return f"{path}.subsampled"


def write(
    x: DataFrame | str, ofile: str, format: str | None = None, format_flags: Sequence[str] = (), comment: str | None = None, auto_comments: Sequence[str] = (), script: str = "",
    head: DataFrame | None = None, order: Sequence[str | Column] = ("line_no",), offset: int = 33, subsample: bool = False,
) -> str:
    """Write reads, alignments, counts or a copy of a file; returns the name given.

    format: tsv or csv for counts, sam or bam for alignments (or else by the name). format_flags: interleaved, always_3_fq_files.
    Comments stand at the top of counts: the one given, then the automatic ones (date, script, hash) as listed.
    """
    kind, target = kind_of(x), check_output(subsampled_name(ofile) if subsample else ofile)
    if kind == "file":
        copy_file(x, target)
    elif kind == "reads":
        unknown = set(format_flags) - {"interleaved", "always_3_fq_files"}
        if unknown:
            raise ValueError(f"unknown format flags {sorted(unknown)}")
        write_reads(x, target, "interleaved" in format_flags, offset, "always_3_fq_files" in format_flags)
    elif kind == "alignments":
        write_sam(x, head, target, order, format)
    else:
        values = [c for c in x.columns if c not in ("feature", "line_no")]
        comments = [*([comment] if comment is not None else []), *made_comments(auto_comments, script, x)]
        write_counts(x, target, values, format or "tsv", comments)
    return ofile
