"""SAM: alignments as rows, groups of neighbouring lines, headers; BAM through samtools where it is installed."""

from __future__ import annotations

import os
import shutil
import subprocess
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import failing, local_path, numbered_lines, scratch, write_single

FIELDS = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", "extra")
_LONGS = frozenset({"flag", "pos", "mapq", "pnext", "tlen"})
#: Flag bits of the format.
PAIRED, PROPER, UNMAPPED, REVERSE, FIRST, SECOND = 1, 2, 4, 16, 64, 128


def bit(mask: int, flag: str | Column = "flag") -> Column:
    return F.col(flag).bitwiseAND(F.lit(mask)) != 0 if isinstance(flag, str) else flag.bitwiseAND(F.lit(mask)) != 0


def aligned(flag: str | Column = "flag") -> Column:
    return ~bit(UNMAPPED, flag)


def parse_lines(lines: DataFrame, keep: list[str] = ()) -> DataFrame:
    """(line_no, value) -> line_no and the fields. Optional tags stay one block.

    A line of eleven columns, without tags, has no quality field: its last column is the block. Fewer columns fail the job.
    """
    parts = F.split("value", "\t", 12)
    n = F.size(parts)
    enough = failing(n >= 11, F.concat(F.lit("alignment line "), F.col("line_no").cast("string"), F.lit(" has fewer than 11 columns")))
    out = []
    for k, name in enumerate(FIELDS):
        value = F.get(parts, F.lit(k))
        if name == "qname":
            value = F.coalesce(enough.cast("string"), value)
        elif name == "qual":
            value = F.when(n == 11, F.lit("")).otherwise(value)
        elif name == "extra":
            value = F.when(n == 11, F.get(parts, F.lit(10))).otherwise(value)
        out.append((value.cast("long") if name in _LONGS else value).alias(name))
    return lines.select(*keep, "line_no", *out)


def group_ids(rows: DataFrame, paired: bool = True, partition: tuple[str, ...] = ("sample",), headers: str | None = None) -> DataFrame:
    """Adds group_id: neighbouring lines with one name (and, unpaired, one first-in-pair bit); the group's first line number.

    A line starts a group if the line before has another key. Group ids are line numbers, so no running count over a file is
    needed: the last start at or before a line is found in two steps, within a slice of lines and from the ends of slices before.
    The ends are told by one pass over names, and broadcast: they are one row for 20,000 lines.
    """
    key = F.col("qname") if paired else F.concat_ws("\t", "qname", bit(FIRST).cast("string"))
    keyed = rows.withColumns({"_key": key, "_slice": F.floor(F.col("line_no") / 20_000)})
    in_slice, here = Window.partitionBy(*partition, "_slice").orderBy("line_no"), F.struct("line_no", "_key")

    def starts(last: Column, this: Column) -> Column:
        cut = this["line_no"] - 1 != last["line_no"] if headers is not None else F.lit(False)  # a header line closes a group
        return last.isNull() | (last["_key"] != this["_key"]) | cut

    near = keyed.select(*partition, "_slice", "line_no", "_key").withColumn("_near", F.lag(here).over(in_slice))
    inner = F.max(F.when(F.col("_near").isNotNull() & starts(F.col("_near"), here), F.col("line_no")))
    ends = near.groupBy(*partition, "_slice").agg(F.min(here).alias("_first"), F.max(here).alias("_last"), inner.alias("_inner"))
    before = Window.partitionBy(*partition).orderBy("_slice")
    ends = ends.withColumn("_left", F.lag("_last").over(before))
    opened = F.coalesce("_inner", F.when(starts(F.col("_left"), F.col("_first")), F.col("_first.line_no")))
    ends = ends.withColumn("_opened", opened).withColumn("_carried", F.max("_opened").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    keyed = keyed.withColumn("_near", F.lag(here).over(in_slice)).join(F.broadcast(ends.select(*partition, "_slice", "_left", "_carried")), [*partition, "_slice"])
    keyed = keyed.withColumn("_start", F.when(starts(F.coalesce("_near", "_left"), here), F.col("line_no")))
    out = keyed.withColumn("group_id", F.coalesce(F.max("_start").over(in_slice.rowsBetween(Window.unboundedPreceding, 0)), F.col("_carried")))
    return out.drop("_key", "_slice", "_near", "_start", "_carried", "_left")


def samfile(spark: SparkSession, path: str, name: str | None = None, headers: str = "", paired: bool = True) -> tuple[DataFrame, DataFrame]:
    """(alignments with sample, line_no, group_id; header lines hdr_no, line, sn, ln)."""
    lines = numbered_lines(spark, _from_bam(spark, path) if path.endswith(".bam") else path)
    is_header = F.col("value").startswith("@")
    rows = parse_lines(lines.where(~is_header)).withColumn("sample", F.lit(name or path))
    head = lines.where(is_header).select(F.col("line_no").alias("hdr_no"), F.col("value").alias("line"))
    if headers:
        extra = numbered_lines(spark, headers).select((F.col("line_no") - F.lit(1 << 40)).alias("hdr_no"), F.col("value").alias("line"))
        head = extra.unionByName(head)
    return group_ids(rows, paired, headers="split"), with_sequences(head)


def with_sequences(head: DataFrame) -> DataFrame:
    sq = F.col("line").startswith("@SQ\t")
    tag = lambda t: F.regexp_extract("line", rf"\t{t}:([^\t]*)", 1)
    return head.withColumns({"sn": F.when(sq, tag("SN")), "ln": F.when(sq, tag("LN").try_cast("long"))})


def sequences(head: DataFrame) -> DataFrame:
    """(feature, size) of the reference sequences."""
    return head.where(F.col("sn").isNotNull()).select(F.col("sn").alias("feature"), F.col("ln").cast("double").alias("size"))


def as_line() -> Column:
    """The text of an alignment; an eleven-column line is written as it was."""
    fields = [F.col(c).cast("string") for c in FIELDS]
    return F.when(F.col("qual") == "", F.concat_ws("\t", *fields[:10], fields[11])).when(F.coalesce("extra", F.lit("")) == "", F.concat_ws("\t", *fields[:11])).otherwise(F.concat_ws("\t", *fields))


def guessed_format(path: str) -> str:
    """sam or bam by the name of a file; names that tell neither are bam."""
    return "sam" if path in ("/dev/stdout", "-") or path.endswith((".sam", ".sam.gz", ".sam.bz2", ".sam.zst", ".sam.zstd")) else "bam"


def write_sam(rows: DataFrame, head: DataFrame | None, path: str, order: Sequence[str | Column] = ("line_no",), format: str | None = None) -> str:
    """Headers, then alignments in order, to one file; a BAM file is made by samtools from a file beside it, which goes."""
    kind = format or guessed_format(path)
    if kind not in ("sam", "bam"):
        raise ValueError(f"alignments are written as sam or bam, not {kind!r}")
    top = [r["line"] for r in head.orderBy("hdr_no").select("line").collect()] if head is not None else []
    target = path if kind == "sam" else path + ".part.sam"
    write_single(rows.orderBy(*order).select(as_line().alias("line")), target, top)
    if kind == "bam":
        try:
            _samtools("view", "-b", "-o", path, target)
        finally:
            os.unlink(target)
    return path


def _samtools(*args: str) -> None:
    if not shutil.which("samtools"):
        raise RuntimeError("BAM needs samtools, which is not installed")
    subprocess.run(["samtools", *args], check=True)


def _from_bam(spark: SparkSession, path: str) -> str:
    target = f"{local_path(scratch(spark))}/alignments.sam"
    _samtools("view", "-h", "-o", target, path)
    return target
