"""Short reads: trimming, preprocessing, duplicates, sets of reads, quality statistics.

Qualities are arrays; trims are higher-order functions over them, so reads never leave the JVM.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.text import failing, write_single
from .count import choice

KEY = ("sample", "file_id", "rec_no")


@dataclass
class Read:
    """A read inside a preprocessing block: columns for its parts, transformed by expressions."""

    header: Column
    seq: Column
    qual: Column

    def __len__(self) -> int:
        raise TypeError("use read.length(): the length is a column")

    def length(self) -> Column:
        return F.length(self.seq)

    def cut(self, start: Column, size: Column) -> Read:
        return Read(self.header, F.substring(self.seq, start.cast("int") + 1, size.cast("int")), F.slice(self.qual, start.cast("int") + 1, size.cast("int")))

    def __getitem__(self, part: slice) -> Read:
        """Half open; beyond the read the job fails."""
        if not isinstance(part, slice) or part.step is not None:
            raise TypeError("a read takes a slice [a:b]")
        n = self.length()
        start = F.lit(0) if part.start is None else F.lit(part.start)
        stop = n if part.stop is None else F.lit(part.stop)
        inside = (start >= 0) & (start <= stop) & (stop <= n)
        checked = F.coalesce(failing(inside, F.concat(F.lit("slice outside read "), self.header)).cast("int"), start)
        return self.cut(checked, stop - start)

    def substrim(self, min_quality: int) -> Read:
        """The longest run of bases of at least this quality, the first of equal ones."""
        return self.cut(*longest_run(self.qual, min_quality))

    def endstrim(self, min_quality: int, from_ends: str = "both") -> Read:
        """Bases below this quality are cut from the ends."""
        choice("from_ends", from_ends, ("both", "3", "5"))
        good = F.transform(self.qual, lambda q: q >= min_quality)
        n = F.size(self.qual)
        first = F.array_position(good, F.lit(True)).cast("int")
        last = F.array_position(F.reverse(good), F.lit(True)).cast("int")
        start = F.when(first == 0, n).otherwise(first - 1) if from_ends != "3" else F.lit(0)
        stop = F.when(last == 0, F.lit(0)).otherwise(n - last + 1) if from_ends != "5" else n
        return self.cut(start, F.greatest(stop - start, F.lit(0)))

    def smoothtrim(self, min_quality: int, window: int) -> Read:
        """As substrim on qualities smoothed by a moving mean, rounded half to even; edges are repeated."""
        return self.cut(*longest_run(smoothed(self.qual, window), min_quality))

    def avg_quality(self) -> Column:
        n = F.size(self.qual)
        return F.when(n == 0, F.lit(float("nan"))).otherwise(F.aggregate(self.qual, F.lit(0).cast("long"), lambda a, q: a + q) / F.greatest(n, F.lit(1)))

    def fraction_at_least(self, quality: int) -> Column:
        n = F.size(self.qual)
        return F.when(n == 0, F.lit(float("nan"))).otherwise(F.size(F.filter(self.qual, lambda q: q >= quality)) / F.greatest(n, F.lit(1)))

    def n_to_zero_quality(self) -> Read:
        bases = F.upper(self.seq)
        return Read(self.header, self.seq, F.transform(self.qual, lambda q, i: F.when(F.substring(bases, i + 1, F.lit(1)) == "N", F.lit(0)).otherwise(q)))


def longest_run(qual: Column, least: int) -> tuple[Column, Column]:
    """(start, size) of the longest run of values of at least `least`, the first of equal ones; (0, 0) without any."""
    state = F.struct(*[F.lit(0).alias(n) for n in ("at", "start", "size", "run")])

    def step(s: Column, q: Column) -> Column:
        run = F.when(q >= least, s["run"] + 1).otherwise(0)
        longer = run > s["size"]
        return F.struct((s["at"] + 1).alias("at"), F.when(longer, s["at"] + 1 - run).otherwise(s["start"]).alias("start"), F.when(longer, run).otherwise(s["size"]).alias("size"), run.alias("run"))

    return F.aggregate(qual, state, step, lambda s: s["start"]), F.aggregate(qual, state, step, lambda s: s["size"])


def smoothed(qual: Column, window: int) -> Column:
    if window < 1:
        raise ValueError("window must be positive")
    left = (window - 1) // 2
    n = F.size(qual)
    edge = lambda at, times: F.array_repeat(F.get(qual, at), times)
    padded = F.concat(edge(F.lit(0), left), qual, edge(n - 1, window - 1 - left))
    mean = lambda i: F.bround(F.aggregate(F.slice(padded, i, window), F.lit(0).cast("long"), lambda a, q: a + q).cast("double") / window, 0).cast("int")
    return F.when(n == 0, qual).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), mean))


# --- preprocessing -------------------------------------------------------------------------------------------------


class Block:
    """Statements on a read, compiled to columns. A statement after a discard or a continue does nothing for that read."""

    def __init__(self, read: Read) -> None:
        self.read, self.kept, self.active = read, F.lit(True), F.lit(True)

    def assign(self, read: Read, when: Column | None = None) -> None:
        on = self.active if when is None else self.active & when
        old = self.read
        self.read = Read(old.header, *(F.when(on, new).otherwise(before) for new, before in ((read.seq, old.seq), (read.qual, old.qual))))

    def discard(self, when: Column | None = None) -> None:
        on = self.active if when is None else self.active & F.coalesce(when, F.lit(False))
        self.kept, self.active = self.kept & ~on, self.active & ~on

    def stop(self, when: Column | None = None) -> None:
        """continue: the read stays as it is now."""
        on = self.active if when is None else self.active & F.coalesce(when, F.lit(False))
        self.active = self.active & ~on


def preprocess(reads: DataFrame, block: Callable[[Read], Read | None] | Callable[[Block], None], keep_singles: bool = True, steps: Sequence[Callable[[Read], tuple[Read, Column | None]]] = ()) -> DataFrame:
    """Run a block on every read and settle pairs: both mates stay, or the survivor becomes a singleton, or nothing stays.

    `steps` are functions read -> (read, keep or None), run in turn and each materialised as columns, so that expressions do not
    grow with the block; `block` may be a function on one Block instead.
    """
    out = reads
    if block is not None:
        b = Block(Read(F.col("header"), F.col("seq"), F.col("qual")))
        block(b)
        out = out.withColumns({"_seq": b.read.seq, "_qual": b.read.qual, "_kept": b.kept}).where("_kept").withColumns({"seq": F.col("_seq"), "qual": F.col("_qual")}).drop("_seq", "_qual", "_kept")
    for step in steps:
        read, keep = step(Read(F.col("header"), F.col("seq"), F.col("qual")))
        out = out.withColumns({"_seq": read.seq, "_qual": read.qual}).withColumns({"seq": F.col("_seq"), "qual": F.col("_qual")}).drop("_seq", "_qual")
        if keep is not None:
            out = out.where(F.coalesce(keep, F.lit(False)))
    return settle_pairs(out, keep_singles)


def settle_pairs(reads: DataFrame, keep_singles: bool = True) -> DataFrame:
    """Mates whose partner is gone become singletons, before the other ones, or go."""
    alone = (F.col("mate") > 0) & (F.count(F.lit(1)).over(Window.partitionBy(*KEY, F.col("mate") > 0)) == 1)
    marked = reads.withColumn("_alone", alone)
    if not keep_singles:
        return marked.where(~F.col("_alone")).drop("_alone")
    return marked.withColumn("mate", F.when(F.col("_alone"), F.lit(0)).otherwise(F.col("mate")).cast("tinyint")).withColumn("was_mate", F.col("_alone")).drop("_alone")


def unique(reads: DataFrame, max_copies: int = 1) -> DataFrame:
    """The first reads of each sequence."""
    if max_copies < 1:
        raise ValueError("max_copies must be at least 1")
    order = Window.partitionBy("sample", "seq").orderBy("file_id", "rec_no")
    return reads.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_copies).drop("_n")


def discard_singles(reads: DataFrame) -> DataFrame:
    return reads.where(F.col("mate") > 0)


def group(parts: Sequence[DataFrame], name: str) -> DataFrame:
    """Several read sets as one, in order."""
    if not parts:
        raise ValueError("group of no read sets")
    out, base = None, 0
    for p in parts:
        n = p.agg(F.coalesce(F.max("file_id"), F.lit(-1))).first()[0] + 1
        p = p.withColumns({"sample": F.lit(name), "file_id": (F.col("file_id") + base).cast("int")})
        out, base = p if out is None else out.unionByName(p), base + n
    return out


def interleaved(reads: DataFrame) -> DataFrame:
    return reads.orderBy(F.col("mate") == 0, "sample", "file_id", "rec_no", "mate")


# --- statistics ----------------------------------------------------------------------------------------------------


def file_stats(reads: DataFrame, by: Sequence[str] = ("sample", "file_id", "mate")) -> DataFrame:
    """Reads, lengths and bases of each file; other is what is none of A, C, G, T."""
    upper, n = F.upper("seq"), F.length("seq")
    base = lambda b: (n - F.length(F.replace(upper, F.lit(b), F.lit("")))).cast("long")
    sums = [F.sum(base(b)).alias(b.lower()) for b in "ACGT"]
    rows = reads.groupBy(*by).agg(F.count(F.lit(1)).alias("n_seqs"), F.min(n).cast("long").alias("min_len"), F.max(n).cast("long").alias("max_len"), F.sum(n.cast("long")).alias("n_bases"), *sums)
    known = F.col("a") + F.col("c") + F.col("g") + F.col("t")
    whole = F.greatest(F.col("n_bases"), F.lit(1))
    return rows.withColumns({"other": F.col("n_bases") - known, "gc": (F.col("c") + F.col("g")) / F.greatest(known, F.lit(1)), "non_acgt": (F.col("n_bases") - known) / whole})


def position_stats(reads: DataFrame, by: Sequence[str] = ("sample",)) -> DataFrame:
    """(by..., pos, mean, median, q25, q75) of qualities at each position, exact: from counts by value and their running totals.

    The mean is rounded down; a percentile p of n values is the first value at which the running count reaches ceil(n p).
    """
    by = list(by)
    each = reads.select(*by, F.posexplode("qual").alias("pos", "q")).groupBy(*by, "pos", "q").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy(*by, "pos").orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by, "pos")
    cum = each.withColumns({"cum": F.sum("c").over(upto), "n": F.sum("c").over(whole)})
    at = lambda p: F.min(F.when(F.col("cum") >= F.ceil(F.col("n") * p), F.col("q"))).cast("int")
    mean = F.floor(F.sum(F.col("q").cast("long") * F.col("c")) / F.sum("c")).cast("int")
    return cum.groupBy(*by, "pos").agg(mean.alias("mean"), at(0.5).alias("median"), at(0.25).alias("q25"), at(0.75).alias("q75"))


def stats_table(stats: DataFrame, encoding: str = "sanger", by: Sequence[str] = ("sample", "file_id", "mate")) -> DataFrame:
    """The file statistics as (feature, value) rows `i:key`, files numbered in order. One row a file goes in."""
    rows = stats.withColumn("i", F.row_number().over(Window.orderBy(*by)) - 1)
    name = F.concat_ws(":", *[F.col(c).cast("string") for c in by])
    values = {
        "encoding": F.lit(encoding), "file": name, "gcContent": F.col("gc"), "maxSeqLen": F.col("max_len"), "minSeqLen": F.col("min_len"), "nonATCGFraction": F.col("non_acgt"), "numBasepairs": F.col("n_bases"), "numSeqs": F.col("n_seqs"),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in values.items()]))
    return rows.select("i", each.alias("x")).select(F.concat_ws(":", F.col("i").cast("string"), "x.k").alias("feature"), F.col("x.v").alias("value"))


def run_report(folder: str, reads: DataFrame | None = None, mappings: Sequence[tuple[str, str, int, DataFrame]] = (), script: str = "") -> list[str]:
    """Tables of a run in a folder: statistics of the files of reads, of mappings, and the script."""
    os.makedirs(folder, exist_ok=True)
    out = []
    for name, table in (("fq.tsv", qcstats("fastq", reads) if reads is not None else None), ("mappings.tsv", qcstats("mapping", mappings=mappings) if mappings else None)):
        if table is not None:
            lines = table.select(F.concat_ws("\t", "feature", "value").alias("line")).orderBy("line")
            out.append(write_single(lines, os.path.join(folder, name), ["\tstats"]))
    if script:
        out.append(os.path.join(folder, "script.txt"))
        with open(out[-1], "w", encoding="utf-8") as file:
            file.write(script)
    return out


def qcstats(kind: str, reads: DataFrame | None = None, mappings: Sequence[tuple[str, str, int, DataFrame]] = (), encoding: str = "sanger") -> DataFrame:
    """(feature, value) rows `i:key`: statistics of the files of reads (fastq), or of mappings (mapping: input, reference, line, statistics)."""
    from .mapped import stats_table as mapping_table

    if choice("kind", kind, ("fastq", "mapping")) == "mapping":
        return mapping_table(mappings)
    return stats_table(file_stats(reads), encoding)
