"""Interval joins: alignments and annotated intervals of one sequence.

An interval is in every bin it touches, so that overlap is an equi-join on (sequence, level, bin) with a residual test, and bins spread
a hot sequence over tasks. Bins are a few times as long as intervals are on average; much longer intervals stand on levels of longer bins, so
that none is in many bins. A pair that shares several bins is taken in one only: the one where the later of both starts lies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sam import REVERSE, bit
from .count import choice

#: An interval is in so many bins of its level at most; bins of a level are so many times those of the one below.
SPREAD = 64
MODES, SENSES = ("union", "intersection_strict", "intersection_non_empty"), ("both", "sense", "antisense")


def bin_levels(right: DataFrame, least: int = 16) -> list[int]:
    """Lengths of bins for intervals (r_start, r_stop): two to four times their mean length, and as many longer levels as the longest one needs. One pass over them."""
    span = F.col("r_stop") - F.col("r_start")
    mean, most = right.where(span > 0).agg(F.avg(span), F.max(span)).first()
    levels = [1 << max(least.bit_length() - 1, round(mean or 1).bit_length() + 1)]
    while levels[-1] * SPREAD < (most or 0):
        levels.append(levels[-1] * SPREAD)
    return levels


def overlaps(left: DataFrame, right: DataFrame, levels: Sequence[int] | None = None) -> DataFrame:
    """left (seq_id, start, stop, ...), right (seq_id, r_start, r_stop, ...), half open -> all overlapping pairs, each once."""
    levels = list(levels or bin_levels(right))
    span = F.col("r_stop") - F.col("r_start")
    own = F.lit(levels[-1])
    for size in reversed(levels[:-1]):
        own = F.when(span <= size * SPREAD, F.lit(size)).otherwise(own)
    bins = lambda a, b, size: F.sequence(F.floor(F.col(a) / size), F.floor((F.col(b) - 1) / size))
    left, right = left.where(F.col("start") < F.col("stop")), right.where(F.col("r_start") < F.col("r_stop"))
    if len(levels) == 1:
        a, b = left.withColumn("_bin", F.explode(bins("start", "stop", levels[0]))), right.withColumn("_bin", F.explode(bins("r_start", "r_stop", levels[0])))
        both = a.join(b, ["seq_id", "_bin"]).where((F.col("start") < F.col("r_stop")) & (F.col("r_start") < F.col("stop")))
        return both.where(F.floor(F.greatest("start", "r_start") / levels[0]) == F.col("_bin")).drop("_bin")
    at_level = lambda size: F.transform(bins("start", "stop", size), lambda k: F.struct(F.lit(size).alias("size"), k.alias("bin")))
    places = F.flatten(F.array(*map(at_level, levels)))
    a = left.withColumn("_at", F.explode(places)).withColumns({"_size": F.col("_at.size"), "_bin": F.col("_at.bin")}).drop("_at")
    b = right.withColumn("_size", own)
    b = b.withColumn("_bin", F.explode(bins("r_start", "r_stop", F.col("_size"))))
    both = a.join(b, ["seq_id", "_size", "_bin"]).where((F.col("start") < F.col("r_stop")) & (F.col("r_start") < F.col("stop")))
    return both.where(F.floor(F.greatest("start", "r_start") / F.col("_size")) == F.col("_bin")).drop("_bin", "_size")


def read_span(alignments: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep..., seq_id, start, stop, strand): from the position, as long as the stored sequence ('*' is one base)."""
    strand = F.when(bit(REVERSE), "-").otherwise("+")
    return alignments.select(*keep, F.col("rname").alias("seq_id"), F.col("pos").alias("start"), (F.col("pos") + F.greatest(F.length("seq"), F.lit(1))).alias("stop"), strand.alias("strand"))


def strand_fits(sense: str, read: str | Column = "strand", feature: str | Column = "r_strand") -> Column:
    """Strands compare literally: features without one never fit sense or antisense."""
    if sense == "both":
        return F.lit(True)
    read, feature = F.col(read), F.col(feature)
    return feature == read if sense == "sense" else feature == F.when(read == "+", "-").otherwise("+")


def gff_features(annotation: DataFrame, features: Sequence[str], subfeatures: Sequence[str] | None = None) -> DataFrame:
    """(annotator, feature, seq_id, r_start, r_stop, r_strand): intervals named by attributes of the lines of a feature type.

    Without subfeatures all values of ID and gene_id are names. Each feature type and subfeature is an annotation of its own;
    names carry them if there are several.
    """
    lines = annotation.where(F.col("gtype").isin(*features)).withColumn("a", F.explode(F.filter("attrs", lambda a: a["k"].isin(*(subfeatures or ("ID", "gene_id"))))))
    kind = [F.col("gtype"), *([F.col("a.k")] if subfeatures else [])]
    single = len(features) <= 1 and (not subfeatures or len(subfeatures) == 1)
    name = F.col("a.v") if single else F.concat_ws(":", *kind, "a.v")
    return lines.select(F.concat_ws(":", *kind).alias("annotator"), name.alias("feature"), "seq_id", F.col("start").alias("r_start"), (F.col("end") + 1).alias("r_stop"), F.col("strand").alias("r_strand"))


def interval_features(intervals: DataFrame) -> DataFrame:
    """(annotator, feature, size): a feature is as long as its intervals together."""
    return intervals.groupBy("annotator", "feature").agg(F.sum(F.col("r_stop") - F.col("r_start")).cast("double").alias("size"))


def interval_hits(alignments: DataFrame, intervals: DataFrame, mode: str = "union", sense: str = "both", by: Sequence[str] = (), levels: Sequence[int] | None = None) -> DataFrame:
    """(by..., annotator, group_id, feature): what the rows of a group overlap, by mode; rows may repeat.

    union: any overlap. intersection_strict: the read lies within the interval. intersection_non_empty: of the read's positions
    that anything covers, the features that cover all of them. For the last, intervals in the order of their starts each add what lies
    beyond the furthest end before them: summed over a feature's intervals its covered positions, over all intervals those of the
    read; features that have as many stay. Candidates are shuffled once, by group.
    """
    choice("mode", mode, MODES)
    choice("sense", sense, SENSES)
    by = list(by)
    pairs = overlaps(read_span(alignments, [*by, "group_id", "line_no"]), intervals, levels).where(strand_fits(sense))
    key = ["group_id", *by, "annotator"]  # ids come first, since sorts compare the first key most
    if mode == "union":
        return pairs.select(*key, "feature")
    if mode == "intersection_strict":
        return pairs.where((F.col("start") >= F.col("r_start")) & (F.col("stop") <= F.col("r_stop"))).select(*key, "feature")
    read = ["line_no", *key]
    parts = pairs.select(*read, "feature", F.greatest("start", "r_start").alias("a"), F.least("stop", "r_stop").alias("b")).repartition("group_id")
    before = lambda *by: F.max("b").over(Window.partitionBy(*by).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    gain = lambda reach: F.greatest(F.col("b") - F.greatest("a", F.coalesce(reach, F.col("a"))), F.lit(0))
    parts = parts.withColumn("own", gain(before(*read, "feature"))).withColumn("any", gain(before(*read)))
    covered = parts.groupBy(*read, "feature").agg(F.sum("own").alias("own"), F.sum("any").alias("any"))
    covered = covered.withColumn("all", F.sum("any").over(Window.partitionBy(*read)))
    return covered.where(F.col("own") == F.col("all")).select(*key, "feature")


def view(alignments: DataFrame, regions: DataFrame, levels: Sequence[int] | None = None) -> DataFrame:
    """Rows that overlap any region (seq_id, start, end inclusive): a semi-join over bins."""
    on = ["line_no", *(["sample"] if "sample" in alignments.columns else [])]
    found = overlaps(read_span(alignments, on), regions.select("seq_id", F.col("start").alias("r_start"), (F.col("end") + 1).alias("r_stop")), levels)
    return alignments.join(found.select(*on).distinct(), on, "left_semi")
