"""Alignments by group: selection, filters, best hits, pairs, merging, statistics.

Rows carry `group_id` and `line_no`. Conditions on a group are window aggregates over it, so that a chain of conditions on one
grouping is one shuffle. `sample`, where there is one, is part of the key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sam import FIRST, PROPER, REVERSE, SECOND, UNMAPPED, aligned, bit, group_ids
from ..sources.text import failing
from .count import choice

CONDITIONS = ("mapped", "unmapped", "unique")


def group_key(rows: DataFrame) -> list[str]:
    return [*(["sample"] if "sample" in rows.columns else []), "group_id"]


def bucket() -> Column:
    """0 first in pair, 1 second, 2 other."""
    return F.when(bit(FIRST), 0).when(bit(SECOND), 1).otherwise(2)


def has_sequence() -> Column:
    return F.col("seq") != "*"


def match_size(cigar: str | Column = "cigar", inserted: bool = False, clipped: bool = False) -> Column:
    """Bases matched by a CIGAR (and inserted, and soft-clipped); null if it is malformed. An empty one matches none."""
    cigar = F.col(cigar) if isinstance(cigar, str) else cigar
    ops = "M=X" + "I" * inserted + "S" * clipped
    sizes = F.transform(F.regexp_extract_all(cigar, F.lit(rf"(\d+)[{ops}]"), 1), lambda n: n.cast("long"))
    return F.when(cigar.rlike(r"^(\d+[^\d])*$"), F.aggregate(sizes, F.lit(0).cast("long"), lambda a, n: a + n))


def int_tag(tag: str, extra: str = "extra") -> Column:
    return F.regexp_extract(extra, rf"(?:^|\t){tag}:i:([+-]?\d+)", 1).try_cast("long")


def is_unique(window) -> Column:
    """One row at most, or two of different mates that are not both aligned to different sequences."""
    n = F.count(F.lit(1)).over(window)
    one, two = F.max(bit(FIRST).cast("int")).over(window), F.min(bit(FIRST).cast("int")).over(window)
    both = F.min(aligned().cast("int")).over(window) == 1
    same = F.min("rname").over(window) == F.max("rname").over(window)
    return (n <= 1) | ((n == 2) & (one != two) & (~both | same))


def _condition(rows: DataFrame, name: str, keep: bool) -> DataFrame:
    group = Window.partitionBy(*group_key(rows))
    if (name == "mapped") == keep and name != "unique":
        return rows.where(aligned())
    test = is_unique(group) if name == "unique" else F.max(aligned().cast("int")).over(group) == 0
    wanted = test if (keep or name != "unique") else ~test
    return rows.withColumn("_keep", wanted).where("_keep").drop("_keep")


def is_sorted(rows: DataFrame) -> bool:
    """Whether the frame is what `sort` returned: its groups are no neighbours any more."""
    return getattr(rows, "_strandlake_sorted", False)


def select(rows: DataFrame, keep_if: Sequence[str] = (), drop_if: Sequence[str] = (), paired: bool = True, reinject: bool = True) -> DataFrame:
    """Conditions in turn, each on what the one before left. Sequences that got lost come back, unless reinject is off.

    Unique reads cannot be selected from sorted alignments: select first.
    """
    if keep_if and drop_if:
        raise ValueError("select takes keep_if or drop_if, not both")
    if "unique" in [*keep_if, *drop_if] and is_sorted(rows):
        raise ValueError("unique reads cannot be selected from sorted alignments: select, then sort")
    out = rows if paired else group_ids(rows.drop("group_id"), paired=False)
    if not keep_if and not drop_if:
        return out
    out = with_donors(out) if reinject else out
    for name in keep_if or drop_if:
        out = _condition(out, choice("condition", name, CONDITIONS), bool(keep_if))
    return reinjected(out) if reinject else out


def with_donors(rows: DataFrame) -> DataFrame:
    """Adds _donors: the rows with sequence (line, sequence, qualities) of a mate that also has rows without; null for other mates."""
    mate = Window.partitionBy(*group_key(rows), bucket())
    donor = F.when(has_sequence() & (F.min(has_sequence().cast("int")).over(mate) == 0), F.struct("line_no", "seq", "qual"))
    out = rows.withColumn("_donor", donor)
    return out.withColumn("_donors", F.array_sort(F.collect_list("_donor").over(mate))).drop("_donor")


def reinjected(rows: DataFrame) -> DataFrame:
    """The first row of a mate without any sequence left takes that of the first of its donors that fits its CIGAR.

    Hard clips count as soft ones, and are written so, if the sequence fits only then.
    """
    mate = Window.partitionBy(*group_key(rows), bucket())
    bare = F.max(has_sequence().cast("int")).over(mate) == 0
    rows = rows.withColumn("_needs", bare & (F.row_number().over(mate.orderBy("line_no")) == 1) & (F.size("_donors") > 0))
    plain, soft = match_size("cigar", True, True), match_size(F.replace("cigar", F.lit("H"), F.lit("S")), True, True)
    rows = rows.withColumns({"_plain": plain, "_soft": soft})
    fits = F.filter("_donors", lambda d: (F.length(d["seq"]) == F.col("_plain")) | (F.length(d["seq"]) == F.col("_soft")))
    rows = rows.withColumn("_d", F.when(F.col("_needs"), F.get(fits, F.lit(0))))
    softened = F.when(F.col("_d").isNotNull() & (F.length("_d.seq") != F.col("_plain")), F.replace("cigar", F.lit("H"), F.lit("S"))).otherwise(F.col("cigar"))
    out = rows.withColumns({"cigar": softened, "seq": F.coalesce("_d.seq", "seq"), "qual": F.coalesce("_d.qual", "qual")})
    return out.drop("_needs", "_donors", "_plain", "_soft", "_d")


class GroupBlock:
    """Statements on the groups of alignments, compiled to columns and filters: all but pe_filter in one grouping.

    `when` is a condition on groups (flag, some_match, or comparisons of them). A statement after a discard or a stop does nothing
    for that group. Groups that lose all their rows vanish.
    """

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows.withColumn("_active", F.lit(True))

    def _on(self, when: Column | None) -> Column:
        return F.col("_active") if when is None else F.col("_active") & F.coalesce(when, F.lit(False))

    def flag(self, name: str = "mapped") -> Column:
        return with_flag(self.rows, name)

    def some_match(self, name: str) -> Column:
        return some_match(self.rows, name)

    def _masked(self, keep: Column, when: Column | None) -> None:
        rows = self.rows.withColumns({"_on": self._on(when), "_keep": F.coalesce(keep, F.lit(False))})
        self.rows = rows.where(~F.col("_on") | F.col("_keep")).drop("_on", "_keep")

    def unique(self, when: Column | None = None) -> None:
        self._masked(is_unique(Window.partitionBy(*group_key(self.rows))), when)

    def allbest(self, when: Column | None = None) -> None:
        self._masked(is_best(self.rows), when)

    def filter(self, when: Column | None = None, **options) -> None:
        self.rows = filter_matches(self.rows.withColumn("_on", self._on(when)), **options, only=F.col("_on")).drop("_on")

    def pe_filter(self, when: Column | None = None) -> None:
        rows = self.rows.withColumn("_on", self._on(when))
        self.rows = rows.where(~F.col("_on")).unionByName(pe_filter(rows.where("_on")).drop("pair_line", "pair_mate")).drop("_on")

    def discard(self, when: Column | None = None) -> None:
        self.rows = self.rows.withColumn("_on", self._on(when)).where(~F.col("_on")).drop("_on")

    def stop(self, when: Column | None = None) -> None:
        """continue: the group stays as it is now."""
        self.rows = self.rows.withColumn("_active", F.col("_active") & ~self._on(when))


def select_block(rows: DataFrame, block: Callable[[GroupBlock], None], paired: bool = True) -> DataFrame:
    """Run a block on every group; sequences that got lost come back. Rows of a group are in the order of mates: see in_mate_order."""
    out = rows if paired else group_ids(rows.drop("group_id"), paired=False)
    run = GroupBlock(with_donors(out))
    block(run)
    return reinjected(run.rows.drop("_active"))


def in_mate_order(rows: DataFrame) -> tuple[str | Column, ...]:
    """Sort keys of rewritten groups: first mates, second ones, others, each in the order of lines."""
    return ("group_id", bucket(), "line_no")


def unique(rows: DataFrame) -> DataFrame:
    return _condition(rows, "unique", True)


def with_flag(rows: DataFrame, name: str = "mapped") -> Column:
    """Whether the group has an aligned row (mapped) or none (unmapped)."""
    any_aligned = F.max(aligned().cast("int")).over(Window.partitionBy(*group_key(rows))) == 1
    return any_aligned if choice("flag", name, ("mapped", "unmapped")) == "mapped" else ~any_aligned


def some_match(rows: DataFrame, name: str) -> Column:
    return F.max((F.col("rname") == name).cast("int")).over(Window.partitionBy(*group_key(rows))) == 1


def pe_filter(rows: DataFrame) -> DataFrame:
    """Every aligned forward row with the first aligned reverse row of its group on the same sequence; rows may repeat.

    Adds pair_line, the forward row's line number, and pair_mate: 0 forward, 1 reverse.
    """
    key = group_key(rows)
    fields = [c for c in rows.columns if c not in key]
    good = rows.where(aligned())
    reverse = good.where(bit(REVERSE)).groupBy(*key, "rname").agg(F.min_by(F.struct(*fields), "line_no").alias("_reverse"))
    pairs = good.where(~bit(REVERSE)).select(*key, "rname", F.struct(*fields).alias("_forward")).join(reverse, [*key, "rname"])
    both = pairs.select(*key, F.col("_forward.line_no").alias("pair_line"), F.posexplode(F.array("_forward", "_reverse")).alias("pair_mate", "_row"))
    return both.select(*key, *[F.col(f"_row.{c}").alias(c) for c in fields], "pair_line", "pair_mate")


def allbest(rows: DataFrame) -> DataFrame:
    """Of each mate's rows with an NM tag and a readable CIGAR those of least NM; mates without such rows stay as they are."""
    return rows.withColumn("_keep", is_best(rows)).where("_keep").drop("_keep")


def is_best(rows: DataFrame) -> Column:
    mate = Window.partitionBy(*group_key(rows), bucket())
    distance = F.when(match_size().isNotNull(), int_tag("NM"))
    least = F.min(distance).over(mate)
    return (F.count(F.lit(1)).over(mate) <= 1) | least.isNull() | F.coalesce(distance == least, F.lit(False))


def filter_matches(rows: DataFrame, min_identity_pc: float = -1, min_match_size: int = -1, max_trim: int = -1, reverse: bool = False, action: str = "drop", only: Column | None = None) -> DataFrame:
    """Rows by identity, matched bases and trimmed bases; those that fail are dropped or unmatched. reverse turns the first two around.

    `only` says which rows are tested at all.
    """
    choice("action", action, ("drop", "unmatch"))
    size, errors = F.coalesce(match_size(), F.lit(0)), int_tag("NM")
    identity = F.when(match_size().isNull() | errors.isNull(), 0.0).when(size == 0, F.lit(-1.0)).otherwise((size - errors) / F.when(size == 0, 1).otherwise(size))
    ok = F.lit(True)
    if min_identity_pc >= 0:
        ok = ok & (identity >= min_identity_pc / 100.0)
    if min_match_size != -1:
        ok = ok & (size >= min_match_size)
    free = F.lit(False) if only is None else ~only
    out = _act(rows, free | (~ok if reverse else ok), action)
    if max_trim == -1:
        return out
    longest = F.max(F.length("seq")).over(Window.partitionBy(*group_key(rows), bucket()))
    return _act(out, free | (longest - size <= max_trim), action)


def _act(rows: DataFrame, ok: Column, action: str) -> DataFrame:
    rows = rows.withColumn("_ok", ok)
    if action == "drop":
        return rows.where("_ok").drop("_ok")
    flag = F.col("flag").bitwiseOR(F.lit(UNMAPPED)).bitwiseAND(F.lit(~PROPER))
    blank = lambda c: F.when(F.col("_ok"), F.col(c)).otherwise("*")
    return rows.withColumns({"flag": F.when(F.col("_ok"), F.col("flag")).otherwise(flag), "rname": blank("rname"), "cigar": blank("cigar")}).drop("_ok")


def merge_best(parts: Sequence[DataFrame]) -> DataFrame:
    """The same reads aligned to several references: groups are matched by position, and of each mate the best rows stay.

    Every part has group_no (the position of its group); parts with different groups fail the job. If no row of a mate is aligned the
    last in file order stays; else the aligned ones of the largest matched and inserted bases less NM. Adds `part`.
    """
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("part", F.lit(k))
        out = p if out is None else out.unionByName(p)
    sample = ["sample"] if "sample" in out.columns else []
    score = F.when(aligned(), F.coalesce(match_size(inserted=True), F.lit(0)) - F.coalesce(int_tag("NM"), F.lit(0)))
    # scores are made before the shuffle, so that only what is asked for goes through it; one order by group, mate and place serves all windows
    out = out.withColumns({"_score": score, "_mate": bucket()}).repartition("group_no")
    group, mate = Window.partitionBy("group_no", *sample), Window.partitionBy("group_no", *sample, "_mate")
    out = out.withColumn("_rn", F.row_number().over(mate.orderBy(F.desc("part"), F.desc("line_no")))).withColumn("_best", F.max("_score").over(mate))
    parted = F.bit_count(F.bit_or(F.expr("shiftleft(1L, part)")).over(group)) if len(parts) < 64 else F.size(F.collect_set("part").over(group))
    whole = failing(parted == len(parts), F.lit("the alignments to merge have different numbers of groups"))
    out = out.withColumn("part", F.coalesce(whole.cast("int"), F.col("part")))
    return out.where(F.when(F.col("_best").isNull(), F.col("_rn") == 1).otherwise(F.col("_score") == F.col("_best"))).drop("_score", "_best", "_rn", "_mate")


def with_group_no(rows: DataFrame) -> DataFrame:
    """Positions of groups in their file, from 0: a prefix sum in two steps over slices of lines."""
    sample = ["sample"] if "sample" in rows.columns else []
    firsts = rows.where(F.col("line_no") == F.col("group_id")).select(*sample, "group_id", F.floor(F.col("group_id") / 100_000).alias("_slice"))
    counts = firsts.groupBy(*sample, "_slice").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.select(*sample, "_slice", F.coalesce(F.sum("_c").over(Window.partitionBy(*sample).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = firsts.join(before, [*sample, "_slice"]).withColumn("group_no", F.col("_before") + F.row_number().over(Window.partitionBy(*sample, "_slice").orderBy("group_id")) - 1)
    return rows.join(numbered.select(*sample, "group_id", "group_no"), [*sample, "group_id"])


def as_reads(rows: DataFrame) -> DataFrame:
    """Reads of the rows with sequence: a lone row of a group is a singleton; else its first first and first second mate, as far as there are."""
    key = group_key(rows)
    row = F.struct("line_no", "qname", "seq", "qual")
    with_seq = rows.where(has_sequence())
    groups = with_seq.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.min(row).alias("any"),
        F.min(F.when(bit(FIRST), row)).alias("a"), F.min(F.when(bit(SECOND) & ~bit(FIRST), row)).alias("b"),
    )
    single = F.array(F.struct(F.lit(0).alias("mate"), F.when(F.col("n") == 1, F.col("any")).otherwise(F.coalesce("a", "b")).alias("r")))
    pair = F.array(F.struct(F.lit(1).alias("mate"), F.col("a").alias("r")), F.struct(F.lit(2).alias("mate"), F.col("b").alias("r")))
    reads = groups.withColumn("x", F.explode(F.when((F.col("n") > 1) & F.col("a").isNotNull() & F.col("b").isNotNull(), pair).otherwise(single))).where(F.col("x.r").isNotNull())
    return reads.select(*[c for c in key if c != "group_id"], F.lit(0).alias("file_id"), F.col("x.mate").cast("tinyint").alias("mate"), F.col("group_id").alias("rec_no"), F.concat(F.lit("@"), F.col("x.r.qname")).alias("header"), F.col("x.r.seq").alias("seq"), F.col("x.r.qual").alias("text"))


def mapstats(rows: DataFrame) -> DataFrame:
    """(sample..., total, aligned, unique) by group: aligned if any row is, unique if then all rows name one sequence."""
    key = group_key(rows)
    groups = rows.groupBy(*key).agg(F.max(aligned().cast("int")).alias("a"), (F.min("rname") == F.max("rname")).alias("one"))
    counts = [F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("a"), F.lit(0)).alias("aligned"), F.coalesce(F.sum((F.col("one") & (F.col("a") == 1)).cast("long")), F.lit(0)).alias("unique")]
    return groups.groupBy("sample").agg(*counts) if "sample" in key else groups.agg(*counts)


def stats_table(stats: Sequence[tuple[str, str, int, DataFrame]]) -> DataFrame:
    """(input file, reference, line number, statistics) of mappings, in order -> (feature, value) rows `i:key`."""
    out = None
    for i, (file, reference, line, found) in enumerate(stats):
        values = {"aligned": F.col("aligned"), "inputFile": F.lit(file), "lineNumber": F.lit(line), "reference": F.lit(reference), "total": F.col("total"), "unique": F.col("unique")}
        each = F.explode(F.array(*[F.struct(F.lit(f"{i}:{k}").alias("feature"), v.cast("string").alias("value")) for k, v in values.items()]))
        part = found.select(each.alias("x")).select("x.feature", "x.value")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no mapping to tell of")
    return out


def name_key(name: str = "qname") -> Column:
    """Runs of digits padded to 20 digits, and all runs joined by NUL: bytewise order is that of names, numbers in them as numbers.

    Names with one number at most, at their end, need no regular expression.
    """
    digits, name = F.lit("0123456789"), F.col(name)
    parts = F.transform(F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), 1), lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p))
    text = F.rtrim(name, digits)
    number = F.lpad(F.substring(name, F.length(text) + 1, F.length(name)), 20, "0")
    plain = F.when(text == name, name).when(text == "", number).otherwise(F.concat(text, F.lit("\x00"), number))
    return F.when(F.translate(text, "0123456789", "") == text, plain).otherwise(F.array_join(parts, "\x00"))


def sort(rows: DataFrame, by: str = "coordinate", order: DataFrame | None = None) -> DataFrame:
    """By position, sequences in the header's order (hdr_no, sn) and unplaced rows last; or by read name, numbers in it as numbers."""
    if choice("by", by, ("coordinate", "name")) == "name":
        # columns: a sort key that is an expression is computed anew in every comparison
        out = rows.withColumns({"_name": name_key(), "_mate": bucket()}).orderBy("_name", "_mate", "line_no").drop("_name", "_mate")
    elif order is not None:
        ranks = order.where(F.col("sn").isNotNull()).select(F.col("sn").alias("rname"), F.col("hdr_no").alias("_rank"))
        out = rows.join(ranks, "rname", "left").orderBy(F.col("_rank").asc_nulls_last(), "pos", bit(REVERSE), "line_no").drop("_rank").select(*rows.columns)
    else:
        out = rows.orderBy(F.col("rname") == "*", "rname", "pos", bit(REVERSE), "line_no")
    out._strandlake_sorted = True
    return out
