"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every copy of a document is a packet of its source's flow. Within a source the documents are shuffled by a hash of their
id and the flow is the shuffled source, then the shuffled source again. A packet's virtual finish time is the flow's
cumulative size divided by the source's target; the mix is the shortest prefix of all packets, by finish time, that
uses up the total budget.

At scale: one scan of the texts makes a narrow table (id, source, size, key). Running sums are two-level: a source is cut
by key into about sqrt(rows) slices, slice totals are summed first, so that a source with a third of all rows is spread
over all tasks. Finish times are near uniform in size by construction, so equal bins of time are a range partitioning;
only the one bin that holds the cut is sorted. The mix within a source is a prefix of its flow, hence one key a source
says which documents are taken: texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, word_count

WEIGHTS = (5.0, 2.0, 1.0)
#: Up to so many sources their table is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 10_000


def shuffle_key(doc_id: str | Column) -> Column:
    return F.md5(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, F.lit("")))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size) -> with rank, weight and target: `share` of all sizes by weight, none over `most` times its size.

    The excess of capped sources, reshared by weight until none is above, is the water level at which the sum of
    min(cap, level * weight) is the budget; sorted by cap / weight, prefix sums give it in one pass. One row a source.
    """
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "rank")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    named = sizes.withColumn("rank", F.row_number().over(by_name).cast("long"))
    named = named.withColumn("weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    named = named.withColumns({"cap": F.col("source_size") * F.lit(float(most)), "ratio": F.col("source_size") * F.lit(float(most)) / F.col("weight")})
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    found = named.withColumn("level", level).withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(whole)["level"])
    capped = F.col("level").isNull() | (F.col("ratio") < F.col("level"))
    return found.withColumn("target", F.when(capped, F.col("cap")).otherwise(F.col("level") * F.col("weight"))).select("source", "source_size", "rank", "target")


def plan_mix(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """sized (source, size, key), settled -> a row a source: source, source_size, target, full_copies, last_key, has_last.

    Every document of the source is taken full_copies times, and those whose key is at most last_key once more.
    """
    slices = max(1, int(sized.count() ** 0.5))
    cut = (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(slices) / F.lit(2**32)).cast("long")
    sized = sized.select("source", "size", "key", cut.alias("slice"))
    totals = sized.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    targets = settle(source_targets(totals.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, share, most))
    n_sources, budget = targets.agg(F.count(F.lit(1)), F.sum("source_size")).first()
    budget = (budget or 0) * share
    small = F.broadcast if n_sources <= BROADCAST_SOURCES else (lambda df: df)

    in_source = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("before", F.coalesce(F.sum("slice_size").over(in_source), F.lit(0)))
    starts = starts.join(small(targets.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of"))).select(F.col("source").alias("of"), F.col("slice").alias("at"), "before", "source_size", "rank", "target")
    queued = sized.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("at")))
    in_slice = Window.partitionBy("source", "slice").orderBy("key")
    queued = queued.withColumn("done", F.col("before") + F.sum("size").over(in_slice)).where(F.col("target") > 0)
    flow = settle(queued.select("source", "key", "size", "rank", "source_size", "target", "done"))

    packets = flow.withColumn("turn", F.explode(F.array(*[F.lit(i) for i in range(most)])))
    packets = packets.withColumn("finish", (F.col("turn") * F.col("source_size") + F.col("done")) / F.col("target"))
    packets = packets.withColumn("bin", F.floor(F.col("finish") * slices))
    ordered = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = packets.groupBy("bin").agg(F.sum("size").alias("bin_size"), F.max(F.struct("finish", "rank")).alias("end")).withColumn("before", F.coalesce(F.sum("bin_size").over(ordered), F.lit(0)))
    whole = bins.where(F.col("before") + F.col("bin_size") <= budget).agg(F.max("end").alias("end")).first()["end"]
    split = bins.where((F.col("before") <= budget) & (F.col("before") + F.col("bin_size") > budget)).orderBy("bin").first()
    end = whole
    if split is not None:
        within = packets.where(F.col("bin") == split["bin"]).withColumn("sum", F.sum("size").over(Window.orderBy("finish", "rank")))
        last = within.where(F.col("sum") + split["before"] <= budget).agg(F.max(F.struct("finish", "rank")).alias("end")).first()["end"]
        end = last or whole
    taken = F.lit(False) if end is None else (F.col("finish") < end["finish"]) | ((F.col("finish") == end["finish"]) & (F.col("rank") <= end["rank"]))
    # the prefix of each flow: turns are taken in order, so the last turn begun says how many are whole
    reach = packets.where(taken).groupBy("source").agg(F.max(F.struct("turn", "key")).alias("reach"))
    reach = settle(reach.withColumnRenamed("source", "of"))
    out = targets.join(small(reach), F.col("source").eqNullSafe(F.col("of")), "left")
    return out.select("source", "source_size", "target", F.coalesce(F.col("reach.turn"), F.lit(0)).cast("int").alias("full_copies"), F.col("reach.key").alias("last_key"), F.lit(n_sources).alias("n_sources"))


def sized_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count("text").alias("size"), shuffle_key("doc_id").alias("key"))


def with_copies(rows: DataFrame, plan: DataFrame, key: Column) -> DataFrame:
    """rows with `source` -> the same with the plan's columns prefixed mix_, and mix_copies: how often the mix takes the row."""
    n = plan.first()
    plan = plan.select(F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), "full_copies", "last_key")
    plan = F.broadcast(plan) if n is None or n["n_sources"] <= BROADCAST_SOURCES else plan
    out = rows.join(plan, rows["source"].eqNullSafe(plan["mix_source"]), "left")
    copies = F.coalesce(F.col("full_copies"), F.lit(0)) + F.when(key <= F.col("last_key"), 1).otherwise(0)
    return out.withColumn("mix_copies", copies).drop("mix_source", "full_copies", "last_key")


def mix_sizes(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document.

    Null text: size 0. Null sources are one source, the last by name. Rows that repeat an id within a source share its
    place in the shuffle: all are taken, or none; so do rows without an id. Documents without words take nothing. Empty table: empty
    result. Other columns, whatever their names, are not read. Sizes of long texts are counted in the JVM, without a copy.
    """
    rows = settle(sized_rows(docs))
    plan = settle(plan_mix(rows.select("source", "size", "key"), weights, share, most))
    out = with_copies(rows, plan, F.col("key"))
    return out.select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("size") * F.col("mix_copies")).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """The mix itself: the input's columns, whatever their names, a document once for each time it is taken. Texts stay in place.

    Null texts, sources and ids, repeated rows and empty tables: as `mix_sizes` has it; documents without words go with their source's prefix.
    """
    rows = settle(sized_rows(docs).select("source", "size", "key"))
    plan = settle(plan_mix(rows, weights, share, most))
    first = plan.first()
    plan = F.broadcast(plan) if first is None or first["n_sources"] <= BROADCAST_SOURCES else plan
    names = [f"c{i}" for i in range(len(docs.columns))]
    source, doc_id = (F.col(names[docs.columns.index(c)]) for c in ("source", "doc_id"))
    copies = F.col("full_copies") + F.when(shuffle_key(doc_id.cast("string")) <= F.col("last_key"), 1).otherwise(0)
    out = docs.toDF(*names).join(plan, source.eqNullSafe(F.col("source"))).withColumn("copies", copies).where(F.col("copies") > 0)
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*names).toDF(*docs.columns)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s),
w AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM n),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE
        - coalesce(sum(cap) OVER (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY ratio, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
v AS (SELECT arg_min(level, (ratio, rk)) AS level FROM l WHERE level <= ratio),
t AS (SELECT l.source, l.source_size, l.rk, CASE WHEN v.level IS NULL OR l.ratio < v.level THEN l.cap ELSE v.level * l.weight END AS target FROM l, v),
q AS (SELECT d.doc_id, d.size, d.source, d.k, t.rk, t.source_size, t.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k) AS done
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT q.*, e.turn, (e.turn * source_size + done) / nullif(target, 0) AS finish FROM q, (VALUES (0), (1)) e(turn)),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, rk) <= (SELECT sum(size) FROM d) * 1.5::DOUBLE AS is_taken FROM p WHERE finish IS NOT NULL),
-- a row's packets share id, source and key; documents that repeat an id share their place
g AS (SELECT source, k, sum(is_taken::INT) / count(*) * 2 AS copies FROM r GROUP BY source, k)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(g.copies, 0) AS BIGINT) AS taken
FROM q LEFT JOIN g ON g.k = q.k AND g.source IS NOT DISTINCT FROM q.source
"""
