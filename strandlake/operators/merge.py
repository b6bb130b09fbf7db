"""Merging count tables: one column a sample, zero where a sample lacks a feature. Of a feature that repeats the last row counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _place(table: DataFrame, order: str) -> Column:
    """The place of a row: a column of the table, or else the order in which its rows are."""
    return F.col(order) if order in table.columns else F.monotonically_increasing_id()


def collect(counts: DataFrame, samples: Sequence[str], value: str = "value", order: str = "line_no") -> DataFrame:
    """(sample, feature, value) -> feature and a column for each of the samples, in their order: one aggregation, no joins.

    Of rows that repeat a sample's feature the last counts, by `order` if the table has that column.
    """
    rows = counts.select("sample", "feature", F.col(value).alias("_value"), _place(counts, order).alias("_place"))
    wide = rows.groupBy("feature").pivot("sample", list(samples)).agg(F.max_by("_value", "_place"))
    return wide.select("feature", *[F.coalesce(F.col(f"`{s}`"), F.lit(0.0)).alias(s) for s in samples])


def paste(tables: Sequence[DataFrame], order: str = "line_no") -> DataFrame:
    """Tables of a feature and value columns side by side; absent features count 0. Of a feature that repeats in a table its last row counts."""
    names = [c for t in tables for c in t.columns if c not in ("feature", order)]
    if len(set(names)) < len(names):
        raise ValueError(f"columns occur twice: {sorted({n for n in names if names.count(n) > 1})}")
    out = None
    for t in tables:
        part = t.select("feature", *[(F.col(f"`{n}`").cast("double") if n in t.columns else F.lit(None).cast("double")).alias(n) for n in names], _place(t, order).alias("_place"))
        own = [F.when(F.col("_place").isNotNull() & F.lit(n in t.columns), F.col("_place")).alias(f"_at_{k}") for k, n in enumerate(names)]
        part = part.select("feature", *[F.col(f"`{n}`") for n in names], *own)
        out = part if out is None else out.unionByName(part)
    merged = out.groupBy("feature").agg(*[F.max_by(F.col(f"`{n}`"), f"_at_{k}").alias(n) for k, n in enumerate(names)])
    return merged.select("feature", *[F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias(n) for n in names])
