"""Counting in one call: one annotation source, its files found and read, hits and counts made of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions import References
from ..sources.checks import check_input
from ..sources.sam import sequences
from ..sources.tables import functional_map as read_map
from ..sources.tables import gff
from ..sources.text import settled
from . import count as c
from . import intervals as iv

SEQNAME = ("seqname",)


def annotation_source(features: Sequence[str], functional_map: str | None, gff_file: str | None, reference: str | None, carried: str | None = None, references: References | None = None) -> tuple[str, str]:
    """(kind, path): seqname before a functional map before a GFF file before a reference, given or carried by the alignments.

    More than one given is an error, so that none is silently ignored.
    """
    given = [n for n, x in (("features=['seqname']", tuple(features) == SEQNAME), ("functional_map", functional_map), ("gff_file", gff_file), ("reference", reference)) if x]
    if len(given) > 1:
        raise ValueError(f"only one annotation source can be given, not {', '.join(given)}")
    if tuple(features) == SEQNAME:
        return "seqname", ""
    if functional_map:
        return "map", functional_map
    if gff_file:
        return "gff", gff_file
    name = reference or carried
    if not name:
        raise ValueError("counting needs features=['seqname'], a functional_map, a gff_file or a reference")
    files = (references or References()).find(name)
    found = [(kind, files[key]) for kind, key in (("gff", "gff_file"), ("map", "functional_map")) if files.get(key)]
    if len(found) != 1:
        raise ValueError(f"reference {name!r} has {'both kinds of' if found else 'no'} annotation file")
    return found[0]


def count_alignments(
    spark: SparkSession, rows: DataFrame, head: DataFrame | None = None, features: Sequence[str] = ("gene",), subfeatures: Sequence[str] | None = None, functional_map: str | None = None,
    gff_file: str | None = None, reference: str | None = None, carried: str | None = None, references: References | None = None, search_path: Sequence[str] = (), mode: str = "union", multiple: str = "dist1",
    sense: str = "both", normalization: str | None = None, norm: bool = False, include_minus1: bool = True, min: float = 0, discard_zeros: bool = False, by: Sequence[str] = (),
) -> DataFrame:
    """(by..., feature, value) of alignments with group_id and line_no; head: their header lines (for seqname, and sizes of genes).

    With several columns of a functional map names carry their column; names of GFF features carry their type if there are several.
    """
    kind, path = annotation_source(features, functional_map, gff_file, reference, carried, references)
    normalization = normalization or ("normed" if norm else "raw")
    options = {"multiple": multiple, "normalization": normalization, "minimum": min, "discard_zeros": discard_zeros, "include_minus1": include_minus1, "by": by}
    if kind == "seqname":
        names = sequences(head)
        sized = names.selectExpr("'seqname' AS annotator", "feature", "size")
        out = c.count(rows, c.seqname_hits(rows, names, by), sized, **options)
    elif kind == "map":
        genes = settled(read_map(spark, check_input(path, search_path), list(features)))
        out = c.labelled(c.count(rows, c.map_hits(rows, genes, by), c.map_features(genes, sequences(head) if head is not None else None, normalization), **options), len(features))
    else:
        regions = settled(iv.gff_features(gff(spark, check_input(path, search_path)), features, subfeatures))  # lines are parsed once, for bins, sizes and hits
        out = c.count(rows, iv.interval_hits(rows, regions, mode, sense, by), iv.interval_features(regions), **options)
    return out.select(*by, "feature", "value")
