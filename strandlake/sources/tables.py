"""Annotations (GFF, functional maps, BED), FASTA and count tables."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import failing, numbered_lines, write_single

# --- GFF -----------------------------------------------------------------------------------------------------------


def attributes(text: str | Column) -> Column:
    """The ninth column as an array of (k, v): fields end at semicolons, `=` or else a space parts key from values, values at commas.

    Only spaces around fields go, and quotation marks in values: keys and values are as they stand between the marks.
    """
    fields = F.filter(F.transform(F.split(F.regexp_replace(F.trim(text), r";$", ""), ";"), lambda x: F.trim(x)), lambda x: x != "")

    def pairs(x: Column) -> Column:
        mark = F.when(F.contains(x, F.lit("=")), F.lit("=")).otherwise(F.lit(" "))
        at = F.instr(x, mark)
        key = F.when(at == 0, x).otherwise(F.substring(x, F.lit(1), at - 1))
        value = F.when(at == 0, F.lit("")).otherwise(F.replace(F.substring(x, at + 1, F.length(x)), F.lit('"'), F.lit("")))
        return F.transform(F.split(value, ","), lambda v: F.struct(key.alias("k"), v.alias("v")))

    return F.flatten(F.transform(fields, pairs))


def gff(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, source, gtype, start, end, strand, attrs). Other than nine columns, or a strand that begins with none of + - . ?, fail the job."""
    lines = numbered_lines(spark, path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    parts = F.split("value", "\t")
    nine = failing(F.size(parts) == 9, F.concat(F.lit(f"{path}: line "), F.col("line_no").cast("string"), F.lit(" has not nine columns")))
    at = lambda k: F.get(parts, F.lit(k))
    sign = F.substring(at(6), 1, 1)
    known = failing(sign.isin("+", "-", ".", "?"), F.concat(F.lit(f"{path}: line "), F.col("line_no").cast("string"), F.lit(" has no strand")))
    strand = F.coalesce(known.cast("string"), sign)
    return lines.select(F.coalesce(nine.cast("string"), at(0)).alias("seq_id"), at(1).alias("source"), at(2).alias("gtype"), at(3).cast("long").alias("start"), at(4).cast("long").alias("end"), strand.alias("strand"), attributes(at(8)).alias("attrs"))


def bed(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, start, end): 1-based start and inclusive end of every region."""
    lines = numbered_lines(spark, path).where((F.trim("value") != "") & ~F.col("value").rlike(r"^(#|track|browser)"))
    parts = F.split("value", "\t")
    return lines.select(F.get(parts, F.lit(0)).alias("seq_id"), (F.get(parts, F.lit(1)).cast("long") + 1).alias("start"), F.get(parts, F.lit(2)).cast("long").alias("end"))


# --- functional maps -----------------------------------------------------------------------------------------------


def functional_map(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(gene, annotator, feature), a row for every value of a requested column.

    The header is the last of the leading blank or commented lines, or else the first line. The last line of a gene counts.
    """
    lines = numbered_lines(spark, path)
    comment = F.trim("value").eqNullSafe("") | F.col("value").startswith("#")
    first = lines.where(~comment).agg(F.min("line_no")).first()[0]
    header_no = max(0, (first if first is not None else 0) - 1) if first else 0
    names = lines.where(F.col("line_no") == header_no).first()["value"].lstrip("#").split("\t")
    missing = [c for c in columns if c not in names[1:]]
    if missing:
        raise ValueError(f"{path} has no columns {missing}: it has {names[1:]}")
    parts = F.split("value", "\t")
    rows = lines.where((F.col("line_no") > header_no) & (F.trim("value") != "")).select("line_no", parts.alias("cells"))
    last = rows.groupBy(F.get("cells", F.lit(0)).alias("gene")).agg(F.max_by("cells", "line_no").alias("cells"))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("annotator"), F.get("cells", F.lit(names.index(c))).alias("cell")) for c in columns]))
    cells = last.select("gene", each.alias("x")).select("gene", "x.annotator", F.explode(F.split(F.coalesce("x.cell", F.lit("")), r"[,|]")).alias("feature"))
    return cells.where(F.col("feature") != "").distinct()


# --- FASTA ---------------------------------------------------------------------------------------------------------


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(rec_no, name, header, seq, length): the lines under a header belong to it; found by the last header at or before a line."""
    lines = numbered_lines(spark, path)
    slices = lines.withColumns({"_slice": F.floor(F.col("line_no") / 100_000), "_head": F.when(F.col("value").startswith(">"), F.col("line_no"))})
    in_slice = Window.partitionBy("file", "_slice").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    ends = slices.groupBy("file", "_slice").agg(F.max("_head").alias("_m"))
    carried = ends.select("file", "_slice", F.max("_m").over(Window.partitionBy("file").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    owned = slices.withColumn("_own", F.max("_head").over(in_slice)).join(F.broadcast(carried), ["file", "_slice"]).withColumn("rec_no", F.coalesce("_own", "_carried"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("value").startswith(">"), F.struct("line_no", "value")))), lambda x: x["value"]), "")
    rows = owned.groupBy("rec_no").agg(F.max(F.when(F.col("_head").isNotNull(), F.expr("substring(value, 2)"))).alias("header"), text.alias("seq"))
    return rows.select("rec_no", F.regexp_extract("header", r"^\S*", 0).alias("name"), "header", "seq", F.length("seq").cast("long").alias("length"))


def split_blocks(sizes: DataFrame, block_bases: int) -> dict[str, int]:
    """Sequence name -> block: sequences in order, a block filled up to its bases, a longer sequence alone. Over the index only."""
    block, room, out = -1, 0, {}
    for r in sizes.select("rec_no", "name", "length").orderBy("rec_no").toLocalIterator():
        if block < 0 or r["length"] > room:
            block, room = block + 1, block_bases
        out[r["name"]] = block
        room -= r["length"]
    return out


def split_fasta(spark: SparkSession, path: str, base: str, block_bases: int) -> list[str]:
    """The files `base`.k.fna of the blocks of a FASTA file; a receipt beside them says that they are whole, and they are used again."""
    receipt = f"{base}.done"
    folder, name = os.path.split(os.path.abspath(base))
    if not os.path.exists(receipt):
        sequences = fasta(spark, path)
        blocks = split_blocks(sequences, block_bases)
        named = spark.createDataFrame(list(blocks.items()), "_name string, block int")
        rows = sequences.join(named, F.col("name") == F.col("_name")).withColumn("line", F.concat(F.lit(">"), "header", F.lit("\n"), "seq"))
        for k in range(max(blocks.values(), default=-1) + 1):
            write_single(rows.where(F.col("block") == k).orderBy("rec_no"), f"{base}.{k}.fna")
        with open(receipt, "w", encoding="utf-8") as file:
            file.write(f"{path} in blocks of {block_bases} bases\n")
    found = [x for x in os.listdir(folder) if x.startswith(name + ".") and x.endswith(".fna")]
    return [os.path.join(folder, x) for x in sorted(found, key=lambda x: (len(x), x))]


# --- count tables --------------------------------------------------------------------------------------------------


def _shortest(v: float) -> str:
    """The shortest decimal that reads back, whole numbers without a point."""
    if v != v or v in (float("inf"), float("-inf")):
        return {"nan": "NaN"}.get(str(v), str(v))
    if v == int(v) and abs(v) < 1e300:
        return str(int(v))
    text = repr(v)
    if "e" in text:
        from decimal import Decimal

        text = format(Decimal(text), "f")
    return text


def count_lines(counts: DataFrame, values: list[str], separator: str = "\t") -> DataFrame:
    """feature and value columns -> one `line` each; numbers become text only here."""
    text = F.pandas_udf(lambda s: s.map(_shortest), "string")
    return counts.withColumn("line", F.concat_ws(separator, "feature", *[text(F.col(f"`{v}`").cast("double")) for v in values]))


def feature_order() -> list[Column]:
    """The unassigned row of an annotation first, then names bytewise."""
    return [F.when(F.col("feature").rlike(r"(^|:)-1$"), 0).otherwise(1).asc(), F.col("feature").asc()]


def write_counts(counts: DataFrame, path: str, values: list[str], format: str = "tsv", comments: list[str] = ()) -> str:
    """A table of feature and value columns to one file, with comments and a header of sample names."""
    if format not in ("tsv", "csv"):
        raise ValueError(f"format must be tsv or csv, not {format!r}")
    separator = "\t" if format == "tsv" else ","
    header = [*(f"# {c}" for c in comments), separator.join(["", *values])]
    return write_single(count_lines(counts, values, separator).orderBy(*feature_order()), path, header)


def countfile(spark: SparkSession, path: str, keep_order: bool = False) -> DataFrame:
    """(feature, one column a sample): rows sorted by feature, bytewise; comments are passed over. keep_order adds line_no."""
    lines = numbered_lines(spark, path).where(~(F.col("value").startswith("#") | (F.trim("value") == "")))
    top = lines.orderBy("line_no").first()
    names = top["value"].split("\t")[1:]
    parts = F.split("value", "\t")
    rows = lines.where(F.col("line_no") > top["line_no"])
    table = rows.select("line_no", F.get(parts, F.lit(0)).alias("feature"), *[F.get(parts, F.lit(k + 1)).cast("double").alias(n) for k, n in enumerate(names)])
    return table.orderBy("feature", "line_no") if keep_order else table.orderBy("feature", "line_no").drop("line_no")


def output_hash(script: str = "", plan: DataFrame | None = None) -> str:
    """MD5 of a script without comments and blank space, or else of a plan without the numbers that Spark gives its columns."""
    import hashlib
    import re

    if script:
        lines = (" ".join(line.partition("#")[0].split()) for line in script.splitlines())
        text = "\n".join(line for line in lines if line)
    else:
        text = re.sub(r"#\d+L?", "", plan._jdf.queryExecution().analyzed().canonicalized().toString())
    return hashlib.md5(text.encode()).hexdigest()


def auto_comments(kinds: Sequence[str], script: str = "", plan: DataFrame | None = None) -> list[str]:
    """Comment lines: the date of the run, the script's text, a hash of the computation. The wording is fixed by the format."""
    import datetime

    out: list[str] = []
    for kind in kinds:
        if kind == "date":
            out.append(f"Script run on {datetime.datetime.now():%a %d-%m-%Y %H:%M}")
        elif kind == "script":
            out += ["Output generated by:", *(f"    {line}" for line in script.splitlines())]
        elif kind == "hash":
            out.append(f"Output hash: {output_hash(script, plan)}")
        else:
            raise ValueError(f"unknown comment {kind!r}: date, script or hash")
    return out
