"""Queries of sources and sinks: the views are written out as files, in a scratch folder of the query, and read back."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotate, merge
from ..operators import mapped as m
from ..operators import reads as r
from ..sources import fastq, sam, tables, text
from ..sources.write import write
from . import views as v
from .catalog import GFF_ALL1, MAP_1_OVER_N, SEQNAME_DIST1
from .registered import query


def _folder(spark: SparkSession) -> str:
    return text.local_path(text.scratch(spark))


def _quality(qual: str | Column = "qual") -> Column:
    return F.array_join(F.transform(qual, lambda q: q.cast("string")), ",")


# --- reads ---------------------------------------------------------------------------------------------------------

#: Reads of one sample with headers that tell mates: number is the place in its file.
_NAMED = f"""{v.READS_SQL}, named AS (
  SELECT *, CASE WHEN mate = 0 THEN vec_id ELSE vec_id // 2 END AS rec, CASE WHEN mate = 0 THEN '@s' || vec_id ELSE '@p' || (vec_id // 2) || '/' || mate END AS head,
    array_to_string(qual, ',') AS quals, array_to_string(list_transform(qual, lambda q: chr(q + 33)), '') AS coded FROM rd),
placed AS (SELECT *, row_number() OVER (PARTITION BY mate ORDER BY rec) - 1 AS number FROM named)"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.reads(spark, sf_dir).withColumn("sample", F.lit("s"))
    pair = F.concat(F.lit("@p"), F.col("rec_no").cast("string"), F.lit("/"), F.col("mate").cast("string"))
    return rows.withColumn("header", F.when(F.col("mate") == 0, F.concat(F.lit("@s"), F.col("vec_id").cast("string"))).otherwise(pair)).drop("vec_id")


def _singles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.reads(spark, sf_dir)
    return rows.withColumns({"sample": F.lit("s"), "mate": F.lit(0).cast("tinyint"), "rec_no": F.col("vec_id").cast("long")}).drop("vec_id")


def _fastq(spark: SparkSession, sf_dir: str, extension: str, offset: int = 33, encoding: str = "auto") -> DataFrame:
    path = f"{_folder(spark)}/reads.fq{extension}"
    write(_singles(spark, sf_dir), path, offset=offset)
    return fastq.fastq(spark, path, encoding).select("rec_no", "header", "seq", _quality().alias("qual"))


_IN_ORDER = f"WITH {v.READS_SQL} SELECT row_number() OVER (ORDER BY vec_id) - 1 AS rec_no, header, seq, array_to_string(qual, ',') AS qual FROM rd"
for _ext in ("", ".gz", ".bz2", ".xz", ".zst"):
    query(f"source_fastq{_ext.replace('.', '_')}", _IN_ORDER)(lambda s, d, x=_ext: _fastq(s, d, x))
query("source_fastq_offset_64", _IN_ORDER)(lambda s, d: _fastq(s, d, ".gz", 64))
query("source_fastq_solexa", _IN_ORDER)(lambda s, d: _fastq(s, d, "", 64, "solexa"))


@query("source_fastq_subsampled", f"WITH {v.READS_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS rec_no FROM rd) SELECT rec_no, header FROM n WHERE rec_no % 10 = 0 AND rec_no < 250000")
def _subsampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark)}/reads.fq"
    write(_singles(spark, sf_dir), path)
    return fastq.fastq(spark, path, subsample=True).select("rec_no", "header")


@query("source_interleaved", f"WITH {_NAMED} SELECT CAST(mate AS TINYINT) AS mate, number AS rec_no, head AS header, seq, quals AS qual FROM placed")
def _interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark)}/all.fq.gz"
    write(_named(spark, sf_dir), path, format_flags=["interleaved"])
    return fastq.fastq(spark, path, interleaved=True).select("mate", "rec_no", "header", "seq", _quality().alias("qual"))


@query("source_paired", f"WITH {_NAMED} SELECT CAST(mate AS TINYINT) AS mate, number AS rec_no, CAST(CASE WHEN mate = 0 THEN 1 ELSE 0 END AS INT) AS file_id, head AS header, seq, quals AS qual FROM placed")
def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{_folder(spark)}/x"
    write(_named(spark, sf_dir), f"{base}.fq.gz")
    got = fastq.paired(spark, f"{base}.pair.1.fq.gz", f"{base}.pair.2.fq.gz", f"{base}.singles.fq.gz")
    return got.select("mate", "rec_no", "file_id", "header", "seq", _quality().alias("qual"))


_DIRECTORY = f"""WITH {_NAMED}, f AS (SELECT *, CASE WHEN mate = 0 THEN 3 WHEN rec % 2 = 0 THEN 0 ELSE 2 END AS file_id FROM named)
SELECT CAST(mate AS TINYINT) AS mate, CAST(file_id AS INT) AS file_id, row_number() OVER (PARTITION BY mate, file_id ORDER BY rec) - 1 AS rec_no, head AS header FROM f"""


def _directory(spark: SparkSession, sf_dir: str, load) -> DataFrame:
    """Even pairs in files named _1 and _2, odd ones in .pair.1 and .pair.2 beside the singletons."""
    folder, rows = _folder(spark), _named(spark, sf_dir)
    write(rows.where((F.col("mate") > 0) & (F.col("rec_no") % 2 == 0)), f"{folder}/a.fq")
    for k in "12":
        os.rename(f"{folder}/a.pair.{k}.fq", f"{folder}/a_{k}.fq")
    write(rows.where((F.col("mate") == 0) | (F.col("rec_no") % 2 == 1)), f"{folder}/b.fq.bz2")
    os.rename(f"{folder}/b.singles.fq.bz2", f"{folder}/b.single.fq.bz2")
    return load(spark, folder).select("mate", "file_id", "rec_no", "header")


query("source_directory", _DIRECTORY)(lambda s, d: _directory(s, d, fastq.load_fastq_directory))
query("source_mocat_directory", _DIRECTORY)(lambda s, d: _directory(s, d, fastq.load_mocat_sample))


def _manifest(spark: SparkSession, sf_dir: str) -> str:
    folder, rows = _folder(spark), v.reads(spark, sf_dir).drop("vec_id")
    lines = ["basedir: " + folder, "samples:"]
    for name in ("s3", "s0", "s2", "s1"):
        write(rows.where(F.col("sample") == name), f"{folder}/{name}.fq")
        lines += [f"  {name}:", "    - paired:", f"      - {name}.pair.1.fq", f"      - {name}.pair.2.fq", f"    - single: {name}.singles.fq"]
    with open(f"{folder}/samples.yaml", "w", encoding="utf-8") as file:
        file.write("\n".join(lines) + "\n")
    return f"{folder}/samples.yaml"


_SAMPLES = f"WITH {v.READS_SQL} SELECT sample, CAST(mate AS TINYINT) AS mate, header, seq FROM rd"
query("source_sample_list", _SAMPLES)(lambda s, d: fastq.load_sample_list(s, _manifest(s, d)).select("sample", "mate", "header", "seq"))
query("source_sample_from_yaml", _SAMPLES + " WHERE sample = 's2'")(lambda s, d: fastq.load_sample_from_yaml(s, _manifest(s, d), "s2").select("sample", "mate", "header", "seq"))

_RECORD_LINES = "[head, seq, '+', coded]"


@query(
    "sink_reads",
    f"""WITH {_NAMED}, l AS (SELECT CASE mate WHEN 0 THEN 'x.singles.fq.gz' WHEN 1 THEN 'x.pair.1.fq.gz' ELSE 'x.pair.2.fq.gz' END AS name, number, {_RECORD_LINES} AS lines FROM placed)
SELECT name, number * 4 + generate_subscripts(lines, 1) - 1 AS line_no, unnest(lines) AS value FROM l""",
)
def _sink_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    write(_named(spark, sf_dir), f"{folder}/x.fq.gz")
    lines = text.numbered_lines(spark, [f"{folder}/{n}" for n in sorted(os.listdir(folder)) if n.endswith(".fq.gz")])
    return lines.select(F.substring_index("file", "/", -1).alias("name"), "line_no", "value")


@query("sink_reads_template", f"WITH {_NAMED} SELECT CASE mate WHEN 0 THEN 'x-singles.fq' WHEN 1 THEN 'x-pair.1.fq' ELSE 'x-pair.2.fq' END AS name, count(*) * 4 AS lines FROM placed GROUP BY 1")
def _sink_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    write(_named(spark, sf_dir), folder + "/x-{index}.fq")
    lines = text.numbered_lines(spark, [f"{folder}/{n}" for n in sorted(os.listdir(folder)) if n.endswith(".fq")])
    return lines.groupBy(F.substring_index("file", "/", -1).alias("name")).agg(F.count(F.lit(1)).alias("lines"))


@query(
    "sink_interleaved",
    f"""WITH {_NAMED}, o AS (SELECT row_number() OVER (ORDER BY mate = 0, rec, mate) - 1 AS spot, {_RECORD_LINES} AS lines FROM named)
SELECT spot * 4 + generate_subscripts(lines, 1) - 1 AS line_no, unnest(lines) AS value FROM o""",
)
def _sink_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark)}/x.fq"
    write(_named(spark, sf_dir), path, format_flags=["interleaved"])
    return text.numbered_lines(spark, path).select("line_no", "value")


# --- alignments ----------------------------------------------------------------------------------------------------


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.alignments(spark, sf_dir).withColumns({"rnext": F.lit("*"), "pnext": F.lit(0).cast("long"), "tlen": F.lit(0).cast("long")})


def _head(spark: SparkSession, sf_dir: str) -> DataFrame:
    sq = v.sequences(spark, sf_dir)
    lines = sq.select(F.col("feature").cast("long").alias("hdr_no"), F.concat(F.lit("@SQ\tSN:"), "feature", F.lit("\tLN:"), F.col("size").cast("long").cast("string")).alias("line"))
    return lines.unionByName(spark.createDataFrame([(-1, "@HD\tVN:1.6")], "hdr_no long, line string"))


_SAM_LINES = f"""WITH {v.ALIGNMENTS_SQL}, {v.SEQUENCES_SQL}, h AS (SELECT count(*) + 1 AS n FROM sq),
a AS (SELECT *, row_number() OVER (ORDER BY line_no) - 1 + (SELECT n FROM h) AS spot, 'q' || group_id AS qname, matched || 'M' || CASE WHEN trimmed > 0 THEN trimmed || 'S' ELSE '' END AS cig FROM aln)
"""


@query(
    "source_samfile",
    _SAM_LINES + """SELECT spot AS line_no, min(spot) OVER (PARTITION BY group_id) AS group_id, qname, flag, rname, CAST(pos AS BIGINT) AS pos, CAST(60 AS BIGINT) AS mapq, cig AS cigar, '*' AS rnext, CAST(0 AS BIGINT) AS tlen,
  repeat('A', len) AS seq, repeat('I', len) AS qual, 'NM:i:' || nm AS extra FROM a""",
)
def _samfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark)}/x.sam.gz"
    write(_whole(spark, sf_dir), path, head=_head(spark, sf_dir))
    rows, _ = sam.samfile(spark, path)
    return rows.select("line_no", "group_id", "qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "tlen", "seq", "qual", "extra")


@query("source_samfile_by_mate", _SAM_LINES + ", k AS (SELECT *, CASE WHEN lag(group_id) OVER o = group_id AND lag(mate) OVER o = mate THEN 0 ELSE 1 END AS starts FROM a WINDOW o AS (ORDER BY spot)) SELECT spot AS line_no, max(CASE WHEN starts = 1 THEN spot END) OVER (ORDER BY spot) AS group_id FROM k")
def _samfile_unpaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark)}/x.sam"
    write(_whole(spark, sf_dir), path, head=_head(spark, sf_dir))
    return sam.samfile(spark, path, paired=False)[0].select("line_no", "group_id")


@query("source_sam_headers", f"WITH {v.SEQUENCES_SQL} SELECT feature, size FROM sq")
def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    text.write_single(_head(spark, sf_dir).orderBy("hdr_no").select("line"), f"{folder}/headers.sam")
    write(_whole(spark, sf_dir), f"{folder}/x.sam")
    return sam.sequences(sam.samfile(spark, f"{folder}/x.sam", headers=f"{folder}/headers.sam")[1])


@query("sink_sam", _SAM_LINES + "SELECT spot AS line_no, concat_ws(chr(9), qname, flag, rname, pos, 60, cig, '*', 0, 0, repeat('A', len), repeat('I', len), 'NM:i:' || nm) AS value FROM a UNION ALL SELECT CAST(feature AS BIGINT) + 1, '@SQ' || chr(9) || 'SN:' || feature || chr(9) || 'LN:' || CAST(size AS BIGINT) FROM sq UNION ALL SELECT 0, '@HD' || chr(9) || 'VN:1.6'")
def _sink_sam(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark)}/x.sam.bz2"
    write(_whole(spark, sf_dir), path, head=_head(spark, sf_dir))
    return text.numbered_lines(spark, path).select("line_no", "value")


@query("source_sam_count", SEQNAME_DIST1)
def _sam_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of alignments, counted by sequence in one call."""
    path = f"{_folder(spark)}/x.sam.gz"
    write(_whole(spark, sf_dir), path, head=_head(spark, sf_dir))
    rows, head = sam.samfile(spark, path)
    return annotate.count_alignments(spark, rows, head, features=["seqname"]).select("feature", F.round("value", 6).alias("value"))


# --- tables --------------------------------------------------------------------------------------------------------

_PIVOT = "SELECT CAST(o_custkey AS VARCHAR) AS feature, " + ", ".join(f"CAST(count(*) FILTER (o_orderpriority[1] = '{k}') AS DOUBLE) AS p{k}" for k in range(1, 6)) + " FROM orders GROUP BY 1"


def _by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = v.table(spark, sf_dir, "orders")
    sample = F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1))
    return merge.collect(orders.groupBy(sample.alias("sample"), F.col("o_custkey").cast("string").alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("value")), [f"p{k}" for k in range(1, 6)])


@query("source_countfile", _PIVOT)
def _countfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark)}/counts.tsv.gz"
    write(_by_priority(spark, sf_dir), path, comment="of orders", auto_comments=["date", "hash"], script="")
    return tables.countfile(spark, path)


def _count_lines(separator: str) -> str:
    values = f" || '{separator}' || ".join(f"CAST(p{k} AS BIGINT)" for k in range(1, 6))
    header = separator.join(["", *(f"p{k}" for k in range(1, 6))])
    return f"""WITH c AS ({_PIVOT}) SELECT row_number() OVER (ORDER BY feature) + 3 AS line_no, feature || '{separator}' || {values} AS value FROM c
UNION ALL SELECT * FROM (VALUES (0, '# of orders'), (1, '# Output generated by:'), (2, '#     count'), (3, '{header}')) x(line_no, value)"""


def _sink_counts(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    path = f"{_folder(spark)}/counts.{kind}"
    write(_by_priority(spark, sf_dir), path, kind, comment="of orders", auto_comments=["script"], script="count")
    return text.numbered_lines(spark, path).select("line_no", "value")


query("sink_counts", _count_lines("\t"))(lambda s, d: _sink_counts(s, d, "tsv"))
query("sink_counts_csv", _count_lines(","))(lambda s, d: _sink_counts(s, d, "csv"))


@query("sink_counts_values", "SELECT CAST(l_orderkey AS VARCHAR) AS feature, round(sum(l_quantity / 7), 9) AS value FROM lineitem GROUP BY 1")
def _sink_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubles as their shortest text, and back."""
    path = f"{_folder(spark)}/values.tsv"
    values = v.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("feature")).agg(F.sum(F.col("l_quantity") / 7).alias("value"))
    write(values, path)
    return tables.countfile(spark, path).select("feature", F.round("value", 9).alias("value"))


@query("sink_copy", "SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS line_no, r_name AS value FROM region")
def _sink_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file written, copied as it is, and recompressed twice."""
    folder = _folder(spark)
    text.write_single(v.table(spark, sf_dir, "region").orderBy("r_regionkey").select(F.col("r_name").alias("line")), f"{folder}/a.txt.gz")
    for a, b in (("a.txt.gz", "b.txt.gz"), ("b.txt.gz", "c.txt.zst"), ("c.txt.zst", "d.txt.bz2")):
        write(f"{folder}/{a}", f"{folder}/{b}")
    return text.numbered_lines(spark, f"{folder}/d.txt.bz2").select("line_no", "value")


@query("sink_parts", "SELECT CAST(o_orderkey AS VARCHAR) AS value, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders")
def _sink_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of ordered parts: the lines of all parts, by the names of the parts, are in order."""
    folder = _folder(spark) + "/parts"
    rows = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey")).repartition(16).orderBy("o_orderkey")
    text.write_parts(rows.select(F.col("o_orderkey").cast("string").alias("line")), folder, ".gz")
    lines = text.numbered_lines(spark, [f"{folder}/{x}" for x in sorted(os.listdir(folder)) if x.startswith("part-")])
    sizes = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.file") < F.col("a.file"), "left").groupBy(F.col("a.file").alias("of")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    return lines.join(before, F.col("file") == F.col("of")).select("value", (F.col("before") + F.col("line_no")).alias("place"))


_GFF_LINE = "concat_ws('\\t', seq_id, 'orders', gtype, CAST(r_start AS STRING), CAST(r_stop - 1 AS STRING), '.', r_strand, '.', attrs)"


def _gff_file(spark: SparkSession, sf_dir: str, attrs: Column) -> str:
    path = f"{_folder(spark)}/x.gff.gz"
    rows = v.intervals(spark, sf_dir).withColumns({"gtype": F.when(F.col("r_strand") == ".", "exon").otherwise("gene"), "attrs": attrs})
    text.write_single(rows.select(F.expr(_GFF_LINE).alias("line")), path, ["##gff-version 3", ""])
    return path


@query(
    "source_gff",
    f"""WITH {v.INTERVALS_SQL}, l AS (SELECT *, CASE WHEN r_strand = '.' THEN 'exon' ELSE 'gene' END AS gtype, split_part(feature, '-', 1) AS s, split_part(feature, '-', 2) AS n FROM iv)
SELECT seq_id, CAST(r_start AS BIGINT) AS "start", CAST(r_stop - 1 AS BIGINT) AS "end", r_strand AS strand, gtype, unnest(['ID', 'gene_id', 'gene_id', 'Note', 'flag']) AS k, unnest([feature, s, n, ' a b', '']) AS v FROM l""",
)
def _gff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys by = and by a space, quotation marks, several values, spaces, no value, a final semicolon."""
    parts = F.split("feature", "-")
    attrs = F.concat(F.lit(" ID="), "feature", F.lit('; gene_id "'), F.get(parts, F.lit(0)), F.lit('","'), F.get(parts, F.lit(1)), F.lit('" ;Note= a b;flag; '))
    rows = tables.gff(spark, _gff_file(spark, sf_dir, attrs)).withColumn("a", F.explode("attrs"))
    return rows.select("seq_id", "start", "end", "strand", "gtype", F.col("a.k").alias("k"), F.col("a.v").alias("v"))


@query("count_gff_file", GFF_ALL1)
def _count_gff_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counting in one call, with a GFF file from a search path."""
    path = f"{_folder(spark)}/x.gff"
    rows = v.intervals(spark, sf_dir).withColumns({"gtype": F.lit("gene"), "attrs": F.concat(F.lit("gene_id="), "feature")})
    text.write_single(rows.select(F.expr(_GFF_LINE).alias("line")), path)
    got = annotate.count_alignments(spark, v.alignments(spark, sf_dir), features=["gene"], subfeatures=["gene_id"], gff_file="<refs>/x.gff", search_path=["refs=" + os.path.dirname(path)], multiple="all1")
    return got.select("feature", F.round("value", 6).alias("value"))


def _map_file(spark: SparkSession, sf_dir: str) -> str:
    path = f"{_folder(spark)}/genes.map"
    cells = v.genes(spark, sf_dir).groupBy("gene").pivot("annotator", ["brand", "kind"]).agg(F.array_join(F.array_sort(F.collect_list("feature")), "|"))
    stale = cells.where("gene = '1'").select(F.lit(0).alias("at"), F.concat_ws("\t", "gene", F.lit("none"), F.lit("none")).alias("line"))  # overwritten by the later line
    rows = cells.select(F.lit(1).alias("at"), F.concat_ws("\t", "gene", "brand", F.replace("kind", F.lit("|S"), F.lit(",S"))).alias("line"))
    text.write_single(stale.unionByName(rows).orderBy("at", "line").select("line"), path, ["# genes of parts", "#gene\tbrand\tkind"])
    return path


query("source_functional_map", f"WITH {v.GENES_SQL} SELECT gene, annotator, feature FROM fm")(lambda s, d: tables.functional_map(s, _map_file(s, d), ["brand", "kind"]).select("gene", "annotator", "feature"))


@query("count_map_file", MAP_1_OVER_N)
def _count_map_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = annotate.count_alignments(spark, v.alignments(spark, sf_dir, on="l_partkey"), features=["brand", "kind"], functional_map=_map_file(spark, sf_dir), multiple="1overN")
    return got.select("feature", F.round("value", 6).alias("value"))


@query("source_fasta", "SELECT 'p' || p_partkey AS name, 'p' || p_partkey || ' of ' || p_brand AS header, repeat('ACGTN', CAST(p_size AS INT)) AS seq, CAST(5 * p_size AS BIGINT) AS length FROM part")
def _fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences in lines of twelve bases."""
    path = f"{_folder(spark)}/x.fa.gz"
    parts = v.table(spark, sf_dir, "part").orderBy("p_partkey")
    wrapped = F.regexp_replace(F.repeat(F.lit("ACGTN"), F.col("p_size").cast("int")), "(.{12})(?=.)", "$1\n")
    text.write_single(parts.select(F.concat(F.lit(">p"), F.col("p_partkey").cast("string"), F.lit(" of "), "p_brand", F.lit("\n"), wrapped).alias("line")), path)
    return tables.fasta(spark, path).select("name", "header", "seq", "length")


@query("source_bed", f'WITH {v.INTERVALS_SQL} SELECT seq_id, CAST(r_start AS BIGINT) AS "start", CAST(r_stop - 1 AS BIGINT) AS "end" FROM iv')
def _bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark)}/x.bed"
    rows = v.intervals(spark, sf_dir).select(F.concat_ws("\t", "seq_id", (F.col("r_start") - 1).cast("string"), (F.col("r_stop") - 1).cast("string"), F.lit("x")).alias("line"))
    text.write_single(rows, path, ["track name=x", "#c"])
    return tables.bed(spark, path)


@query("source_readlines", "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS place, n_name AS line FROM nation")
def _readlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark)}/names.txt"
    text.write_single(v.table(spark, sf_dir, "nation").orderBy("n_nationkey").select(F.concat("n_name", F.lit("\r")).alias("line")), path)
    return spark.createDataFrame(list(enumerate(text.readlines(path))), "place long, line string")


# --- statistics ----------------------------------------------------------------------------------------------------

_TOLD = "SELECT feature, CASE WHEN try_cast(value AS DOUBLE) IS NULL THEN value END AS told, round(try_cast(value AS DOUBLE), 9) AS number FROM"


def _told(rows: DataFrame) -> DataFrame:
    number = F.col("value").try_cast("double")
    return rows.select("feature", F.when(number.isNull(), F.col("value")).alias("told"), F.round(number, 9).alias("number"))


@query(
    "qcstats_fastq",
    f"""WITH {v.READS_SQL}, b AS (SELECT sample, mate, seq, length(seq) - length(replace(seq, 'G', '')) + length(seq) - length(replace(seq, 'C', '')) AS gc, length(seq) - length(replace(seq, 'N', '')) AS n FROM rd),
f AS (SELECT sample, mate, count(*) AS k, min(length(seq)) AS least, max(length(seq)) AS most, sum(length(seq)) AS bases, sum(gc) AS gc, sum(n) AS n FROM b GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (ORDER BY sample, mate) - 1 AS i FROM f),
t AS (SELECT i, unnest(['encoding', 'file', 'gcContent', 'maxSeqLen', 'minSeqLen', 'nonATCGFraction', 'numBasepairs', 'numSeqs']) AS k,
  unnest(['sanger', sample || ':0:' || mate, CAST(gc / (bases - n) AS VARCHAR), CAST(most AS VARCHAR), CAST(least AS VARCHAR), CAST(n / bases AS VARCHAR), CAST(bases AS VARCHAR), CAST(k AS VARCHAR)]) AS value FROM o)
{_TOLD} (SELECT i || ':' || k AS feature, value FROM t)""",
)
def _qcstats_fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(r.qcstats("fastq", v.reads(spark, sf_dir)))


@query(
    "qcstats_mapping",
    f"""WITH {v.ALIGNMENTS_SQL}, g AS (SELECT group_id, bool_or(is_aligned) AS a, min(rname) = max(rname) AS one FROM aln GROUP BY 1),
s AS (SELECT count(*) AS total, count(*) FILTER (a) AS aligned, count(*) FILTER (a AND one) AS uni FROM g),
t AS (SELECT unnest(['0:aligned', '0:inputFile', '0:lineNumber', '0:reference', '0:total', '0:unique']) AS feature, unnest([CAST(aligned AS VARCHAR), 'lineitem', '7', 'supplier', CAST(total AS VARCHAR), CAST(uni AS VARCHAR)]) AS value FROM s)
{_TOLD} t""",
)
def _qcstats_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(r.qcstats("mapping", mappings=[("lineitem", "supplier", 7, m.mapstats(v.alignments(spark, sf_dir, ordered=False)))]))
