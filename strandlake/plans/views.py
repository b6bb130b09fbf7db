"""Sequencing data derived from the star-schema tables, and the same views in SQL.

alignments: a line item is an alignment, an order a group of them. sequences: suppliers. genes: parts with brand and type as
annotations. intervals: orders as annotated regions. reads: vectors as qualities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCH = "1992-01-01"
_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alignments(spark: SparkSession, sf_dir: str, ordered: bool = True, on: str = "l_suppkey") -> DataFrame:
    """Alignments of the line items; without an order there are no line numbers, and no shuffle."""
    rows = table(spark, sf_dir, "lineitem")
    length = F.col("l_quantity").cast("int")
    trimmed = F.least(F.col("l_linenumber") % 3, length - 1)
    flag = F.when(F.col("l_returnflag") == "N", 4).otherwise(0) + F.when(F.col("l_linestatus") == "F", 16).otherwise(0) + F.when(F.col("l_linenumber") % 2 == 1, 64).otherwise(128)
    line = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER)) if ordered else F.lit(0)
    return rows.select(
        F.col("l_orderkey").alias("group_id"), (F.col("l_orderkey") * 1000 + line).alias("line_no"), F.concat(F.lit("q"), F.col("l_orderkey").cast("string")).alias("qname"),
        flag.cast("long").alias("flag"), F.col(on).cast("string").alias("rname"), F.datediff("l_shipdate", F.lit(EPOCH)).cast("long").alias("pos"), F.lit(60).cast("long").alias("mapq"),
        F.concat((length - trimmed).cast("string"), F.lit("M"), F.when(trimmed > 0, F.concat(trimmed.cast("string"), F.lit("S"))).otherwise("")).alias("cigar"),
        F.repeat(F.lit("A"), length).alias("seq"), F.repeat(F.lit("I"), length).alias("qual"), F.concat(F.lit("NM:i:"), F.round(F.col("l_discount") * 100).cast("int").cast("string")).alias("extra"),
    )


ALIGNMENTS_SQL = f"""aln AS (
  SELECT *, len - trimmed AS matched, (flag & 4) = 0 AS is_aligned, CASE WHEN (flag & 64) <> 0 THEN 0 ELSE 1 END AS mate FROM (
    SELECT l_orderkey AS group_id, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) AS line_no,
      (CASE WHEN l_returnflag = 'N' THEN 4 ELSE 0 END + CASE WHEN l_linestatus = 'F' THEN 16 ELSE 0 END + CASE WHEN l_linenumber % 2 = 1 THEN 64 ELSE 128 END)::BIGINT AS flag,
      CAST(l_suppkey AS VARCHAR) AS rname, CAST(l_partkey AS VARCHAR) AS gene, date_diff('day', DATE '{EPOCH}', CAST(l_shipdate AS DATE)) AS pos,
      CAST(floor(l_quantity) AS INT) AS len, least(l_linenumber % 3, CAST(floor(l_quantity) AS INT) - 1) AS trimmed, CAST(round(l_discount * 100) AS INT) AS nm
    FROM lineitem))"""


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("feature"), (100 + F.col("s_suppkey") % 900).cast("double").alias("size"))


SEQUENCES_SQL = "sq AS (SELECT CAST(s_suppkey AS VARCHAR) AS feature, CAST(100 + s_suppkey % 900 AS DOUBLE) AS size FROM supplier)"


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene, annotator, feature): a brand, and a type with a size class."""
    parts = table(spark, sf_dir, "part")
    kinds = F.array(F.struct(F.lit("brand").alias("annotator"), F.array("p_brand").alias("f")), F.struct(F.lit("kind").alias("annotator"), F.array("p_type", F.concat(F.lit("S"), (F.col("p_size") % 5).cast("string"))).alias("f")))
    return parts.select(F.col("p_partkey").cast("string").alias("gene"), F.explode(kinds).alias("k")).select("gene", "k.annotator", F.explode("k.f").alias("feature")).distinct()


GENES_SQL = """fm AS (
  SELECT CAST(p_partkey AS VARCHAR) AS gene, 'brand' AS annotator, p_brand AS feature FROM part
  UNION SELECT CAST(p_partkey AS VARCHAR), 'kind', p_type FROM part UNION SELECT CAST(p_partkey AS VARCHAR), 'kind', 'S' || (p_size % 5) FROM part)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(annotator, feature, seq_id, r_start, r_stop, r_strand): an order is a region of 31 days, named by its customer's segment and a number."""
    n = table(spark, sf_dir, "supplier").count()
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    start = F.datediff("o_orderdate", F.lit(EPOCH)).cast("long")
    strand = F.when(F.col("o_orderstatus") == "F", "+").when(F.col("o_orderstatus") == "O", "-").otherwise(".")
    name = F.concat("c_mktsegment", F.lit("-"), (F.col("o_orderkey") % 400).cast("string"))
    return orders.select(F.lit("segment").alias("annotator"), name.alias("feature"), (F.col("o_custkey") % n).cast("string").alias("seq_id"), start.alias("r_start"), (start + 31).alias("r_stop"), strand.alias("r_strand"))


INTERVALS_SQL = f"""iv AS (
  SELECT c_mktsegment || '-' || (o_orderkey % 400) AS feature, CAST(o_custkey % (SELECT count(*) FROM supplier) AS VARCHAR) AS seq_id,
    date_diff('day', DATE '{EPOCH}', CAST(o_orderdate AS DATE)) AS r_start, date_diff('day', DATE '{EPOCH}', CAST(o_orderdate AS DATE)) + 31 AS r_stop,
    CASE o_orderstatus WHEN 'F' THEN '+' WHEN 'O' THEN '-' ELSE '.' END AS r_strand
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as reads: neighbouring ids are mates, every fifth pair two singletons; components are qualities, letters follow from them."""
    rows = table(spark, sf_dir, "embeddings")
    qual = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 20).cast("int"))
    pair = F.floor(F.col("vec_id") / 2)
    single = pair % 5 == 0
    letters = F.transform("qual", lambda q, i: F.substring(F.lit("ACGTN"), (q + i) % 5 + 1, F.lit(1)))
    out = rows.select(
        "vec_id", F.concat(F.lit("s"), (pair % 4).cast("string")).alias("sample"), F.lit(0).alias("file_id"), F.when(single, 0).otherwise(F.col("vec_id") % 2 + 1).cast("tinyint").alias("mate"),
        F.when(single, F.col("vec_id")).otherwise(pair).alias("rec_no"), F.concat(F.lit("@r"), F.col("vec_id").cast("string")).alias("header"), qual.alias("qual"),
    )
    return out.withColumn("seq", F.array_join(letters, "")).select("vec_id", "sample", "file_id", "mate", "rec_no", "header", "seq", "qual")


READS_SQL = """rd0 AS (
  SELECT vec_id, 's' || (vec_id // 2 % 4) AS sample, CASE WHEN vec_id // 2 % 5 = 0 THEN 0 ELSE vec_id % 2 + 1 END AS mate,
    CASE WHEN vec_id // 2 % 5 = 0 THEN vec_id ELSE vec_id // 2 END AS rec_no, '@r' || vec_id AS header,
    list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 20) AS INTEGER)) AS qual FROM embeddings),
rd AS (SELECT *, array_to_string(list_transform(qual, lambda q, i: substr('ACGTN', CAST((q + i - 1) % 5 + 1 AS BIGINT), 1)), '') AS seq FROM rd0),
base AS (SELECT vec_id, sample, mate, unnest(qual) AS q, generate_subscripts(qual, 1) AS i FROM rd)"""
