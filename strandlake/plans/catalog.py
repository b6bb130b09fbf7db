"""Queries over the views, one an operator or variant, and the SQL of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import count as c
from ..operators import intervals as iv
from ..operators import mapped as m
from ..operators import merge
from ..operators import reads as r
from ..sources.fastq import subsampled, uninterleave
from ..sources.ordered import places
from ..sources.tables import feature_order
from ..sources.text import settled
from . import views as v
from .registered import ORACLES, QUERIES, query


# --- counting by sequence ------------------------------------------------------------------------------------------

_SEQ = f"""WITH {v.ALIGNMENTS_SQL}, {v.SEQUENCES_SQL},
h AS (SELECT DISTINCT group_id, rname AS feature FROM aln WHERE is_aligned),
n AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS k FROM h),
un AS (SELECT CAST((SELECT count(DISTINCT group_id) FROM aln) - (SELECT count(DISTINCT group_id) FROM h) AS DOUBLE) AS value),
"""
_DIST = """one AS (SELECT feature, CAST(count(*) AS DOUBLE) AS value FROM n WHERE k = 1 GROUP BY 1),
wt AS (SELECT one.feature, CASE WHEN coalesce(size, 0) > 0 THEN value / size ELSE value END AS w FROM one LEFT JOIN sz USING (feature)),
mu AS (SELECT n.group_id, n.feature, n.k, coalesce(w, 0) AS w, sum(coalesce(w, 0)) OVER (PARTITION BY n.group_id) AS t FROM n LEFT JOIN wt USING (feature) WHERE n.k > 1),
val AS (SELECT feature, sum(value) AS value FROM (SELECT * FROM one UNION ALL SELECT feature, CASE WHEN t > 0 THEN w / t ELSE 1.0 / k END FROM mu) GROUP BY 1)"""
_VALUES = {
    "all1": "val AS (SELECT feature, CAST(count(*) AS DOUBLE) AS value FROM n GROUP BY 1)",
    "1overN": "val AS (SELECT feature, sum(1.0::DOUBLE / k) AS value FROM n GROUP BY 1)",
    "unique_only": "val AS (SELECT feature, CAST(count(*) AS DOUBLE) AS value FROM n WHERE k = 1 GROUP BY 1)",
    "dist1": "sz AS (SELECT * FROM sq), " + _DIST,
}
_FULL = ", full_ AS (SELECT sq.feature, coalesce(value, 0) AS value, size FROM sq LEFT JOIN val USING (feature))"
_NORMED = "CASE WHEN size > 0 THEN value / size ELSE value END"
_NORMS = {
    "raw": "SELECT feature, value FROM full_",
    "normed": f"SELECT feature, {_NORMED} AS value FROM full_",
    "scaled": f"SELECT feature, {_NORMED} * ((SELECT sum(value) FROM full_) / (SELECT sum({_NORMED}) FROM full_)) AS value FROM full_",
    "fpkm": f"SELECT feature, {_NORMED} * 1e9::DOUBLE / (SELECT sum(value) FROM full_) AS value FROM full_",
}


def _seqname(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    aln, sq = v.alignments(spark, sf_dir, ordered=False), v.sequences(spark, sf_dir)
    out = c.count(aln, c.seqname_hits(aln, sq), sq.withColumn("annotator", F.lit("seqname")), **options)
    return out.select("feature", F.round("value", 6).alias("value"))


def _rounded(inner: str, where: str = "") -> str:
    return f"SELECT feature, round(value, 6) AS value FROM ({inner} UNION ALL SELECT '-1', value FROM un){where}"


for _multiple in c.MULTIPLE:
    query(f"count_seqname_{_multiple.lower()}", _SEQ + _VALUES[_multiple] + _FULL + _rounded(_NORMS["raw"]))(lambda s, d, x=_multiple: _seqname(s, d, multiple=x))
for _norm in c.NORMALIZATION[1:]:
    query(f"count_seqname_{_norm}", _SEQ + _VALUES["all1"] + _FULL + _rounded(_NORMS[_norm]))(lambda s, d, x=_norm: _seqname(s, d, multiple="all1", normalization=x))
query("count_seqname_min", _SEQ + _VALUES["dist1"] + _FULL + "SELECT feature, round(value, 6) AS value FROM (" + _NORMS["scaled"] + ") WHERE value >= 100")(lambda s, d: _seqname(s, d, multiple="dist1", normalization="scaled", minimum=100.0, include_minus1=False))


@query(
    "count_ordered",
    _SEQ + _VALUES["all1"] + _FULL + "SELECT CAST(row_number() OVER (ORDER BY CASE WHEN feature = '-1' THEN 0 ELSE 1 END, feature) AS BIGINT) AS place, feature, value FROM (" + _NORMS["raw"] + " UNION ALL SELECT '-1', value FROM un)",
)
def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The output table's order: the unassigned row first, then names bytewise."""
    return places(_seqname(spark, sf_dir, multiple="all1").orderBy(*feature_order())).select((F.col("place") + 1).alias("place"), "feature", "value")


# --- counting by functional map ------------------------------------------------------------------------------------

_MAP = f"""WITH {v.ALIGNMENTS_SQL}, {v.GENES_SQL}, h AS (SELECT DISTINCT annotator, group_id, feature FROM aln JOIN fm USING (gene)),
n AS (SELECT *, count(*) OVER (PARTITION BY annotator, group_id) AS k FROM h),
an AS (SELECT DISTINCT annotator FROM fm), fe AS (SELECT DISTINCT annotator, feature FROM fm),
un AS (SELECT annotator, CAST((SELECT count(DISTINCT group_id) FROM aln) - (SELECT count(DISTINCT group_id) FROM h WHERE h.annotator = an.annotator) AS DOUBLE) AS value FROM an),
"""
_MAP_END = ", fin AS (SELECT fe.annotator, fe.feature, coalesce(value, 0) AS value FROM fe LEFT JOIN val USING (annotator, feature) UNION ALL SELECT annotator, '-1', value FROM un) SELECT annotator || ':' || feature AS feature, round(value, 6) AS value FROM fin"
_MAP_DIST = """one AS (SELECT annotator, feature, CAST(count(*) AS DOUBLE) AS value FROM n WHERE k = 1 GROUP BY 1, 2),
mu AS (SELECT n.annotator, n.feature, n.k, coalesce(value, 0) AS w, sum(coalesce(value, 0)) OVER (PARTITION BY n.annotator, n.group_id) AS t FROM n LEFT JOIN one USING (annotator, feature) WHERE n.k > 1),
val AS (SELECT annotator, feature, sum(value) AS value FROM (SELECT * FROM one UNION ALL SELECT annotator, feature, CASE WHEN t > 0 THEN w / t ELSE 1.0 / k END FROM mu) GROUP BY 1, 2)"""


def _mapped(spark: SparkSession, sf_dir: str, multiple: str) -> DataFrame:
    aln, genes = v.alignments(spark, sf_dir, ordered=False, on="l_partkey"), v.genes(spark, sf_dir)
    out = c.count(aln, c.map_hits(aln, genes), c.map_features(genes), multiple=multiple)
    return c.labelled(out, 2).select("feature", F.round("value", 6).alias("value"))


MAP_1_OVER_N = _MAP + "val AS (SELECT annotator, feature, sum(1.0::DOUBLE / k) AS value FROM n GROUP BY 1, 2)" + _MAP_END
query("count_map_1overn", MAP_1_OVER_N)(lambda s, d: _mapped(s, d, "1overN"))
query("count_map_all1", _MAP + "val AS (SELECT annotator, feature, CAST(count(*) AS DOUBLE) AS value FROM n GROUP BY 1, 2)" + _MAP_END)(lambda s, d: _mapped(s, d, "all1"))
query("count_map_dist1", _MAP + _MAP_DIST + _MAP_END)(lambda s, d: _mapped(s, d, "dist1"))


@query(
    "count_map_normed",
    _MAP + f"""{v.SEQUENCES_SQL}, sz AS (SELECT annotator, feature, sum(coalesce(sq.size, 0)) AS size FROM fm LEFT JOIN sq ON fm.gene = sq.feature_ GROUP BY 1, 2),""".replace("CAST(s_suppkey AS VARCHAR) AS feature", "CAST(s_suppkey AS VARCHAR) AS feature_")
    + """val AS (SELECT annotator, feature, CAST(count(*) AS DOUBLE) AS value FROM n GROUP BY 1, 2),
fin AS (SELECT annotator, feature, CASE WHEN size > 0 THEN coalesce(value, 0) / size ELSE coalesce(value, 0) END AS value FROM sz LEFT JOIN val USING (annotator, feature) UNION ALL SELECT annotator, '-1', value FROM un)
SELECT annotator || ':' || feature AS feature, round(value, 6) AS value FROM fin""",
)
def _map_normed(spark: SparkSession, sf_dir: str) -> DataFrame:
    aln, genes, sq = v.alignments(spark, sf_dir, ordered=False, on="l_partkey"), v.genes(spark, sf_dir), v.sequences(spark, sf_dir)
    out = c.count(aln, c.map_hits(aln, genes), c.map_features(genes, sq, "normed"), multiple="all1", normalization="normed")
    return c.labelled(out, 2).select("feature", F.round("value", 6).alias("value"))


# --- counting by interval ------------------------------------------------------------------------------------------

_PAIRS = "aln.rname = iv.seq_id AND aln.pos < iv.r_stop AND iv.r_start < aln.pos + greatest(aln.len, 1)"
_STRAND = {"both": "", "sense": " AND iv.r_strand = CASE WHEN (aln.flag & 16) <> 0 THEN '-' ELSE '+' END", "antisense": " AND iv.r_strand = CASE WHEN (aln.flag & 16) <> 0 THEN '+' ELSE '-' END"}
_WITHIN = " AND aln.pos >= iv.r_start AND aln.pos + greatest(aln.len, 1) <= iv.r_stop"
_GFF_HITS = {
    "union": "h AS (SELECT DISTINCT group_id, feature FROM aln JOIN iv ON {on}{strand})",
    "intersection_strict": "h AS (SELECT DISTINCT group_id, feature FROM aln JOIN iv ON {on}{strand}" + _WITHIN + ")",
    "intersection_non_empty": """px AS (SELECT DISTINCT group_id, line_no, feature, x FROM (SELECT group_id, line_no, feature, unnest(generate_series(greatest(pos, r_start), least(pos + greatest(len, 1), r_stop) - 1)) AS x FROM aln JOIN iv ON {on}{strand})),
cv AS (SELECT line_no, count(DISTINCT x) AS k FROM px GROUP BY 1), ow AS (SELECT group_id, line_no, feature, count(*) AS k FROM px GROUP BY 1, 2, 3),
h AS (SELECT DISTINCT group_id, feature FROM ow JOIN cv USING (line_no) WHERE ow.k = cv.k)""",
}


def _gff_sql(mode: str, sense: str, values: str = "val AS (SELECT feature, CAST(count(*) AS DOUBLE) AS value FROM n GROUP BY 1)", norm: str = "raw") -> str:
    hits = _GFF_HITS[mode].format(on=_PAIRS, strand=_STRAND[sense])
    return f"""WITH {v.ALIGNMENTS_SQL}, {v.INTERVALS_SQL}, {hits}, n AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS k FROM h),
sz AS (SELECT feature, CAST(sum(r_stop - r_start) AS DOUBLE) AS size FROM iv GROUP BY 1),
un AS (SELECT CAST((SELECT count(DISTINCT group_id) FROM aln) - (SELECT count(DISTINCT group_id) FROM h) AS DOUBLE) AS value), {values},
full_ AS (SELECT feature, coalesce(value, 0) AS value, size FROM sz LEFT JOIN val USING (feature)) {_rounded(_NORMS[norm])}"""


def _gff(spark: SparkSession, sf_dir: str, mode: str, sense: str = "both", **options) -> DataFrame:
    aln, regions = v.alignments(spark, sf_dir, ordered=False).withColumn("line_no", F.monotonically_increasing_id()), v.intervals(spark, sf_dir)  # lines need be told apart only
    hits = iv.interval_hits(aln, regions, mode, sense)
    return c.count(aln, hits, iv.interval_features(regions), **options).select("feature", F.round("value", 6).alias("value"))


GFF_ALL1 = _gff_sql("union", "both")
SEQNAME_DIST1 = _SEQ + _VALUES["dist1"] + _FULL + _rounded(_NORMS["raw"])
for _mode in iv.MODES:
    query(f"count_gff_{_mode}", _gff_sql(_mode, "both"))(lambda s, d, x=_mode: _gff(s, d, x, multiple="all1"))
for _sense in iv.SENSES[1:]:
    query(f"count_gff_{_sense}", _gff_sql("union", _sense))(lambda s, d, x=_sense: _gff(s, d, "union", x, multiple="all1"))
query("count_gff_dist1_scaled", _gff_sql("union", "both", _DIST, "scaled"))(lambda s, d: _gff(s, d, "union", multiple="dist1", normalization="scaled"))

query("count_gff_discard_zeros", _gff_sql("intersection_strict", "antisense") + " WHERE value > 0")(lambda s, d: _gff(s, d, "intersection_strict", "antisense", multiple="all1", discard_zeros=True))

# --- alignments by group -------------------------------------------------------------------------------------------

_ROW = "group_id, line_no, flag, rname"
_UNIQ = """(count(*) OVER g <= 1 OR (count(*) OVER g = 2 AND min(CASE WHEN (flag & 64) <> 0 THEN 1 ELSE 0 END) OVER g <> max(CASE WHEN (flag & 64) <> 0 THEN 1 ELSE 0 END) OVER g
  AND (NOT bool_and(is_aligned) OVER g OR min(rname) OVER g = max(rname) OVER g)))"""
_ANY = "bool_or(is_aligned) OVER g"


def _select_sql(test: str, source: str = "aln") -> str:
    return f"SELECT {_ROW} FROM (SELECT *, {test} AS ok FROM {source} WINDOW g AS (PARTITION BY group_id)) WHERE ok"


def _rows(df: DataFrame) -> DataFrame:
    return df.select("group_id", "line_no", "flag", "rname")


for _name, _keep, _drop, _test in (
    ("keep_mapped", ["mapped"], [], "is_aligned"), ("keep_unmapped", ["unmapped"], [], f"NOT {_ANY}"), ("keep_unique", ["unique"], [], _UNIQ),
    ("drop_mapped", [], ["mapped"], f"NOT {_ANY}"), ("drop_unmapped", [], ["unmapped"], "is_aligned"), ("drop_unique", [], ["unique"], f"NOT {_UNIQ}"),
):
    query(f"select_{_name}", f"WITH {v.ALIGNMENTS_SQL} " + _select_sql(_test))(lambda s, d, k=_keep, x=_drop: _rows(m.select(v.alignments(s, d), k, x)))
query("select_mapped_then_unique", f"WITH {v.ALIGNMENTS_SQL}, f AS (SELECT * FROM aln WHERE is_aligned) " + _select_sql(_UNIQ, "f"))(lambda s, d: _rows(m.select(v.alignments(s, d), ["mapped", "unique"])))
query("select_flag", f"WITH {v.ALIGNMENTS_SQL} SELECT {_ROW}, ok AS mapped FROM (SELECT *, {_ANY} AS ok FROM aln WINDOW g AS (PARTITION BY group_id))")(lambda s, d: (lambda a: a.select("group_id", "line_no", "flag", "rname", m.with_flag(a).alias("mapped")))(v.alignments(s, d)))
query("select_some_match", f"WITH {v.ALIGNMENTS_SQL} " + _select_sql("bool_or(rname = '7') OVER g"))(lambda s, d: (lambda a: _rows(a.withColumn("ok", m.some_match(a, "7")).where("ok")))(v.alignments(s, d)))

_IDENT = "CASE WHEN matched = 0 THEN -1 ELSE (matched - nm)::DOUBLE / matched END >= 0.9"
query("filter_identity", f"WITH {v.ALIGNMENTS_SQL} SELECT {_ROW} FROM aln WHERE {_IDENT} AND matched >= 20")(lambda s, d: _rows(m.filter_matches(v.alignments(s, d), min_identity_pc=90, min_match_size=20)))
query("filter_reverse", f"WITH {v.ALIGNMENTS_SQL} SELECT {_ROW} FROM aln WHERE NOT ({_IDENT} AND matched >= 20)")(lambda s, d: _rows(m.filter_matches(v.alignments(s, d), min_identity_pc=90, min_match_size=20, reverse=True)))
_UNMATCH = f"WITH {v.ALIGNMENTS_SQL} SELECT group_id, line_no, CASE WHEN ok THEN flag ELSE (flag | 4) & ~2::BIGINT END AS flag, CASE WHEN ok THEN rname ELSE '*' END AS rname FROM (SELECT *, {_IDENT} AS ok FROM aln)"
query("filter_unmatch", _UNMATCH)(lambda s, d: _rows(m.filter_matches(v.alignments(s, d), min_identity_pc=90, action="unmatch")))
query("filter_max_trim", f"WITH {v.ALIGNMENTS_SQL} " + _select_sql("max(len) OVER (PARTITION BY group_id, mate) - matched <= 10"))(lambda s, d: _rows(m.filter_matches(v.alignments(s, d), max_trim=10)))
query(
    "allbest",
    f"WITH {v.ALIGNMENTS_SQL} " + _select_sql("count(*) OVER g <= 1 OR count(*) OVER (PARTITION BY group_id, mate) <= 1 OR nm = min(nm) OVER (PARTITION BY group_id, mate)"),
)(lambda s, d: _rows(m.allbest(v.alignments(s, d))))


@query(
    "pe_filter",
    f"""WITH {v.ALIGNMENTS_SQL}, f AS (SELECT * FROM aln WHERE is_aligned AND (flag & 16) = 0), b AS (SELECT group_id, rname, min(line_no) AS line_no FROM aln WHERE is_aligned AND (flag & 16) <> 0 GROUP BY 1, 2),
p AS (SELECT f.group_id, f.line_no AS pair_line, b.line_no AS back FROM f JOIN b USING (group_id, rname))
SELECT group_id, pair_line, 0 AS pair_mate, pair_line AS line_no FROM p UNION ALL SELECT group_id, pair_line, 1, back FROM p""",
)
def _pe_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.pe_filter(v.alignments(spark, sf_dir)).select("group_id", "pair_line", "pair_mate", "line_no")


@query(
    "mapstats",
    f"""WITH {v.ALIGNMENTS_SQL}, g AS (SELECT group_id, bool_or(is_aligned) AS a, min(rname) = max(rname) AS one FROM aln GROUP BY 1)
SELECT count(*) AS total, count(*) FILTER (a) AS aligned, count(*) FILTER (a AND one) AS "unique" FROM g""",
)
def _mapstats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.mapstats(v.alignments(spark, sf_dir, ordered=False))


@query(
    "merge_best",
    f"""WITH {v.ALIGNMENTS_SQL}, p AS (SELECT *, 0 AS part FROM aln UNION ALL SELECT * REPLACE ((nm * 3 + line_no) % 11 AS nm, is_aligned AND line_no % 5 <> 0 AS is_aligned), 1 FROM aln),
u AS (SELECT group_id AS group_no, mate, line_no, part, is_aligned, CASE WHEN is_aligned THEN matched - nm END AS sc FROM p),
b AS (SELECT *, max(sc) OVER (PARTITION BY group_no, mate) AS best, row_number() OVER (PARTITION BY group_no, mate ORDER BY part DESC, line_no DESC) AS rn FROM u)
SELECT group_no, line_no, CAST(part AS INT) AS part FROM b WHERE CASE WHEN best IS NULL THEN rn = 1 ELSE coalesce(sc = best, false) END""",
)
def _merge_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same reads on two references: on the second one other distances, and every fifth line is not aligned."""
    aln = v.alignments(spark, sf_dir).withColumn("group_no", F.col("group_id"))
    distance = (m.int_tag("NM") * 3 + F.col("line_no")) % 11
    flag = F.when(F.col("line_no") % 5 == 0, F.col("flag").bitwiseOR(F.lit(4))).otherwise(F.col("flag"))
    other = aln.withColumns({"extra": F.concat(F.lit("NM:i:"), distance.cast("string")), "flag": flag})
    return m.merge_best([aln, other]).select("group_no", "line_no", "part")


@query(
    "as_reads",
    f"""WITH {v.ALIGNMENTS_SQL}, g AS (SELECT group_id, count(*) AS n, min(line_no) AS l, min(CASE WHEN mate = 0 THEN line_no END) AS a, min(CASE WHEN mate = 1 THEN line_no END) AS b FROM aln GROUP BY 1),
e AS (SELECT group_id, 0 AS mate, CASE WHEN n = 1 THEN l ELSE coalesce(a, b) END AS line FROM g WHERE n = 1 OR a IS NULL OR b IS NULL UNION ALL SELECT group_id, 1, a FROM g WHERE n > 1 AND a IS NOT NULL AND b IS NOT NULL UNION ALL SELECT group_id, 2, b FROM g WHERE n > 1 AND a IS NOT NULL AND b IS NOT NULL)
SELECT e.group_id AS rec_no, CAST(e.mate AS TINYINT) AS mate, repeat('A', len) AS seq FROM e JOIN aln ON aln.line_no = e.line""",
)
def _as_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.as_reads(v.alignments(spark, sf_dir)).select("rec_no", "mate", "seq")


@query(
    "view_regions",
    f"""WITH {v.ALIGNMENTS_SQL}, {v.INTERVALS_SQL}
SELECT {_ROW} FROM aln WHERE EXISTS (SELECT 1 FROM iv z WHERE aln.rname = z.seq_id AND aln.pos < z.r_stop AND z.r_start < aln.pos + greatest(len, 1))""",
)
def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = v.intervals(spark, sf_dir).select("seq_id", F.col("r_start").alias("start"), (F.col("r_stop") - 1).alias("end"))
    return _rows(iv.view(v.alignments(spark, sf_dir), regions))


query("sort_coordinate", f"WITH {v.ALIGNMENTS_SQL} SELECT row_number() OVER (ORDER BY rname, pos, flag & 16, line_no) - 1 AS place, rname, pos, line_no FROM aln")(
    lambda s, d: places(m.sort(v.alignments(s, d)).select("rname", "pos", "line_no"))
)
query("sort_header_order", f"WITH {v.ALIGNMENTS_SQL} SELECT row_number() OVER (ORDER BY CAST(rname AS BIGINT) DESC, pos, flag & 16, line_no) - 1 AS place, rname, pos, line_no FROM aln")(
    lambda s, d: places(m.sort(v.alignments(s, d), order=v.sequences(s, d).select((-F.col("feature").cast("long")).alias("hdr_no"), F.col("feature").alias("sn"))).select("rname", "pos", "line_no"))
)
query("sort_name", f"WITH {v.ALIGNMENTS_SQL} SELECT row_number() OVER (ORDER BY group_id, mate, line_no) - 1 AS place, 'q' || group_id AS qname, line_no FROM aln")(
    lambda s, d: places(m.sort(settled(v.alignments(s, d).select("qname", "flag", "line_no")), "name").select("qname", "line_no"))  # ranges are sampled first: a sort reads its input twice
)


def _best_sql(source: str) -> str:
    return _select_sql("count(*) OVER g <= 1 OR count(*) OVER (PARTITION BY group_id, mate) <= 1 OR nm = min(nm) OVER (PARTITION BY group_id, mate)", source)


@query(
    "select_block",
    f"WITH {v.ALIGNMENTS_SQL}, f AS (SELECT * FROM aln WHERE matched > 0 AND (matched - nm)::DOUBLE / matched >= 0.95), k AS (SELECT * FROM (SELECT *, {_ANY} AS mapped FROM f WINDOW g AS (PARTITION BY group_id)) WHERE mapped) " + _best_sql("k"),
)
def _select_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by identity, then groups with an aligned row, then their best rows."""

    def block(b: m.GroupBlock) -> None:
        b.filter(min_identity_pc=95)
        b.discard(~b.flag("mapped"))
        b.allbest()

    return _rows(m.select_block(v.alignments(spark, sf_dir), block))


@query(
    "select_block_conditions",
    f"WITH {v.ALIGNMENTS_SQL}, s AS (SELECT *, bool_or(rname = '7') OVER g AS stays, {_UNIQ} AS uni FROM aln WINDOW g AS (PARTITION BY group_id)), u AS (SELECT * FROM s WHERE stays OR uni)"
    " SELECT group_id, line_no, CASE WHEN stays OR matched >= 25 THEN flag ELSE (flag | 4) & ~2::BIGINT END AS flag, CASE WHEN stays OR matched >= 25 THEN rname ELSE '*' END AS rname FROM u",
)
def _select_block_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups on one sequence stay as they are; of others unique ones only, and their short matches are taken back."""

    def block(b: m.GroupBlock) -> None:
        b.stop(b.some_match("7"))
        b.unique()
        b.filter(min_match_size=25, action="unmatch")

    return _rows(m.select_block(v.alignments(spark, sf_dir), block))


@query(
    "select_reinjects",
    f"""WITH {v.ALIGNMENTS_SQL}, o AS (SELECT *, line_no % 3 <> 0 AS has FROM aln), k AS (SELECT *, bool_or(has) OVER (PARTITION BY group_id, mate) AS any_, row_number() OVER (PARTITION BY group_id, mate ORDER BY line_no) AS rn FROM o WHERE is_aligned),
d AS (SELECT k.line_no, min(o.line_no) AS donor FROM k JOIN o ON k.group_id = o.group_id AND k.mate = o.mate AND o.has AND o.len = k.len WHERE NOT k.any_ AND k.rn = 1 GROUP BY 1)
SELECT k.group_id, k.line_no, CASE WHEN has THEN repeat('A', len) WHEN donor IS NOT NULL THEN repeat('A', len) ELSE '*' END AS seq FROM k LEFT JOIN d USING (line_no)""",
)
def _reinjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third row has no sequence; mates that are left without any take one that fits."""
    bare = F.when(F.col("line_no") % 3 == 0, "*").otherwise(F.col("seq"))
    return m.select(v.alignments(spark, sf_dir).withColumn("seq", bare), ["mapped"]).select("group_id", "line_no", "seq")


@query(
    "allbest_without_distances",
    f"WITH {v.ALIGNMENTS_SQL}, x AS (SELECT * REPLACE (CASE WHEN line_no % 2 = 0 THEN nm END AS nm) FROM aln), y AS (SELECT *, min(nm) OVER (PARTITION BY group_id, mate) AS best, count(*) OVER (PARTITION BY group_id, mate) AS k FROM x)"
    f" SELECT {_ROW} FROM y WHERE k <= 1 OR best IS NULL OR coalesce(nm = best, false)",
)
def _allbest_bare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd lines have no distance; mates without any stay whole."""
    extra = F.when(F.col("line_no") % 2 == 0, F.col("extra")).otherwise("XX:Z:none")
    return _rows(m.allbest(v.alignments(spark, sf_dir).withColumn("extra", extra)))

# --- reads ---------------------------------------------------------------------------------------------------------

_RD = f"WITH {v.READS_SQL}"
_CUT = "SELECT vec_id, substr(rd.seq, CAST(s + 1 AS BIGINT), CAST(n AS BIGINT)) AS seq, array_to_string(rd.qual[CAST(s + 1 AS BIGINT):CAST(s + n AS BIGINT)], ',') AS qual FROM"


def _runs(values: str) -> str:
    return f"""ok AS (SELECT vec_id, i, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS g FROM {values} WHERE q >= 20), ru AS (SELECT vec_id, g, min(i) AS s, count(*) AS n FROM ok GROUP BY 1, 2),
be AS (SELECT vec_id, arg_max(s, (n, -s)) - 1 AS s, max(n) AS n FROM ru GROUP BY 1), cu AS (SELECT vec_id, coalesce(s, 0) AS s, coalesce(n, 0) AS n FROM rd LEFT JOIN be USING (vec_id)) {_CUT} cu JOIN rd USING (vec_id)"""


def _trim(spark: SparkSession, sf_dir: str, step) -> DataFrame:
    rows = v.reads(spark, sf_dir)
    read = step(r.Read(F.col("header"), F.col("seq"), F.col("qual")))
    return rows.select("vec_id", read.seq.alias("seq"), F.array_join(F.transform(read.qual, lambda q: q.cast("string")), ",").alias("qual"))


query("substrim", _RD + ", " + _runs("base"))(lambda s, d: _trim(s, d, lambda x: x.substrim(20)))
query(
    "smoothtrim",
    _RD + """, pa AS (SELECT vec_id, i, (SELECT CAST(round_even(CAST(avg(b.q) AS DOUBLE), 0) AS INT) FROM (SELECT unnest(list_transform([-1, 0, 1, 2], lambda k: rd.qual[CAST(least(greatest(base.i + k, 1), len(rd.qual)) AS BIGINT)])) AS q) b) AS q FROM base JOIN rd USING (vec_id)), """ + _runs("pa"),
)(lambda s, d: _trim(s, d, lambda x: x.smoothtrim(20, 4)))
query(
    "endstrim",
    _RD + f""", en AS (SELECT vec_id, min(i) - 1 AS s, max(i) - min(i) + 1 AS n FROM base WHERE q >= 22 GROUP BY 1), cu AS (SELECT vec_id, coalesce(s, 0) AS s, coalesce(n, 0) AS n FROM rd LEFT JOIN en USING (vec_id)) {_CUT} cu JOIN rd USING (vec_id)""",
)(lambda s, d: _trim(s, d, lambda x: x.endstrim(22)))
query("endstrim_3", _RD + f""", en AS (SELECT vec_id, 0 AS s, max(i) AS n FROM base WHERE q >= 22 GROUP BY 1), cu AS (SELECT vec_id, 0 AS s, coalesce(n, 0) AS n FROM rd LEFT JOIN en USING (vec_id)) {_CUT} cu JOIN rd USING (vec_id)""")(lambda s, d: _trim(s, d, lambda x: x.endstrim(22, "3")))
query("endstrim_5", _RD + f""", en AS (SELECT vec_id, min(i) - 1 AS s FROM base WHERE q >= 22 GROUP BY 1), cu AS (SELECT vec_id, coalesce(s, length(seq)) AS s, length(seq) - coalesce(s, length(seq)) AS n FROM rd LEFT JOIN en USING (vec_id)) {_CUT} cu JOIN rd USING (vec_id)""")(lambda s, d: _trim(s, d, lambda x: x.endstrim(22, "5")))
query("read_slice", _RD + f", cu AS (SELECT vec_id, 3 AS s, 40 AS n FROM rd) {_CUT} cu JOIN rd USING (vec_id)")(lambda s, d: _trim(s, d, lambda x: x[3:43]))
query("n_to_zero_quality", _RD + " SELECT vec_id, seq, array_to_string(list_transform(qual, lambda q, i: CASE WHEN substr(seq, CAST(i AS BIGINT), 1) = 'N' THEN 0 ELSE q END), ',') AS qual FROM rd")(lambda s, d: _trim(s, d, lambda x: x.n_to_zero_quality()))


@query("read_quality", _RD + " SELECT vec_id, round(list_avg(qual), 6) AS average, round(len(list_filter(qual, lambda q: q >= 20)) / len(qual)::DOUBLE, 6) AS share, CAST(length(seq) AS INT) AS n FROM rd")
def _read_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = r.Read(F.col("header"), F.col("seq"), F.col("qual"))
    return v.reads(spark, sf_dir).select("vec_id", F.round(read.avg_quality(), 6).alias("average"), F.round(read.fraction_at_least(20), 6).alias("share"), read.length().alias("n"))


_KEPT = "kp AS (SELECT vec_id, sample, mate, rec_no, list_avg(qual) AS av FROM rd WHERE list_avg(qual) >= 19.5)"
_PAIRED = ", pr AS (SELECT *, mate > 0 AND count(*) OVER (PARTITION BY sample, rec_no, mate > 0) = 1 AS alone FROM kp)"


def _good(block: r.Block) -> None:
    block.discard(block.read.avg_quality() < 19.5)


query("preprocess_pairs", f"{_RD}, {_KEPT}{_PAIRED} SELECT vec_id, CAST(CASE WHEN alone THEN 0 ELSE mate END AS TINYINT) AS mate FROM pr")(lambda s, d: r.preprocess(v.reads(s, d), _good).select("vec_id", "mate"))
query("preprocess_no_singles", f"{_RD}, {_KEPT}{_PAIRED} SELECT vec_id, CAST(mate AS TINYINT) AS mate FROM pr WHERE NOT alone")(lambda s, d: r.preprocess(v.reads(s, d), _good, keep_singles=False).select("vec_id", "mate"))


@query(
    "preprocess_block",
    f"{_RD} SELECT vec_id, substr(seq, 6, CASE WHEN list_avg(qual) >= 20 THEN 20 ELSE length(seq) END) AS seq FROM rd WHERE list_avg(qual) >= 20 OR length(seq) - 5 >= 60 OR mate = 99",
)
def _block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read = read[5:]; good reads are cut to 20 bases and done; short ones of the others go."""

    def block(b: r.Block) -> None:
        average = F.aggregate("qual", F.lit(0).cast("long"), lambda a, q: a + q) / F.size("qual")
        b.assign(b.read[5:])
        b.assign(b.read.cut(F.lit(0), F.lit(20)), when=average >= 20)
        b.stop(average >= 20)
        b.discard(b.read.length() < 60)

    return r.preprocess(v.reads(spark, sf_dir), block).select("vec_id", "seq")


@query(
    "unique_reads",
    "WITH d AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) SELECT doc_id FROM d WHERE n <= 2",
)
def _unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = v.table(spark, sf_dir, "documents").select("doc_id", F.lit("d").alias("sample"), F.lit(0).alias("file_id"), F.col("doc_id").alias("rec_no"), F.col("text").alias("seq"))
    return r.unique(docs, 2).select("doc_id")


query("discard_singles", _RD + " SELECT vec_id FROM rd WHERE mate > 0")(lambda s, d: r.discard_singles(v.reads(s, d)).select("vec_id"))
query("subsample", "SELECT doc_id AS rec_no FROM documents WHERE doc_id % 10 = 0 AND doc_id < 250000")(lambda s, d: subsampled(v.table(s, d, "documents").select(F.col("doc_id").alias("rec_no"))))


@query("group_sets", _RD + " SELECT 'all' AS sample, CAST(sample[2] AS INT) AS file_id, vec_id FROM rd")
def _group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = v.reads(spark, sf_dir)
    return r.group([rows.where(F.col("sample") == x) for x in ("s0", "s1", "s2", "s3")], "all").select("sample", "file_id", "vec_id")


@query(
    "uninterleave",
    """WITH RECURSIVE h AS (SELECT conv_id, text, row_number() OVER (ORDER BY conv_id, turn) - 1 AS no FROM conversations),
st(no, opens) AS (SELECT 0::BIGINT, coalesce((SELECT a.conv_id = b.conv_id FROM h a, h b WHERE a.no = 0 AND b.no = 1), false)
  UNION ALL SELECT st.no + 1, NOT st.opens AND coalesce(a.conv_id = b.conv_id, false) FROM st JOIN h a ON a.no = st.no + 1 LEFT JOIN h b ON b.no = st.no + 2),
c AS (SELECT no, opens, coalesce(lag(opens) OVER (ORDER BY no), false) AS closes FROM st),
k AS (SELECT *, sum(opens::INT) OVER (ORDER BY no) AS pair, sum((NOT opens AND NOT closes)::INT) OVER (ORDER BY no) AS single FROM c)
SELECT CAST(CASE WHEN opens THEN 1 WHEN closes THEN 2 ELSE 0 END AS TINYINT) AS mate, CAST(CASE WHEN opens OR closes THEN pair ELSE single END - 1 AS BIGINT) AS rec_no, CAST(conv_id AS VARCHAR) AS header, text AS seq FROM k JOIN h USING (no)""",
)
def _uninterleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in order are records whose header is their conversation."""
    turns = places(v.table(spark, sf_dir, "conversations").orderBy("conv_id", "turn").select("conv_id", "text"))
    rows = turns.select(F.lit("c").alias("sample"), F.lit(0).alias("file_id"), F.col("place").alias("rec_no"), F.col("conv_id").cast("string").alias("header"), F.col("text").alias("seq"), F.array().cast("array<int>").alias("qual"))
    return uninterleave(rows).select("mate", "rec_no", "header", "seq")


@query(
    "qc_files",
    _RD + """ SELECT sample, count(*) AS n_seqs, CAST(min(length(seq)) AS BIGINT) AS min_len, CAST(max(length(seq)) AS BIGINT) AS max_len, CAST(sum(length(seq)) AS BIGINT) AS n_bases,
CAST(sum(length(seq) - length(replace(seq, 'A', ''))) AS BIGINT) AS a, CAST(sum(length(seq) - length(replace(seq, 'C', ''))) AS BIGINT) AS c,
CAST(sum(length(seq) - length(replace(seq, 'G', ''))) AS BIGINT) AS g, CAST(sum(length(seq) - length(replace(seq, 'T', ''))) AS BIGINT) AS t, CAST(sum(length(seq) - length(replace(seq, 'N', ''))) AS BIGINT) AS other,
round(sum(2 * length(seq) - length(replace(seq, 'G', '')) - length(replace(seq, 'C', ''))) / sum(length(replace(seq, 'N', ''))), 9) AS gc, round(sum(length(seq) - length(replace(seq, 'N', ''))) / sum(length(seq)), 9) AS non_acgt FROM rd GROUP BY 1""",
)
def _qc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.file_stats(v.reads(spark, sf_dir), ["sample"]).withColumns({"gc": F.round("gc", 9), "non_acgt": F.round("non_acgt", 9)})


@query(
    "qc_positions",
    _RD + """, ct AS (SELECT sample, i - 1 AS pos, q, count(*) AS c FROM base GROUP BY 1, 2, 3), cm AS (SELECT *, sum(c) OVER (PARTITION BY sample, pos ORDER BY q) AS cum, sum(c) OVER (PARTITION BY sample, pos) AS n FROM ct)
SELECT sample, CAST(pos AS INT) AS pos, CAST(floor(sum(q * c) / sum(c)) AS INT) AS mean, CAST(min(CASE WHEN cum >= ceil(n * 0.5::DOUBLE) THEN q END) AS INT) AS median,
CAST(min(CASE WHEN cum >= ceil(n * 0.25::DOUBLE) THEN q END) AS INT) AS q25, CAST(min(CASE WHEN cum >= ceil(n * 0.75::DOUBLE) THEN q END) AS INT) AS q75 FROM cm GROUP BY 1, 2""",
)
def _qc_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.position_stats(v.reads(spark, sf_dir))


# --- count tables --------------------------------------------------------------------------------------------------

_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = v.table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("sample"), F.col("o_custkey").cast("string").alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("value"))


@query(
    "collect_samples",
    "SELECT CAST(o_custkey AS VARCHAR) AS feature, " + ", ".join(f"CAST(count(*) FILTER (o_orderpriority = '{p}') AS DOUBLE) AS \"{p[:1]}\"" for p in _PRIORITIES) + " FROM orders GROUP BY 1",
)
def _collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _by_priority(spark, sf_dir).withColumn("sample", F.substring("sample", 1, 1))
    return merge.collect(counts, [p[0] for p in _PRIORITIES])


@query(
    "paste_tables",
    "SELECT CAST(o_custkey AS VARCHAR) AS feature, " + ", ".join(f"CAST(count(*) FILTER (o_orderpriority = '{p}') AS DOUBLE) AS v{p[0]}" for p in _PRIORITIES) + " FROM orders GROUP BY 1",
)
def _paste(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _by_priority(spark, sf_dir)
    return merge.paste([counts.where(F.col("sample") == p).select("feature", F.col("value").alias(f"v{p[0]}")) for p in _PRIORITIES])


_LAST = ", ".join(f"coalesce(arg_max(o_totalprice, o_orderkey) FILTER (o_orderpriority = '{p}'), 0) AS v{p[0]}" for p in _PRIORITIES)
_REPEATED = f"SELECT CAST(o_custkey AS VARCHAR) AS feature, {_LAST} FROM orders GROUP BY 1"


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order is a row of its customer's feature: features repeat, and the last order counts."""
    orders = v.table(spark, sf_dir, "orders")
    sample = F.concat(F.lit("v"), F.substring("o_orderpriority", 1, 1))
    return orders.select(sample.alias("sample"), F.col("o_custkey").cast("string").alias("feature"), F.col("o_totalprice").cast("double").alias("value"), F.col("o_orderkey").alias("line_no"))


query("collect_repeated", _REPEATED)(lambda s, d: merge.collect(_prices(s, d), [f"v{p[0]}" for p in _PRIORITIES]))


@query("paste_repeated", _REPEATED)
def _paste_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = _prices(spark, sf_dir)
    return merge.paste([prices.where(F.col("sample") == f"v{p[0]}").select("feature", "line_no", F.col("value").alias(f"v{p[0]}")) for p in _PRIORITIES])


@query(
    "count_by_sample",
    f"""WITH {v.ALIGNMENTS_SQL}, {v.SEQUENCES_SQL}, al AS (SELECT *, 'x' || (group_id % 3) AS sample FROM aln), sm AS (SELECT DISTINCT sample FROM al),
h AS (SELECT DISTINCT sample, group_id, rname AS feature FROM al WHERE is_aligned), ct AS (SELECT sample, feature, count(*) AS k FROM h GROUP BY 1, 2)
SELECT sm.sample, sq.feature, CAST(coalesce(k, 0) AS DOUBLE) AS value FROM sm CROSS JOIN sq LEFT JOIN ct USING (sample, feature)
UNION ALL SELECT sample, '-1', CAST((SELECT count(DISTINCT group_id) FROM al WHERE al.sample = sm.sample) - (SELECT count(DISTINCT group_id) FROM h WHERE h.sample = sm.sample) AS DOUBLE) FROM sm""",
)
def _by_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    aln = v.alignments(spark, sf_dir, ordered=False).withColumn("sample", F.concat(F.lit("x"), (F.col("group_id") % 3).cast("string")))
    sq = v.sequences(spark, sf_dir)
    return c.count(aln, c.seqname_hits(aln, sq, ["sample"]), sq.withColumn("annotator", F.lit("seqname")), multiple="all1", by=["sample"]).select("sample", "feature", "value")


from . import files  # noqa: E402, F401  (registers the queries of sources and sinks)
