"""Operators on small fixtures whose results are worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from strandlake.operators import count as c
from strandlake.operators import intervals as iv
from strandlake.operators import mapped as m
from strandlake.operators import merge
from strandlake.operators import reads as r

FIELDS = "group_id long, line_no long, qname string, flag long, rname string, pos long, cigar string, seq string, qual string, extra string"


def rows(spark, *items):
    """(group, flag, rname, pos, cigar, seq, nm)"""
    made = [(g, k, f"r{g}", f, n, p, cg, s, "I" * len(s) if s != "*" else "*", "" if nm is None else f"NM:i:{nm}") for k, (g, f, n, p, cg, s, nm) in enumerate(items)]
    return spark.createDataFrame(made, FIELDS)


def lines(df):
    return sorted(x["line_no"] for x in df.collect())


SPANS = [(20, 70), (50, 100), (70, 120), (90, 140), (140, 190), (210, 260), (240, 290), (280, 330), (340, 390)]
FEATURES = [("A", 40, 100), ("B", 80, 200), ("C", 130, 270), ("D", 280, 330)]


@pytest.mark.parametrize(("mode", "expected"), [
    ("union", {"-1": 1, "A": 4, "B": 4, "C": 4, "D": 2}), ("intersection_non_empty", {"-1": 1, "A": 2, "B": 2, "C": 3, "D": 1}), ("intersection_strict", {"-1": 4, "A": 1, "B": 2, "C": 1, "D": 1}),
])
def test_interval_modes(spark, mode, expected):
    """Half-open reads and intervals; a read that two features cover alike keeps both."""
    aln = rows(spark, *[(k, 0, "S", a, "1M", "A" * (b - a), 0) for k, (a, b) in enumerate(SPANS)])
    regions = spark.createDataFrame([("g", n, "S", a, b + 1, "+") for n, a, b in FEATURES], "annotator string, feature string, seq_id string, r_start long, r_stop long, r_strand string")
    got = {}
    for bin_size in (16, 1 << 14):
        hits = iv.interval_hits(aln, regions, mode, levels=[bin_size])
        got[bin_size] = {x["feature"]: x["value"] for x in c.count(aln, hits, iv.interval_features(regions), multiple="all1").collect()}
    assert got[16] == got[1 << 14]
    brute = {n: 0 for n, _, _ in FEATURES} | {"-1": 0}
    for a, b in SPANS:
        cover = [{n for n, s, e in FEATURES if s <= x <= e} for x in range(a, b)]
        some = [x for x in cover if x]
        found = set().union(*cover) if mode == "union" else (set.intersection(*some) if some else set()) if mode == "intersection_non_empty" else set.intersection(*cover)
        for n in found or {"-1"}:
            brute[n] += 1
    assert got[16] == brute
    if mode != "intersection_non_empty":
        assert {k: brute[k] for k in ("-1", "D")} == {k: expected[k] for k in ("-1", "D")}


def test_two_reads_of_one_sequence(spark):
    aln = rows(spark, (1, 0, "G", 1, "4M", "ACGT", 0), (2, 0, "G", 9, "4M", "ACGT", 0))
    sq = spark.createDataFrame([("G", 30803.0), ("H", 10.0)], "feature string, size double")
    feats = sq.withColumn("annotator", F.lit("seqname"))
    value = lambda **o: {x["feature"]: x["value"] for x in c.count(aln, c.seqname_hits(aln, sq), feats, **o).collect()}
    assert value(multiple="all1") == {"-1": 0, "G": 2, "H": 0}
    assert value(multiple="dist1", discard_zeros=True) == {"G": 2}
    assert value(multiple="all1", normalization="normed")["G"] == 2 / 30803
    assert math.isclose(value(multiple="all1", normalization="scaled")["G"], 2)
    assert value(multiple="all1", normalization="fpkm")["G"] == 2 / 30803 * 1e9 / 2


def test_sharing_without_unique_support(spark):
    """Two groups on the same nine features: a ninth each; an unaligned group is unassigned."""
    aln = rows(spark, *[(g, 0, f"s{k}", 1, "4M", "ACGT", 0) for g in (1, 2) for k in range(9)], (3, 4, "*", 0, "*", "A", None))
    sq = spark.createDataFrame([(f"s{k}", 5.0) for k in range(9)], "feature string, size double")
    got = {x["feature"]: x["value"] for x in c.count(aln, c.seqname_hits(aln, sq), sq.withColumn("annotator", F.lit("seqname"))).collect()}
    assert got.pop("-1") == 1 and all(math.isclose(v, 2 / 9) for v in got.values()) and len(got) == 9


def test_undefined_totals_are_dropped(spark):
    aln = rows(spark, (1, 4, "*", 0, "*", "A", None))
    sq = spark.createDataFrame([("G", 10.0)], "feature string, size double")
    got = c.count(aln, c.seqname_hits(aln, sq), sq.withColumn("annotator", F.lit("seqname")), normalization="scaled").collect()
    assert [(x["feature"], x["value"]) for x in got] == [("-1", 1.0)]


def test_unknown_sequence_and_option(spark):
    aln = rows(spark, (1, 0, "X", 1, "4M", "ACGT", 0))
    sq = spark.createDataFrame([("G", 10.0)], "feature string, size double")
    with pytest.raises(Exception, match="unknown sequence X"):
        c.seqname_hits(aln, sq).collect()
    with pytest.raises(ValueError, match="did you mean 'dist1'"):
        c.count(aln, aln, aln, multiple="dist")


def test_gff_names(spark):
    attrs = "array<struct<k:string,v:string>>"
    gff = spark.createDataFrame([("S", "x", "gene", 1, 10, "+", [("ID", "a"), ("gene_id", "b"), ("GO", "1"), ("GO", "2")]), ("S", "x", "cds", 1, 5, "+", [("ID", "c")])], f"seq_id string, source string, gtype string, start long, end long, strand string, attrs {attrs}")
    names = lambda *a: {(x["annotator"], x["feature"]) for x in iv.gff_features(gff, *a).collect()}
    assert names(["gene"]) == {("gene", "a"), ("gene", "b")}
    assert names(["gene"], ["GO"]) == {("gene:GO", "1"), ("gene:GO", "2")}
    assert names(["gene", "cds"]) == {("gene", "gene:a"), ("gene", "gene:b"), ("cds", "cds:c")}
    assert names(["gene"], ["ID", "GO"]) == {("gene:ID", "gene:ID:a"), ("gene:GO", "gene:GO:1"), ("gene:GO", "gene:GO:2")}


def test_senses(spark):
    aln = rows(spark, (1, 0, "S", 1, "4M", "ACGT", 0), (2, 16, "S", 1, "4M", "ACGT", 0))
    regions = spark.createDataFrame([("g", "p", "S", 1, 9, "+"), ("g", "m", "S", 1, 9, "-"), ("g", "n", "S", 1, 9, ".")], "annotator string, feature string, seq_id string, r_start long, r_stop long, r_strand string")
    hits = lambda s: {(x["group_id"], x["feature"]) for x in iv.interval_hits(aln, regions, sense=s).collect()}
    assert len(hits("both")) == 6 and hits("sense") == {(1, "p"), (2, "m")} and hits("antisense") == {(1, "m"), (2, "p")}


def test_select(spark):
    aln = rows(
        spark,
        (1, 64, "A", 1, "4M", "ACGT", 0), (1, 128, "A", 9, "4M", "ACGT", 0),  # a pair on one sequence
        (2, 64, "A", 1, "4M", "ACGT", 0), (2, 128, "B", 9, "4M", "ACGT", 0),  # a pair on two
        (3, 64, "A", 1, "4M", "ACGT", 0), (3, 128 | 4, "*", 0, "*", "ACGT", None),  # one mate aligned
        (4, 4, "*", 0, "*", "ACGT", None),
        (5, 64, "A", 1, "4M", "ACGT", 0), (5, 320, "A", 5, "4M", "*", 0), (5, 128, "A", 9, "4M", "ACGT", 0),
    )
    assert lines(m.select(aln, ["mapped"])) == [0, 1, 2, 3, 4, 7, 8, 9]
    assert lines(m.select(aln, ["unmapped"])) == [6] == lines(m.select(aln, drop_if=["mapped"]))
    assert lines(m.select(aln, ["unique"])) == [0, 1, 4, 5, 6]
    assert lines(m.select(aln, ["mapped", "unique"])) == [0, 1, 4]
    assert lines(m.select(aln, drop_if=["unique"])) == [2, 3, 7, 8, 9]
    assert m.mapstats(aln).first().asDict() == {"total": 5, "aligned": 4, "unique": 2}
    with pytest.raises(ValueError):
        m.select(aln, ["mapped"], ["unique"])


def test_filters(spark):
    aln = rows(spark, (1, 64, "A", 1, "10M", "A" * 10, 0), (1, 64, "B", 1, "8M2S", "A" * 10, 2), (2, 64 | 2, "A", 1, "4M6S", "A" * 10, None), (3, 64, "A", 1, "bad", "A", 0))
    assert lines(m.filter_matches(aln, min_identity_pc=90)) == [0]
    assert lines(m.filter_matches(aln, min_match_size=8)) == [0, 1]
    assert lines(m.filter_matches(aln, min_match_size=8, reverse=True)) == [2, 3]
    assert lines(m.filter_matches(aln, max_trim=2)) == [0, 1, 3]
    assert lines(m.filter_matches(aln, max_trim=2, reverse=True)) == []
    got = m.filter_matches(aln, min_identity_pc=90, action="unmatch").orderBy("line_no").collect()
    assert [(x["flag"], x["rname"], x["cigar"]) for x in got][2] == (64 | 4, "*", "*") and got[0]["rname"] == "A"


def test_best_pairs_and_merge(spark):
    aln = rows(spark, (1, 64, "A", 1, "9M", "A", 3), (1, 64, "B", 1, "9M", "A", 1), (1, 64, "C", 1, "9M", "A", None), (1, 128, "A", 1, "9M", "A", 7), (2, 64, "A", 1, "9M", "A", None), (2, 64, "B", 1, "9M", "A", None))
    assert lines(m.allbest(aln)) == [1, 3, 4, 5]
    pe = rows(spark, (1, 64, "A", 1, "4M", "A", 0), (1, 64 | 256, "A", 3, "4M", "A", 0), (1, 144, "A", 9, "4M", "A", 0), (1, 400, "A", 12, "4M", "A", 0), (1, 144, "B", 9, "4M", "A", 0))
    assert [x["line_no"] for x in m.pe_filter(pe).orderBy("pair_line", "pair_mate").collect()] == [0, 2, 1, 2]
    a = rows(spark, (0, 0, "A", 1, "9M", "A", 2), (1, 4, "*", 0, "*", "A", None)).withColumn("group_no", F.col("group_id"))
    b = rows(spark, (0, 0, "B", 1, "8M1I", "A", 1), (1, 4, "*", 0, "*", "A", None)).withColumn("group_no", F.col("group_id"))
    assert sorted((x["group_no"], x["part"]) for x in m.merge_best([a, b]).collect()) == [(0, 1), (1, 1)]


def test_lost_sequences_come_back(spark):
    aln = rows(spark, (1, 64, "A", 1, "4M", "ACGT", 5), (1, 320, "B", 1, "3M1H", "*", 0))
    best = m.reinjected(m.allbest(m.with_donors(aln))).first()
    assert (best["seq"], best["cigar"]) == ("ACGT", "3M1S")


def test_as_reads(spark):
    aln = rows(spark, (1, 64, "A", 1, "4M", "AA", 0), (1, 128, "A", 1, "4M", "CC", 0), (1, 320, "A", 1, "4M", "GG", 0), (2, 64, "A", 1, "4M", "TT", 0), (3, 64, "A", 1, "4M", "AC", 0), (3, 320, "A", 1, "4M", "AG", 0), (4, 0, "A", 1, "4M", "*", 0), (5, 0, "A", 1, "2M", "A", 0), (5, 0, "A", 1, "2M", "C", 0))
    assert sorted((x["rec_no"], x["mate"], x["seq"]) for x in m.as_reads(aln).collect()) == [(1, 1, "AA"), (1, 2, "CC"), (2, 0, "TT"), (3, 0, "AC")]


def one(spark, qual, seq=None):
    return spark.createDataFrame([("@h", seq or "A" * len(qual), qual)], "header string, seq string, qual array<int>")


def trimmed(df, f):
    read = f(r.Read(F.col("header"), F.col("seq"), F.col("qual")))
    return df.select(read.seq.alias("seq"), read.qual.alias("qual")).first()


def test_trims(spark):
    q = one(spark, [30, 10, 30, 30, 5, 30, 30], "ACGTACG")
    assert tuple(trimmed(q, lambda x: x.substrim(20))) == ("GT", [30, 30])
    assert tuple(trimmed(q, lambda x: x.substrim(50))) == ("", [])
    assert tuple(trimmed(one(spark, [1, 30, 2, 30, 1]), lambda x: x.endstrim(20))) == ("AAA", [30, 2, 30])
    assert tuple(trimmed(one(spark, [1, 30, 1]), lambda x: x.endstrim(20, "5"))) == ("AA", [30, 1])
    assert tuple(trimmed(one(spark, [1, 1]), lambda x: x.endstrim(20))) == ("", [])
    assert tuple(trimmed(one(spark, [9, 9, 9], "ANn"), lambda x: x.n_to_zero_quality())) == ("ANn", [9, 0, 0])
    assert tuple(trimmed(q, lambda x: x[2:4])) == ("GT", [30, 30])
    with pytest.raises(Exception, match="slice outside"):
        trimmed(q, lambda x: x[0:9])


@pytest.mark.parametrize(("window", "expected"), [(3, [27, 22, 17, 13]), (4, [24, 20, 16, 12])])
def test_smoothing(spark, window, expected):
    assert one(spark, [28, 25, 14, 12]).select(r.smoothed(F.col("qual"), window).alias("x")).first()["x"] == expected


def reads(spark, *items):
    return spark.createDataFrame([("s", 0, mate, no, f"@{no}", s, [30] * len(s)) for mate, no, s in items], "sample string, file_id int, mate tinyint, rec_no long, header string, seq string, qual array<int>")


def test_pairs_settle(spark):
    rs = reads(spark, (1, 0, "AAAA"), (2, 0, "CC"), (1, 1, "GGGG"), (2, 1, "TTTT"), (1, 2, "A"), (2, 2, "C"), (0, 0, "AAAAA"))

    def block(b):
        b.discard(b.read.length() < 3)

    got = lambda **o: sorted((x["mate"], x["seq"]) for x in r.preprocess(rs, block, **o).collect())
    assert got() == [(0, "AAAA"), (0, "AAAAA"), (1, "GGGG"), (2, "TTTT")]
    assert got(keep_singles=False) == [(0, "AAAAA"), (1, "GGGG"), (2, "TTTT")]
    steps = [lambda x: (x[0:1], None), lambda x: (x, x.length() == 1)]
    assert r.preprocess(rs, None, steps=steps).count() == 7


def test_read_sets(spark):
    rs = reads(spark, (0, 0, "A"), (0, 1, "A"), (0, 2, "C"), (0, 3, "A"))
    assert sorted(x["rec_no"] for x in r.unique(rs).collect()) == [0, 2] and r.unique(rs, 2).count() == 3
    with pytest.raises(ValueError):
        r.unique(rs, 0)
    both = r.group([rs, rs], "g")
    assert {(x["sample"], x["file_id"]) for x in both.collect()} == {("g", 0), ("g", 1)}
    stats = r.file_stats(rs, ["sample"]).first()
    assert (stats["n_seqs"], stats["a"], stats["c"], stats["other"], stats["gc"]) == (4, 3, 1, 0, 0.25)
    assert r.discard_singles(rs).count() == 0


def test_merge(spark):
    a = spark.createDataFrame([("A", 7.0), ("B", 12.0)], "feature string, `1` double")
    b = spark.createDataFrame([("A", 1.0, 2.0), ("E", 7.0, 8.0)], "feature string, `2` double, `3` double")
    assert sorted(map(tuple, merge.paste([a, b]).collect())) == [("A", 7.0, 1.0, 2.0), ("B", 12.0, 0.0, 0.0), ("E", 0.0, 7.0, 8.0)]
    counts = spark.createDataFrame([("x", "f", 1.0), ("y", "g", 2.0)], "sample string, feature string, value double")
    assert sorted(map(tuple, merge.collect(counts, ["y", "x"]).collect())) == [("f", 0.0, 1.0), ("g", 2.0, 0.0)]


FAKE = """import sys
lines = sys.stdin.read().split("\\n")
print("@SQ\\tSN:A\\tLN:9")
for k in range(0, len(lines) - 1, 4):
    print("\\t".join([lines[k][1:], "0", "A", "1", "60", f"{len(lines[k + 1])}M", "*", "0", "0", lines[k + 1], lines[k + 3], "NM:i:0"]))
"""


def test_aligner_processes(spark, tmp_path):
    """A stand-in for an aligner; real ones are not installed here."""
    import sys

    from strandlake.operators import external

    (tmp_path / "fake.py").write_text(FAKE.replace("\\\\", "\\"))
    rs = reads(spark, (1, 0, "AAAA"), (2, 0, "CC"), (0, 1, "GGG"))
    got = external.map_reads(rs, "", command=[sys.executable, str(tmp_path / "fake.py")]).collect()
    assert sorted((x["qname"], x["cigar"], x["sample"]) for x in got) == [("0", "2M", "s"), ("0", "4M", "s"), ("1", "3M", "s")]
    assert len({x["group_id"] for x in got}) == 2
    with pytest.raises(Exception, match="is not installed"):
        external.map_reads(rs, "ref").collect()
    assert external.mapper_command("bwa", "r", True)[-3:] == ["-p", "r", "-"] and "-a" in external.mapper_command("bwa", "r", True)
    with pytest.raises(ValueError):
        external.mapper_command("bowtie", "r")


def test_stats_table_and_comments(spark):
    from strandlake.sources import tables

    rows = {x["feature"]: x["value"] for x in r.stats_table(r.file_stats(reads(spark, (0, 0, "ACGN")))).collect()}
    assert rows["0:numSeqs"] == "1" and rows["0:minSeqLen"] == "4" and rows["0:nonATCGFraction"] == "0.25" and len(rows) == 8
    df = spark.range(3)
    one, two = tables.auto_comments(["hash"], plan=df), tables.auto_comments(["hash"], plan=spark.range(3))
    assert one == two and tables.auto_comments(["script"], "a\nb")[1:] == ["    a", "    b"]
    with pytest.raises(ValueError):
        tables.auto_comments(["time"])


def test_name_keys_are_computed_once_a_row(spark):
    names = ["q10", "q9", "q", "q09", "7", "10", "a1b2", "a1b10", "!x", "r2.3/1", "r2.10/1", ""]
    rows = spark.createDataFrame([(n, 64, k) for k, n in enumerate(names)], "qname string, flag long, line_no long")
    got = m.sort(rows, "name")
    import re

    key = lambda n: "\0".join(p.rjust(20, "0") if p.isdigit() else p for p in re.findall(r"\d+|\D+", n)).encode()
    assert [x["qname"] for x in got.collect()] == sorted(names, key=lambda n: (key(n), names.index(n)))
    order = next(line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Sort [" in line)
    assert "(" not in order  # columns only: an expression would be computed in every comparison


def exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


@pytest.mark.parametrize("multiple", c.MULTIPLE)
def test_hits_are_gone_through_once(spark, multiple):
    groups = spark.range(4).select(F.col("id").alias("group_id"))
    hits = spark.createDataFrame([(0, "a"), (0, "a"), (1, "a"), (1, "b"), (2, "c")], "group_id long, feature string").withColumn("annotator", F.lit("x"))
    features = spark.createDataFrame([("x", f, 1.0) for f in "abcd"], "annotator string, feature string, size double")
    got = c.count(groups, hits, features, multiple)
    expected = {"all1": (2.0, 1.0), "1overN": (1.5, 0.5), "unique_only": (1.0, 0.0), "dist1": (2.0, 0.0)}[multiple]
    assert {x["feature"]: x["value"] for x in got.collect()} == {"a": expected[0], "b": expected[1], "c": 1.0, "d": 0.0, "-1": 1.0}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "LocalRelation [group_id" not in plan  # what is joined and summed up are rows of features


def test_reads_of_one_group_are_shuffled_once(spark):
    aln = spark.createDataFrame([(1, 1, 0, "s", 5, "ACGT")], "group_id long, line_no long, flag long, rname string, pos long, seq string")
    regions = spark.createDataFrame([("f", "s", 1, 9, "+")], "feature string, seq_id string, r_start long, r_stop long, r_strand string").withColumn("annotator", F.lit("x"))
    got = iv.interval_hits(aln, regions, "intersection_non_empty")
    assert [x["feature"] for x in got.collect()] == ["f"]
    assert "REPARTITION_BY_COL" in exchanges(got)[0]  # nothing is shuffled after that, though the annotator is a constant


def test_best_rows_are_sorted_once(spark):
    rows = spark.createDataFrame([(0, 1, 64, "4M", "NM:i:1"), (0, 2, 64, "4M", "NM:i:0")], "group_no long, line_no long, flag long, cigar string, extra string")
    got = m.merge_best([rows, rows.withColumn("extra", F.lit("NM:i:2"))]).select("group_no", "line_no", "part")
    assert [tuple(x) for x in got.collect()] == [(0, 2, 0)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert final.count("Sort [") == 1 and len([x for x in exchanges(got) if x in final]) == 1


def test_annotation_files_are_parsed_once(spark, tmp_path):
    from strandlake.operators import annotate

    (tmp_path / "x.gff").write_text("s\tx\tgene\t1\t8\t.\t+\t.\tgene_id=f\n")
    (tmp_path / "x.map").write_text("#gene\tk\ns\tf\n")
    aln = spark.createDataFrame([(1, 1, 0, "s", 5, "ACGT")], "group_id long, line_no long, flag long, rname string, pos long, seq string")
    for options in ({"features": ["gene"], "subfeatures": ["gene_id"], "gff_file": str(tmp_path / "x.gff")}, {"features": ["k"], "functional_map": str(tmp_path / "x.map")}):
        got = annotate.count_alignments(spark, aln, **options, multiple="all1")
        assert {x["feature"]: x["value"] for x in got.collect()} == {"f": 1.0, "-1": 0.0}
        assert not [x for x in got.inputFiles() if x.endswith((".gff", ".map"))]
