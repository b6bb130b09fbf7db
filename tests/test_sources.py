"""Readers and writers on small files of our own."""

import bz2
import gzip
import lzma

import pytest
from pyspark.sql import functions as F

from strandlake import functions as fn
from strandlake.sources import fastq, sam, tables, text

READS = "@a/1\nACGT\n+\nIIII\n@a/2\nTTTT\n+\n!!!!\n@b\nGG\n+x\nII\n@c/1\nA\n+\nI\n@c/2\nC\n+\nI\n"


def write(path, content, how=open):
    with how(path, "wt") as f:
        f.write(content)
    return str(path)


@pytest.mark.parametrize(("ext", "how"), [("fq", open), ("fq.gz", gzip.open), ("fq.bz2", bz2.open), ("fq.xz", lzma.open)])
def test_fastq_reads_all_compressions(spark, tmp_path, ext, how):
    rows = fastq.fastq(spark, write(tmp_path / f"x.{ext}", READS.replace("\n", "\r\n"), how), sample="s").orderBy("rec_no").collect()
    assert [r["header"] for r in rows] == ["@a/1", "@a/2", "@b", "@c/1", "@c/2"]
    assert rows[0]["qual"] == [40] * 4 and rows[1]["qual"] == [0] * 4 and rows[2]["seq"] == "GG"


def test_encodings(spark, tmp_path):
    solexa = write(tmp_path / "s.fq", "@a\nAC\n+\nCC\n@b\nAC\n+\nhh\n")
    assert fastq.detect_encoding(fastq.raw_records(spark, solexa)) == 64
    assert fastq.detect_encoding(fastq.raw_records(spark, write(tmp_path / "e.fq", ""))) == 33
    assert fastq.fastq(spark, solexa, "33").orderBy("rec_no").first()["qual"] == [34, 34]
    with pytest.raises(ValueError, match="unknown encoding"):
        fastq.fastq(spark, solexa, "ascii")
    with pytest.raises(fastq.DataError):
        fastq.detect_encoding(fastq.raw_records(spark, write(tmp_path / "bad.fq", "@a\nA\n+\n \n")))


@pytest.mark.parametrize("content", ["@a\nACGT\n+\nIII\n", "@a\nACGT\n+\n"])
def test_malformed_fastq_fails(spark, tmp_path, content):
    with pytest.raises(Exception, match="record 0"):
        fastq.fastq(spark, write(tmp_path / "x.fq", content), "33").collect()


def test_uninterleave_and_writing(spark, tmp_path):
    reads = fastq.fastq(spark, write(tmp_path / "i.fq", READS), interleaved=True, sample="s")
    got = sorted((r["mate"], r["rec_no"], r["header"]) for r in reads.collect())
    assert got == [(0, 0, "@b"), (1, 0, "@a/1"), (1, 1, "@c/1"), (2, 0, "@a/2"), (2, 1, "@c/2")]
    names = fastq.write_reads(reads, str(tmp_path / "o.fq.gz"))
    assert [n.rsplit("/", 1)[1] for n in names] == ["o.pair.1.fq.gz", "o.pair.2.fq.gz", "o.singles.fq.gz"]
    assert gzip.open(names[0], "rt").read() == "@a/1\nACGT\n+\nIIII\n@c/1\nA\n+\nI\n"
    one = fastq.write_reads(reads, str(tmp_path / "all.fq"), interleaved=True)
    assert open(one[0]).read().split("\n")[0::4][:5] == ["@a/1", "@a/2", "@c/1", "@c/2", "@b"]


def test_paired_zips_to_the_shorter_file(spark, tmp_path):
    a, b = write(tmp_path / "x.1.fq", "@a\nA\n+\nI\n@b\nC\n+\nI\n"), write(tmp_path / "x.2.fq", "@a\nG\n+\nI\n")
    assert sorted((r["mate"], r["seq"]) for r in fastq.paired(spark, a, b).collect()) == [(1, "A"), (2, "G")]


def test_directory_and_manifest(spark, tmp_path):
    pairs, single = fastq.match_files(["b_1.fq", "b_2.fq", "a.pair.1.fq.gz", "a.pair.2.fq.gz", "a.single.fq.gz", "z.fastq", "notes.txt"])
    assert pairs == [("a.pair.1.fq.gz", "a.pair.2.fq.gz", "a.single.fq.gz"), ("b_1.fq", "b_2.fq", "")] and single == ["z.fastq"]
    with pytest.raises(fastq.DataError):
        fastq.match_files(["b_1.fq"])
    for n in ("b_1.fq", "b_2.fq", "z.fastq"):
        write(tmp_path / n, "@a\nA\n+\nI\n")
    assert fastq.load_fastq_directory(spark, str(tmp_path)).count() == 3
    yaml = write(tmp_path / "list.yaml", "samples:\n  two:\n    - single: z.fastq\n  one:\n    - paired: [b_1.fq, b_2.fq]\n")
    assert sorted(r["sample"] for r in fastq.load_sample_list(spark, yaml).collect()) == ["one", "one", "two"]
    assert fastq.load_sample_from_yaml(spark, yaml, "two").count() == 1
    with pytest.raises(fastq.DataError):
        fastq.load_sample_from_yaml(spark, yaml, "three")


SAM = "@SQ\tSN:A\tLN:100\n@SQ\tSN:B\tLN:50\nr1\t99\tA\t8\t60\t4M\t=\t20\t0\tACGT\tIIII\tNM:i:1\tX:Z:q\nr1\t147\tA\t20\t60\t4M\t=\t8\t0\tACGT\tIIII\tNM:i:0\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\nr1\t0\tB\t1\t0\t2M\t*\t0\t0\t*\t*\tNM:i:0\n"


def test_samfile_groups_neighbouring_lines(spark, tmp_path):
    rows, head = sam.samfile(spark, write(tmp_path / "x.sam", SAM), "s")
    got = rows.orderBy("line_no").collect()
    assert [r["group_id"] for r in got] == [2, 2, 4, 5]
    assert got[0]["extra"] == "NM:i:1\tX:Z:q" and (got[2]["qual"], got[2]["extra"]) == ("", "II")
    assert [(r["feature"], r["size"]) for r in sam.sequences(head).orderBy("feature").collect()] == [("A", 100.0), ("B", 50.0)]
    out = sam.write_sam(rows, head, str(tmp_path / "y.sam"))
    assert open(out).read() == SAM
    unpaired, _ = sam.samfile(spark, str(tmp_path / "x.sam"), "s", paired=False)
    assert [r["group_id"] for r in unpaired.orderBy("line_no").collect()] == [2, 3, 4, 5]


def test_short_alignment_lines_fail(spark, tmp_path):
    with pytest.raises(Exception, match="fewer than 11"):
        sam.samfile(spark, write(tmp_path / "x.sam", "r1\t0\tA\n"))[0].collect()


def test_gff_attributes(spark, tmp_path):
    path = write(tmp_path / "a.gff", '# c\n\nA\tx\tgene\t10\t20\t.\t+\t.\tID=g1;GOs=GO:1,GO:2;\nA\tx\texon\t1\t5\t.\t.\t.\tgene_id "g2"; gene_name "n";\n')
    rows = tables.gff(spark, path).orderBy("start").collect()
    assert [(a["k"], a["v"]) for a in rows[1]["attrs"]] == [("ID", "g1"), ("GOs", "GO:1"), ("GOs", "GO:2")]
    assert [(a["k"], a["v"]) for a in rows[0]["attrs"]] == [("gene_id", "g2"), ("gene_name", "n")] and rows[0]["strand"] == "."
    with pytest.raises(Exception, match="nine columns"):
        tables.gff(spark, write(tmp_path / "b.gff", "A\tx\n")).collect()


def test_functional_map(spark, tmp_path):
    path = write(tmp_path / "m.tsv", "# text\n#gene\tcog\tko\ng1\ta,b\tk1\ng2\t\tk1|k2\ng1\tc\tk3\n")
    got = {(r["gene"], r["annotator"], r["feature"]) for r in tables.functional_map(spark, path, ["cog", "ko"]).collect()}
    assert got == {("g1", "cog", "c"), ("g1", "ko", "k3"), ("g2", "ko", "k1"), ("g2", "ko", "k2")}
    plain = write(tmp_path / "n.tsv", "gene\tcog\ng1\ta\n")
    assert tables.functional_map(spark, plain, ["cog"]).count() == 1
    with pytest.raises(ValueError, match="no columns"):
        tables.functional_map(spark, plain, ["ko"])


def test_fasta_and_blocks(spark, tmp_path):
    rows = tables.fasta(spark, write(tmp_path / "x.fna", ">a one\nACGT\nAC\n>b\nGG\n>c\nACGTACGT\n"))
    got = [(r["name"], r["seq"], r["length"]) for r in rows.orderBy("rec_no").collect()]
    assert got == [("a", "ACGTAC", 6), ("b", "GG", 2), ("c", "ACGTACGT", 8)]
    assert tables.split_blocks(rows, 8) == {"a": 0, "b": 0, "c": 1}


def test_count_tables(spark, tmp_path):
    counts = spark.createDataFrame([("b", 1.5), ("-1", 2.0), ("a", 1.9999999999999998)], "feature string, x double")
    path = tables.write_counts(counts, str(tmp_path / "o.txt"), ["x"], comments=["hi"])
    assert open(path).read() == "# hi\n\tx\n-1\t2\na\t1.9999999999999998\nb\t1.5\n"
    assert [tuple(r) for r in tables.countfile(spark, path).collect()] == [("-1", 2.0), ("a", 1.9999999999999998), ("b", 1.5)]
    assert open(tables.write_counts(counts, str(tmp_path / "o.csv"), ["x"], "csv")).read().startswith(",x\n-1,2\n")


def test_bed_lines_and_paths(spark, tmp_path):
    assert [tuple(r) for r in tables.bed(spark, write(tmp_path / "r.bed", "A\t0\t10\n")).collect()] == [("A", 1, 10)]
    assert text.readlines(write(tmp_path / "l", "a\r\nb\n")) == ["a", "b"]
    write(tmp_path / "f.txt", "x")
    assert text.expand("<r>/f.txt", [f"r={tmp_path}"]) == f"{tmp_path}/f.txt"


def test_scalars():
    assert [fn.double_text(x) for x in (1.0, 0.0389, 12345678.9, 0.1, 1e7, -2.5)] == ["1.0", "3.89e-2", "1.23456789e7", "0.1", "1.0e7", "-2.5"]
    assert fn.read_int(" 7 ") == 7 and fn.read_int("", 3) == 3 and fn.read_double("1.5") == 1.5
    for bad in ("", "x"):
        with pytest.raises(fastq.DataError):
            fn.read_int(bad)
    assert fn.join_path("a", "b") == "a/b" and fn.join_path("a", "/b") == "/b"
    f = fn.Functions()
    f.register("twice")(lambda df: df.union(df))
    with pytest.raises(ValueError, match="did you mean 'twice'"):
        f.call("twise")


def test_numbered_lines_over_many_splits(spark, tmp_path):
    path = write(tmp_path / "big.txt", "".join(f"{k}\n" for k in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert text.numbered_lines(spark, path).where(F.col("value").cast("long") != F.col("line_no")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_uninterleave_is_the_sequential_pairing(spark):
    """Against one look ahead at a time, over slices much smaller than the file."""
    import random

    from strandlake.sources import ordered

    r = random.Random(7)
    headers = [f"@{r.choice('abc')}" for _ in range(400)]
    rows = spark.createDataFrame([("s", 0, 2 * k, h, "A", [1]) for k, h in enumerate(headers)], "sample string, file_id int, rec_no long, header string, seq string, qual array<int>")
    want, k = [], 0
    pairs = singles = 0
    while k < len(headers):
        if k + 1 < len(headers) and headers[k] == headers[k + 1]:
            want += [(1, pairs, headers[k]), (2, pairs, headers[k])]
            pairs, k = pairs + 1, k + 2
        else:
            want.append((0, singles, headers[k]))
            singles, k = singles + 1, k + 1
    old = ordered.SLICE
    for f in (ordered.neighbour, ordered.running):
        f.__defaults__ = (*f.__defaults__[:-1], 7)
    try:
        got = [(x["mate"], x["rec_no"], x["header"]) for x in fastq.uninterleave(rows).collect()]
    finally:
        for f in (ordered.neighbour, ordered.running):
            f.__defaults__ = (*f.__defaults__[:-1], old)
    assert sorted(got) == sorted(want)


def test_members_of_a_gz_file_are_split_between_tasks(spark, tmp_path, monkeypatch):
    """Lines may lie in several members; numbers are those of one pass over the file."""
    monkeypatch.setattr(text, "_gz_ranges", lambda size: [(lo, min(lo + 1000, size)) for lo in range(0, size, 1000)])
    lines = [f"{k} {k * 7919 % 10007}" * (1 + k % 3) for k in range(3000)]
    whole = "\n".join(lines).encode()
    for size, tail in ((700, b""), (1000, b"\n"), (len(whole) + 1, b"")):
        content, path = whole + tail, str(tmp_path / f"x{size}.gz")
        with open(path, "wb") as file:
            file.writelines(gzip.compress(content[k : k + size]) for k in range(0, len(content), size))
        found = text.numbered_lines(spark, path)
        assert [(r["line_no"], r["value"]) for r in found.orderBy("line_no").collect()] == list(enumerate(lines))
        assert (found.rdd.getNumPartitions() > 5) == (size < len(whole))
        assert found.select("file").distinct().first()[0] == spark.read.text(path).select("_metadata.file_path").first()[0]
    single = str(tmp_path / "r.gz")
    with gzip.open(single, "wb") as file:
        file.write(b"a\rb\r\nc")
    assert [r["value"] for r in text.numbered_lines(spark, single).orderBy("line_no").collect()] == ["a", "b", "c"]


def test_lines_are_numbered_without_a_shuffle_of_lines(spark, tmp_path):
    found = text.numbered_lines(spark, write(tmp_path / "x.txt", "a\nb\n"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_groups_over_slices_of_lines(spark):
    rows = spark.range(50_000).select(F.col("id").alias("line_no"), F.lit("s").alias("sample"), F.lit(64).alias("flag"), F.when(F.col("id") < 45_000, "a").otherwise(F.col("id").cast("string")).alias("qname"))
    got = sam.group_ids(rows).groupBy("group_id").count()
    assert got.where("group_id = 0").first()["count"] == 45_000 and got.count() == 5_001
