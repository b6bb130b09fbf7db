"""One writer for all, counting in one call, mapping with indexes and blocks, work by items, blocks over alignments."""

import gzip
import os
import sys
import time

import pytest
from pyspark.sql import functions as F

from strandlake import functions as fn
from strandlake.operators import annotate, external, parallel
from strandlake.operators import mapped as m
from strandlake.operators import reads as r
from strandlake.sources import fastq, sam, tables, text
from strandlake.sources.write import kind_of, subsampled_name, write

from .test_operators import reads, rows

# --- writing


def test_write_dispatches_by_columns(spark, tmp_path):
    rs, counts = reads(spark, (0, 0, "ACGT")), spark.createDataFrame([("b", 1.5), ("a", 2.0)], "feature string, s double")
    aln = rows(spark, (1, 0, "A", 1, "4M", "ACGT", 0)).withColumns({"mapq": F.lit(0).cast("long"), "rnext": F.lit("*"), "pnext": F.lit(0).cast("long"), "tlen": F.lit(0).cast("long")})
    assert [kind_of(x) for x in (rs, counts, aln, "x")] == ["reads", "counts", "alignments", "file"]
    with pytest.raises(TypeError):
        kind_of(spark.range(1))
    at = lambda n: str(tmp_path / n)
    assert write(counts, at("c.tsv.gz"), comment="made") == at("c.tsv.gz")
    assert gzip.open(at("c.tsv.gz"), "rt").read() == "# made\n\ts\na\t2\nb\t1.5\n"
    write(counts, at("c.csv"), "csv")
    assert open(at("c.csv")).read() == ",s\na,2\nb,1.5\n"
    write(rs, at("r.fq"), subsample=True)
    assert open(at("r.subsampled.fq")).read().splitlines()[1] == "ACGT" and subsampled_name("x.tsv") == "x.tsv.subsampled"
    write(aln, at("a.sam"))
    assert open(at("a.sam")).read().split("\t")[5] == "4M"
    for bad in ({"format": "xml"}, {"auto_comments": ["time"]}):
        with pytest.raises(ValueError):
            write(counts, at("bad"), **bad)
    with pytest.raises(ValueError):
        write(aln, at("a.txt"), format="tsv")
    with pytest.raises(ValueError):
        write(rs, at("r.fq"), format_flags=["gz"])
    if not __import__("shutil").which("samtools"):
        with pytest.raises(RuntimeError, match="samtools"):
            write(aln, at("a.bam"))
    assert sorted(os.listdir(tmp_path)) == ["a.sam", "c.csv", "c.tsv.gz", "r.subsampled.fq"]  # nothing half written is left


def test_mates_that_do_not_match_are_not_interleaved(spark, tmp_path):
    with pytest.raises(fastq.DataError):
        write(reads(spark, (1, 0, "AA"), (2, 0, "CC"), (1, 1, "GG")), str(tmp_path / "x.fq"), format_flags=["interleaved"])


@pytest.mark.parametrize("ext", ["", ".gz", ".bz2", ".xz", ".zst"])
def test_large_outputs_are_joined_from_parts(spark, tmp_path, ext):
    path = str(tmp_path / f"x.txt{ext}")
    text.write_single(spark.range(20_000).repartition(7).orderBy("id").select(F.col("id").cast("string").alias("line")), path, ["top"])
    assert text.open_input(path).read().decode().splitlines() == ["top", *map(str, range(20_000))]
    assert os.listdir(tmp_path) == [f"x.txt{ext}"]


def test_remote_paths_are_written_through_spark(spark, tmp_path):
    path = str(tmp_path / "x.gz")
    text._write_remote(spark.range(50).repartition(3).orderBy("id").select(F.col("id").cast("string").alias("line")), f"file://{path}", ["top"], "line")
    assert gzip.open(path, "rt").read().splitlines() == ["top", *map(str, range(50))]
    with pytest.raises(ValueError):
        text._write_remote(spark.range(1), "s3a://x/y.xz", [], "line")


def test_comments_and_hashes(spark):
    a, b = "x = 1  # one\n\n y", "x =  1\ny\n"
    assert tables.output_hash(a) == tables.output_hash(b) != tables.output_hash("x = 2") and len(tables.output_hash(a)) == 32
    assert tables.auto_comments(["date"])[0].startswith("Script run on ") and tables.auto_comments(["hash"], a) == [f"Output hash: {tables.output_hash(b)}"]
    assert tables.output_hash(plan=spark.range(3)) == tables.output_hash(plan=spark.range(3)) != tables.output_hash(plan=spark.range(4))


# --- sources


def test_encodings_are_told_by_the_head(spark, tmp_path):
    path = tmp_path / "x.fq"
    path.write_text("@a\nAC\n+\n;;\n" * 1200 + "@b\nAC\n+\n!!\n")
    assert fastq.sniffed(spark, str(path)) is None and fastq.fastq(spark, str(path)).agg(F.min("header")).first()[0] == "@a"
    path.write_text("@a\nAC\n+\nhh\n")
    assert fastq.sniffed(spark, str(path)) == 64
    path.write_text("@a\nAC\n+\n \x1f\n")
    with pytest.raises(fastq.DataError):
        fastq.sniffed(spark, str(path))


def test_gff_corners(spark, tmp_path):
    line = "s\tx\tgene\t1\t9\t.\t{}\t.\t{}\n"
    (tmp_path / "a.gff").write_text(line.format("+x", ' ID=a ; Note = b, c;k "v w" ; lone;') + "\n#c\n")
    row = tables.gff(spark, str(tmp_path / "a.gff")).first()
    assert row["strand"] == "+" and [(x["k"], x["v"]) for x in row["attrs"]] == [("ID", "a"), ("Note ", " b"), ("Note ", " c"), ("k", "v w"), ("lone", "")]
    for strand in ("", "x"):
        (tmp_path / "b.gff").write_text(line.format(strand, "ID=a"))
        with pytest.raises(Exception, match="strand"):
            tables.gff(spark, str(tmp_path / "b.gff")).collect()


def test_names_of_singles(spark, tmp_path):
    assert fastq.match_files(["pair.1_x_1.fq", "pair.1_x_2.fq", "single_x_1.fq"]) == ([("pair.1_x_1.fq", "pair.1_x_2.fq", "single_x_1.fq")], [])


# --- counting in one call


def test_one_annotation_source():
    source = annotate.annotation_source
    assert source(["seqname"], None, None, None, "carried") == ("seqname", "") and source(["x"], "f.map", None, None) == ("map", "f.map") and source(["x"], None, "f.gff", None) == ("gff", "f.gff")
    for given in ((["seqname"], "f.map", None, None), (["x"], "f.map", "f.gff", None), (["x"], None, "f.gff", "hg19"), (["x"], None, None, None)):
        with pytest.raises(ValueError):
            source(*given)


def test_references_by_name(tmp_path):
    (tmp_path / "hg19" / "Annotation").mkdir(parents=True)
    (tmp_path / "hg19" / "Annotation" / "annotation.gtf.gz").write_bytes(b"")
    known = fn.References((str(tmp_path),))
    assert len(fn.PACKAGED) == 16 and annotate.annotation_source(["gene"], None, None, "Homo_sapiens_GRCh37.p13", references=known)[0] == "gff"
    known.add("own", functional_map="m")
    assert annotate.annotation_source(["x"], None, None, None, "own", known) == ("map", "m")
    known.add("both", functional_map="m", gff_file="g")
    for name in ("both", "absent"):
        with pytest.raises(ValueError):
            annotate.annotation_source(["x"], None, None, name, references=known)


# --- alignments


def test_sorted_alignments_have_no_unique_reads(spark):
    aln = rows(spark, (1, 0, "A", 1, "4M", "ACGT", 0))
    assert m.is_sorted(m.sort(aln)) and not m.is_sorted(aln)
    with pytest.raises(ValueError, match="sorted"):
        m.select(m.sort(aln), ["mapped", "unique"])
    assert m.select(m.sort(aln), ["mapped"]).count() == 1


def test_parts_of_different_groups_are_not_merged(spark):
    one = rows(spark, (1, 0, "A", 1, "4M", "ACGT", 0), (2, 0, "A", 1, "4M", "ACGT", 0)).withColumn("group_no", F.col("group_id"))
    with pytest.raises(Exception, match="different numbers of groups"):
        m.merge_best([one, one.where("group_id = 1")]).collect()


def test_blocks_over_groups(spark):
    aln = rows(spark, (1, 64, "A", 1, "4M", "ACGT", 0), (1, 320, "B", 1, "3M1H", "*", 0), (2, 4, "*", 0, "*", "ACGT", 0), (3, 64, "A", 1, "4M", "ACGT", 2), (3, 144, "A", 9, "4M", "TTTT", 0))

    def block(b):
        b.discard(b.flag("unmapped"))
        b.stop(b.some_match("B"))
        b.pe_filter()
        b.filter(max_trim=0, min_identity_pc=40)

    got = sorted((x["group_id"], x["rname"], x["flag"]) for x in m.select_block(aln, block).collect())
    assert got == [(1, "A", 64), (1, "B", 320), (3, "A", 64), (3, "A", 144)]
    kept = m.select_block(aln, lambda b: b.filter(min_match_size=5))
    assert kept.count() == 0 and "_active" not in kept.columns
    alone = m.select_block(aln.where("group_id = 1"), lambda b: b.filter(min_identity_pc=100, min_match_size=3, max_trim=-1)).orderBy(*m.in_mate_order(aln)).collect()
    assert [x["seq"] for x in alone] == ["ACGT", "*"]


def test_statistics(spark):
    aln = rows(spark, (1, 64, "A", 1, "4M", "ACGT", 0), (2, 4, "*", 0, "*", "ACGT", 0))
    got = {x["feature"]: x["value"] for x in r.qcstats("mapping", mappings=[("in", "ref", 3, m.mapstats(aln))] * 2).collect()}
    assert got["0:total"] == "2" and got["1:aligned"] == "1" and got["1:reference"] == "ref" and got["0:lineNumber"] == "3" and len(got) == 12
    with pytest.raises(ValueError):
        r.qcstats("reads")


def test_report(spark, tmp_path):
    aln = rows(spark, (1, 64, "A", 1, "4M", "ACGT", 0))
    made = r.run_report(str(tmp_path / "r"), reads(spark, (0, 0, "ACGN")), [("in", "ref", 3, m.mapstats(aln))], "x = 1")
    assert [os.path.basename(x) for x in made] == ["fq.tsv", "mappings.tsv", "script.txt"] and "0:numSeqs\t1\n" in open(made[0]).read() and "0:total\t1\n" in open(made[1]).read()


# --- early checks and external functions


def test_inputs_and_outputs_are_checked_early(spark, tmp_path):
    for bad in (lambda: write(reads(spark, (0, 0, "A")), str(tmp_path / "no" / "x.fq")), lambda: fastq.paired(spark, str(tmp_path / "a.fq"), str(tmp_path / "b.fq"))):
        with pytest.raises(FileNotFoundError):
            bad()
    with pytest.raises(FileNotFoundError, match="gff"):
        annotate.count_alignments(spark, rows(spark, (1, 64, "A", 1, "4M", "ACGT", 0)), features=["gene"], gff_file="<x>/a.gff", search_path=["x=/nowhere"])


MODULE = """
name: lengths
version: '1.0'
functions:
  - nglName: lengths
    arg0: ./run.py
    arg1: {filetype: fq3, can_gzip: true}
    additional:
      - {name: verbose, atype: flag, def: false, when-true: "-v -x"}
      - {name: by, atype: option, values: [base, read], required: true}
      - {name: least, atype: int, def: 2}
      - {name: table, atype: counts, filetype: tsv}
    return: {rtype: counts, name: ofile, extension: tsv}
references:
  - {name: own, fasta-file: g.fa, gtf-file: g.gtf}
"""
PROGRAM = """#!{python}
import gzip, sys
options = dict(x[2:].split("=", 1) for x in sys.argv if x.startswith("--"))
files = [x for x in sys.argv[1:] if not x.startswith("-")]
if options["by"] == "base":
    sys.exit("no bases")
with open(options["ofile"], "w") as out:
    print("", "n", sep=chr(9), file=out)
    for f in files:
        print(f.split("input.")[1], sum(1 for _ in gzip.open(f)) // 4, sep=chr(9), file=out)
    print("z", len(sys.argv) - len(options) - len(files) - 1 + int(options["least"]), sep=chr(9), file=out)
    if "table" in options:
        print("zt", len(open(options["table"]).readlines()), sep=chr(9), file=out)
"""


def test_external_functions(spark, tmp_path):
    from strandlake.operators.modules import load_module

    (tmp_path / "module.yaml").write_text(MODULE)
    (tmp_path / "run.py").write_text(PROGRAM.replace("{python}", sys.executable))
    os.chmod(tmp_path / "run.py", 0o755)
    known = fn.References()
    lengths = load_module(str(tmp_path / "module.yaml"), known).functions["lengths"]
    assert known.find("own")["fafile"] == str(tmp_path / "g.fa")
    rs = reads(spark, (1, 0, "AA"), (2, 0, "CC"), (0, 1, "GG"), (0, 2, "GG"))
    counts = spark.createDataFrame([("a", 1.0)], "feature string, s double")
    got = {x["feature"]: x["n"] for x in lengths(spark, rs, by="read", verbose=True, table=counts).collect()}
    assert got == {"pair.1.fq.gz": 1, "pair.2.fq.gz": 1, "singles.fq.gz": 2, "z": 4, "zt": 2}
    assert fn.example(rs, b=1, a="x") is rs
    for bad in ({}, {"by": "word"}, {"by": "read", "other": 1}):
        with pytest.raises(ValueError):
            lengths(spark, rs, **bad)
    with pytest.raises(external.ToolError, match="no bases"):
        lengths(spark, rs, by="base")


# --- mapping

ALIGNER = """
import sys
reference = dict(zip(*[iter(open(sys.argv[1]).read().replace(">", "").split())] * 2))
lines = [x.rstrip("\\n") for x in sys.stdin]
print("@HD")
for k in range(0, len(lines) - 1, 4):
    hits = [n for n, s in reference.items() if lines[k + 1] in s]
    for n in hits or ["*"]:
        print("\\t".join([lines[k][1:].split("/")[0], "0" if hits else "4", n, "1", "60", f"{len(lines[k + 1])}M" if hits else "*", "*", "0", "0", lines[k + 1], lines[k + 3], "NM:i:0"]))
"""
INDEXER = "import sys; [open(sys.argv[1] + e, 'w').close() for e in ('.amb', '.ann', '.bwt', '.pac', '.sa')]"


def test_mapping_with_index_and_blocks(spark, tmp_path):
    (tmp_path / "aligner.py").write_text(ALIGNER.replace("\\\\", "\\"))
    (tmp_path / "indexer.py").write_text(INDEXER)
    (tmp_path / "refs").mkdir()
    fasta = tmp_path / "refs" / "g.fa"
    fasta.write_text(">A\nACGTACGT\n>B\nTTTTGGGG\n")
    rs = reads(spark, (0, 0, "ACGT"), (0, 1, "TTGG"), (0, 2, "CCCC"))
    options = {"command": [sys.executable, str(tmp_path / "aligner.py")], "index_command": [sys.executable, str(tmp_path / "indexer.py")], "index_path": str(tmp_path / "index")}
    got = external.map_read_set(spark, rs, fafile="<r>/g.fa", search_path=["r=" + str(tmp_path / "refs")], **options)
    assert sorted(x["rname"] for x in got.rows.collect()) == ["*", "A", "B"] and got.stats[0][3].first()["aligned"] == 2
    place = external.index_place(str(fasta), options["index_path"])
    assert external.has_index(place, "bwa") and not external.has_index(str(fasta), "bwa") and os.path.islink(place)
    # blocks of one sequence each: the best of all blocks stays
    files = tables.split_fasta(spark, str(fasta), str(tmp_path / "g.splits"), 8)
    assert [open(f).read() for f in files] == [">A\nACGTACGT\n", ">B\nTTTTGGGG\n"] == [open(f).read() for f in tables.split_fasta(spark, str(fasta), str(tmp_path / "g.splits"), 8)]
    parts = [external.map_reads(rs, "", command=[*options["command"], f]).withColumn("group_no", F.col("group_id")) for f in files]
    assert sorted(x["rname"] for x in m.merge_best([text.settled(p) for p in parts]).collect()) == ["*", "A", "B"]
    assert external.map_read_set(spark, rs, fafile=str(fasta), block_size_megabases=1, **options).rows.count() == 3
    for bad in ({}, {"reference": "x", "fafile": "y"}):
        with pytest.raises(ValueError):
            external.map_read_set(spark, rs, **bad)


def test_a_failing_aligner_tells_why(spark, tmp_path):
    (tmp_path / "bad.py").write_text("import sys; sys.stderr.write('no such index'); sys.exit(3)")
    with pytest.raises(Exception, match="no such index"):
        external.map_reads(reads(spark, *[(0, k, "ACGT") for k in range(3000)]), "", command=[sys.executable, str(tmp_path / "bad.py")]).collect()


def test_sorted_lines_of_an_aligner(spark, tmp_path):
    (tmp_path / "aligner.py").write_text(ALIGNER.replace("\\\\", "\\"))
    (tmp_path / "g.fa").write_text(">A\nACGTACGT\n")
    got = external.map_reads(reads(spark, *[(0, k, "ACGT") for k in range(40)]), "", "minimap2", command=[sys.executable, str(tmp_path / "aligner.py"), str(tmp_path / "g.fa")])
    names = [x["qname"] for x in got.orderBy("line_no").collect()]
    assert names == sorted(names) and len(names) == 40


# --- work by items


def test_items_are_done_once(tmp_path):
    items, done = ["a", "b/c", "d"], []
    folder = str(tmp_path)

    def work(item):
        done.append(item)
        if item == "d" and done.count("d") == 1:
            raise RuntimeError("broken")

    with pytest.raises(RuntimeError):
        parallel.run_for_all(items, work, folder, "t")
    assert not parallel.all_finished(items, folder, "t")
    assert parallel.run_for_all(items, work, folder, "t") == ["d"] and parallel.all_finished(items, folder, "t")
    assert done == ["a", "b/c", "d", "d"] and parallel.run_for_all(items, work, folder, "t") == []
    assert parallel.run_for_all(items, work, folder, "other") == items


def test_locks_of_others(tmp_path):
    folder = str(tmp_path)
    assert parallel.lock1(["a", "b"], folder) == "a" and parallel.lock1(["a", "b"], folder) == "b"
    with pytest.raises(parallel.NothingLeft):
        parallel.lock1(["a", "b"], folder)
    lock = os.path.join(parallel.lock_folder(["a", "b"], folder), "b.lock")
    os.utime(lock, (time.time() - 5000,) * 2)
    assert parallel.lock1(["a", "b"], folder) == "b"


def test_scalars_of_scripts(spark, tmp_path, capsys):
    assert fn.item([1, 2], 1) == 2 and fn.STDOUT == "/dev/stdout" and fn.arguments() == sys.argv
    for k in (-1, 2):
        with pytest.raises(fastq.DataError):
            fn.item([1, 2], k)
    with pytest.raises(AssertionError):
        fn.check(1 > 2)
    fn.show(1.0)
    fn.show("x", "\n")
    assert capsys.readouterr().out == "1.0x\n"
    assert "Range" in open(fn.export_plan(spark.range(3), str(tmp_path / "p.json"))).read()
    assert sam.guessed_format("x.sam.gz") == "sam" and sam.guessed_format("x.txt") == "bam"
