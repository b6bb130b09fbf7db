"""FASTQ: reads as rows, encodings, interleaved and paired files, directories and manifests."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .checks import check_inputs
from .ordered import neighbour, running
from .text import failing, numbered_lines, write_single

#: Quality offsets by name.
ENCODINGS = {"sanger": 33, "33": 33, "solexa": 64, "64": 64}
EXTENSIONS = tuple(f".{a}{b}" for a in ("fq", "fastq") for b in ("", ".gz", ".bz2", ".xz"))
SUBSAMPLE_EVERY, SUBSAMPLE_READS = 10, 25_000
#: Records looked at before a whole file is, for its encoding.
HEAD = 1000
COLUMNS = ("sample", "file_id", "mate", "rec_no", "header", "seq", "qual")


class DataError(ValueError):
    """The data contradict the format."""


def raw_records(spark: SparkSession, path: str) -> DataFrame:
    """(rec_no, header, seq, text): four lines a record. Incomplete records and unequal lengths fail the job."""
    lines = numbered_lines(spark, path)
    part = lambda k: F.max(F.when(F.col("line_no") % 4 == k, F.col("value")))
    rows = lines.groupBy(F.floor(F.col("line_no") / 4).alias("rec_no")).agg(part(0).alias("header"), part(1).alias("seq"), part(2).alias("plus"), part(3).alias("text"))
    whole = failing(F.col("text").isNotNull(), F.concat(F.lit(f"{path}: record "), F.col("rec_no").cast("string"), F.lit(" is not four lines")))
    equal = failing(F.length("seq") == F.length("text"), F.concat(F.lit(f"{path}: record "), F.col("rec_no").cast("string"), F.lit(" has sequence and qualities of different lengths")))
    return rows.withColumn("text", F.coalesce(whole.cast("string"), equal.cast("string"), F.col("text"))).drop("plus")


def codes(text: str | Column) -> Column:
    """The bytes of a quality string as integers."""
    text = F.col(text) if isinstance(text, str) else text
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.ascii(F.substring(text, i, F.lit(1))))
    return F.when(F.length(text) == 0, F.array().cast("array<int>")).otherwise(each)


def sniffed(spark: SparkSession, path: str) -> int | None:
    """The offset that the first records of a file settle, if they do: a bounded look before any pass over the file."""
    if path.endswith((".xz", ".zst", ".zstd")):
        return None
    for k, row in enumerate(spark.read.text(path).take(4 * HEAD)):
        if k % 4 == 3 and (text := row["value"].rstrip("\r")):
            low, high = min(map(ord, text)), max(map(ord, text))
            if low < 33:
                raise DataError(f"{path}: quality bytes below 33")
            if low < 58 or high >= 78:
                return 33 if low < 58 else 64
    return None


def detect_encoding(records: DataFrame) -> int:
    """33 or 64: the first record that settles it decides, a low byte before a high one; none does: 33."""
    low, high = F.array_min(codes(F.col("text"))), F.array_max(codes(F.col("text")))
    seen = records.select("rec_no", low.alias("low"), high.alias("high"))
    invalid, first = seen.agg(F.min(F.when(F.col("low") < 33, F.col("rec_no"))), F.min(F.when((F.col("low") < 58) | (F.col("high") >= 78), F.struct("rec_no", (F.col("low") < 58).alias("low"))))).first()
    if invalid is not None and (first is None or invalid <= first["rec_no"]):
        raise DataError("quality bytes below 33")
    return 33 if first is None or first["low"] else 64


def decode(records: DataFrame, offset: int, sample: str, file_id: int = 0, mate: int = 0) -> DataFrame:
    qual = F.transform(codes(F.col("text")), lambda q: (q - F.lit(offset)).cast("int"))
    return records.select(F.lit(sample).alias("sample"), F.lit(file_id).alias("file_id"), F.lit(mate).cast("tinyint").alias("mate"), F.col("rec_no").cast("long").alias("rec_no"), "header", "seq", qual.alias("qual"))


def fastq(spark: SparkSession, path: str, encoding: str = "auto", interleaved: bool = False, sample: str | None = None, subsample: bool = False) -> DataFrame:
    """One file as a read set: singletons, or pairs and singletons if interleaved."""
    records = raw_records(spark, path)
    if subsample:
        records = subsampled(records)
    reads = decode(records, _offset(spark, path, records, encoding), sample or path)
    return uninterleave(reads) if interleaved else reads


def _offset(spark: SparkSession, path: str, records: DataFrame, encoding: str) -> int:
    if encoding == "auto":
        return sniffed(spark, path) or detect_encoding(records)
    if encoding not in ENCODINGS:
        raise ValueError(f"unknown encoding {encoding!r}: one of auto, {', '.join(ENCODINGS)}")
    return ENCODINGS[encoding]


def subsampled(records: DataFrame) -> DataFrame:
    """One record in ten, the first 25 000 of those: no random choice."""
    return records.where((F.col("rec_no") % SUBSAMPLE_EVERY == 0) & (F.col("rec_no") < SUBSAMPLE_EVERY * SUBSAMPLE_READS))


def paired(spark: SparkSession, first: str, second: str, singles: str = "", encoding: str = "auto", sample: str | None = None, file_id: int = 0) -> DataFrame:
    """Two mate files and perhaps singletons. Mates must share their encoding; a file of singletons with another one must be empty."""
    check_inputs([first, second, singles])
    a, b = raw_records(spark, first), raw_records(spark, second)
    offset = _offset(spark, first, a, encoding)
    if _offset(spark, second, b, encoding) != offset:
        raise DataError(f"mates have different encodings: {first}, {second}")
    name = sample or first
    # mates are read together, up to the shorter file
    n = min(x.agg(F.coalesce(F.max("rec_no"), F.lit(-1))).first()[0] for x in (a, b))
    reads = decode(a, offset, name, file_id, 1).unionByName(decode(b, offset, name, file_id, 2)).where(F.col("rec_no") <= n)
    if singles:
        c = raw_records(spark, singles)
        if _offset(spark, singles, c, encoding) == offset:
            reads = reads.unionByName(decode(c, offset, name, file_id + 1, 0))
        elif not c.isEmpty():
            raise DataError(f"singletons have another encoding: {singles}")
    return reads


def compatible(a: Column, b: Column) -> Column:
    """Headers of mates: equal, or of one length and equal up to a final /1 and /2."""
    stem = lambda h: F.substring(h, F.lit(1), F.length(h) - 2)
    mates = (F.length(a) == F.length(b)) & F.endswith(a, F.lit("/1")) & F.endswith(b, F.lit("/2")) & (stem(a) == stem(b))
    return F.coalesce((a == b) | mates, F.lit(False))


def uninterleave(reads: DataFrame) -> DataFrame:
    """Neighbouring compatible records become pairs, the others singletons.

    A pair takes the first two of a run of compatible neighbours, then the next two: within a run of edges, pairing is by
    parity, so no sequential state is needed.
    """
    key = ["sample", "file_id"]
    edges = neighbour(reads, key, "rec_no", F.col("header"), "_next", ahead=True)
    edges = edges.withColumn("_edge", compatible(F.col("header"), F.col("_next")))
    edges = neighbour(edges, key, "rec_no", F.col("_edge"), "_linked")
    edges = running(edges, key, "rec_no", F.lit(1), "_at")  # places without gaps
    starts = F.when(F.col("_edge") & ~F.coalesce("_linked", F.lit(False)), F.col("_at"))
    runs = running(edges, key, "rec_no", starts, "_first", "max")
    runs = runs.withColumn("_opens", F.col("_edge") & F.coalesce((F.col("_at") - F.col("_first")) % 2 == 0, F.lit(False)))
    marked = neighbour(runs, key, "rec_no", F.col("_opens"), "_closes").withColumn("_closes", F.coalesce("_closes", F.lit(False)))
    marked = running(marked, key, "rec_no", F.col("_opens").cast("long"), "_pair")
    marked = running(marked, key, "rec_no", (~F.col("_opens") & ~F.col("_closes")).cast("long"), "_single")
    mate = F.when(F.col("_opens"), 1).when(F.col("_closes"), 2).otherwise(0)
    return marked.select(*key, mate.cast("tinyint").alias("mate"), (F.when(mate == 0, F.col("_single")).otherwise(F.col("_pair")) - 1).alias("rec_no"), "header", "seq", "qual")


# --- directories and manifests -------------------------------------------------------------------------------------

_MATES = ((".1", ".2"), ("_1", "_2"), ("_F", "_R"))


def match_files(names: Sequence[str]) -> tuple[list[tuple[str, str, str]], list[str]]:
    """(first, second, singletons or '') and the files left over, from the sorted names of a directory."""
    names = sorted(n for n in names if n.endswith(EXTENSIONS))
    left, pairs = dict.fromkeys(names), []
    for name in names:
        if name not in left:
            continue
        ext = next(e for e in sorted(EXTENSIONS, key=len, reverse=True) if name.endswith(e))
        stem = name.removesuffix(ext)
        for one, two in _MATES:
            if stem.endswith(one):
                mate = stem.removesuffix(one) + two + ext
                if mate not in left:
                    raise DataError(f"{name} has no mate {mate}")
                singles = name.replace("pair.1", "single")
                singles = singles if "pair.1" in name and singles in left else ""
                pairs.append((name, mate, singles))
                for x in (name, mate, singles):
                    left.pop(x, None)
                break
            if stem.endswith(two) and stem.removesuffix(two) + one + ext not in names:
                raise DataError(f"{name} has no mate {stem.removesuffix(two) + one + ext}")
    return pairs, list(left)


def load_fastq_directory(spark: SparkSession, folder: str, encoding: str = "auto", names: Sequence[str] | None = None) -> DataFrame:
    pairs, single = match_files(names if names is not None else os.listdir(folder))
    if not pairs and not single:
        raise DataError(f"no FASTQ file in {folder}")
    at = lambda n: os.path.join(folder, n)
    parts = [paired(spark, at(a), at(b), at(c) if c else "", encoding, folder, 2 * k) for k, (a, b, c) in enumerate(pairs)]
    for k, name in enumerate(single):
        records = raw_records(spark, at(name))
        parts.append(decode(records, _offset(spark, at(name), records, encoding), folder, 2 * len(pairs) + k))
    return _union(parts)


load_mocat_sample = load_fastq_directory


def load_sample_list(spark: SparkSession, path: str, only: str | None = None) -> DataFrame:
    """All samples of a YAML manifest, in the order of their names, or only one; qualities are Sanger encoded."""
    import yaml

    with open(path, encoding="utf-8") as file:
        listed = yaml.safe_load(file)
    base = listed.get("basedir") or os.path.dirname(os.path.abspath(path))
    if only is not None and only not in listed["samples"]:
        raise DataError(f"no sample {only!r} in {path}")
    parts = []
    for name in sorted(listed["samples"]) if only is None else [only]:
        for k, entry in enumerate(listed["samples"][name]):
            if "paired" in entry:
                a, b = (os.path.join(base, x) for x in entry["paired"])
                parts.append(paired(spark, a, b, encoding="sanger", sample=name, file_id=2 * k))
            else:
                parts.append(decode(raw_records(spark, os.path.join(base, entry["single"])), 33, name, 2 * k))
    return _union(parts)


def load_sample_from_yaml(spark: SparkSession, path: str, sample: str) -> DataFrame:
    return load_sample_list(spark, path, sample)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- writing -------------------------------------------------------------------------------------------------------


def encoded(reads: DataFrame, offset: int = 33) -> DataFrame:
    """The four lines of a read as one value."""
    text = F.array_join(F.transform("qual", lambda q: F.char(q + offset)), "")
    return reads.withColumn("line", F.concat_ws("\n", "header", "seq", F.lit("+"), text))


def write_reads(reads: DataFrame, path: str, interleaved: bool = False, offset: int = 33, always_three: bool = False) -> list[str]:
    """Singletons to the path itself, or pairs to .pair.1 and .pair.2 beside .singles; or all interleaved in one file."""
    rows = encoded(reads, offset)
    if interleaved:
        first, second = reads.agg(F.count(F.when(F.col("mate") == 1, 1)), F.count(F.when(F.col("mate") == 2, 1))).first()
        if first != second:
            raise DataError(f"{first} first mates and {second} second mates cannot be interleaved")
        return [write_single(rows.orderBy(F.col("mate") == 0, "sample", "file_id", "rec_no", "mate"), path)]
    has = {r["mate"] for r in reads.select("mate").distinct().collect()}
    if not has & {1, 2} and not always_three:
        return [write_single(rows.orderBy("sample", "file_id", "rec_no"), path)]
    if "{index}" in path:
        name = lambda k: path.replace("{index}", k)
    else:
        ext = next((e for e in (".fq.gz", ".fq.bz2", ".fq") if path.endswith(e)), None)
        if ext is None:
            raise ValueError(f"names of mate files cannot be made from {path}: it must end in .fq, .fq.gz or .fq.bz2")
        name = lambda k: f"{path.removesuffix(ext)}.{k}{ext}"
    out = []
    for mate, kind in ((1, "pair.1"), (2, "pair.2"), (0, "singles")):
        if mate or 0 in has or always_three:
            out.append(write_single(rows.where(F.col("mate") == mate).orderBy("sample", "file_id", "rec_no"), name(kind)))
    return out
