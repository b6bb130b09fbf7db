"""Numbered lines of text files; writing to one file or to ordered parts; scratch folders."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import os
import shutil
import sys
import tempfile
import uuid
import zlib
from collections.abc import Iterator, Sequence
from urllib.parse import quote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Workers need not have this package: what they run of this module is sent to them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line_no, value): lines numbered from 0 in each file, trailing carriage returns removed.

    Splits of a file count their lines first, when this is called; running totals over the few splits then number all lines where they
    are read: lines are neither sorted nor shuffled. Compression is told by extension. The members of a gz file are split between tasks where all can reach
    it by path; xz and zst, which Hadoop may not be able to read, are decoded in Python, whole files a task.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    xz = [p for p in paths if p.endswith((".xz", ".zst", ".zstd"))]
    chunks = _gz_chunks(spark, [p for p in paths if p.endswith(".gz") and is_local(p) and os.path.isfile(local_path(p))])
    plain = [p for p in paths if p not in xz and p not in chunks]
    frames = []
    if plain:
        lines = spark.read.text(plain).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")
        starts, total = [], {}
        for r in lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("least")).orderBy("file", "block").collect():  # one row a split
            starts.append((r["file"], r["block"], r["n"], r["least"], total.get(r["file"], 0)))
            total[r["file"]] = total.get(r["file"], 0) + r["n"]
        known = spark.createDataFrame(starts, "f string, b long, n long, least long, start long").coalesce(1)
        numbered = lines.join(F.broadcast(known), (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")), "left")
        at = F.col("place") - F.col("least")
        same = failing(F.coalesce((at >= 0) & (at < F.col("n")), F.lit(False)), F.concat(F.lit("splits changed between two readings of "), F.col("file")))
        frames.append(numbered.select("file", F.coalesce(same.cast("long"), F.col("start") + at).alias("line_no"), "value"))
    if chunks:
        each = [(f"file:{quote(os.path.abspath(local_path(p)), safe=_SAFE)}", local_path(p), *x) for p, found in chunks.items() for x in found]

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    yield from _chunk_lines(*each[k])

        frames.append(spark.range(0, len(each), 1, len(each)).mapInArrow(read, "file string, line_no long, value string"))
    if xz:
        whole = spark.read.format("binaryFile").load(xz).select(F.col("path").alias("file"), "content")

        def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    start, lines = 0, []
                    for line in io.TextIOWrapper(_decoded(name, data), encoding="utf-8", newline="\n"):
                        lines.append(line.rstrip("\n"))
                        if len(lines) == 100_000:
                            yield _numbered(name, start, lines)
                            start, lines = start + len(lines), []
                    yield _numbered(name, start, lines)

        frames.append(whole.mapInArrow(decode, "file string, line_no long, value string"))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out.withColumn("value", F.regexp_replace("value", r"\r$", ""))


#: Characters that stand as they are in the paths that Spark tells of its files.
_SAFE = "/!$&'()*+,;=:@~-._"


def _gz_ranges(size: int) -> list[tuple[int, int]]:
    """Ranges of compressed bytes, a task each: of 1 to 16 MB, some 256 of them in between."""
    step = min(max(size // 256, 1 << 20), 16 << 20)
    return [(lo, min(lo + step, size)) for lo in range(0, size, step)]


def _gz_chunks(spark: SparkSession, paths: list[str]) -> dict[str, list[tuple[int, int, int, bool]]]:
    """Path -> (first byte, end, number of the first line, whether a line starts there) of neighbouring runs of whole members.

    A gz file is a row of members, each with its checksum. Tasks look for members that begin in their range and decode them to count
    lines; the runs that they tell must follow each other without a gap from the first byte to the last. Files where they do not, and
    files with carriage returns that end lines on their own, are left out: one task reads each of these.
    """
    ranges = [(p, local_path(p), lo, hi) for p in dict.fromkeys(paths) for lo, hi in _gz_ranges(os.path.getsize(local_path(p)))]
    if not ranges:
        return {}

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                found = _surveyed(*ranges[k][1:])
                if found is not None:
                    yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(("k", "first", "end", "n", "ends", "good"), (k, *found), strict=True)})

    rows = spark.range(0, len(ranges), 1, len(ranges)).mapInArrow(survey, "k long, first long, end long, n long, ends boolean, good boolean").collect()
    out: dict[str, list[tuple[int, int, int, bool]]] = {}
    bad, at = set(), {}
    for r in sorted(rows, key=lambda r: r["k"]):
        path = ranges[r["k"]][0]
        end, line, starts = at.get(path, (0, 0, True))
        if r["first"] != end or not r["good"]:
            bad.add(path)
        out.setdefault(path, []).append((r["first"], r["end"], line, starts))
        at[path] = (r["end"], line + r["n"], r["ends"] if r["n"] or not r["ends"] else starts)
    return {p: x for p, x in out.items() if p not in bad and x[-1][1] == os.path.getsize(local_path(p))}


def _inflated(file, at: int) -> Iterator[bytes]:
    """The member that begins at a byte, in pieces of 4 MB at most; returns where it ends. zlib.error if no whole one begins there."""
    file.seek(at)
    one, read = zlib.decompressobj(31), at
    while not one.eof:
        data = file.read(1 << 18)
        read += len(data)
        if not data and not (piece := one.decompress(b"", 1 << 22)):
            if one.eof:
                break
            raise zlib.error("a member is cut short")
        if not data:
            yield piece
        while data and not one.eof:
            if piece := one.decompress(data, 1 << 22):
                yield piece
            data = one.unconsumed_tail
    return read - len(one.unused_data)


def _surveyed(path: str, lo: int, hi: int) -> tuple[int, int, int, bool, bool] | None:
    """(first byte, end, line ends, whether the last byte is one, whether all of it can be split) of the members that begin in a range."""
    with open(path, "rb") as file:

        def candidates() -> Iterator[int]:
            file.seek(lo)
            data, k = file.read(hi - lo + 2), -1
            while (k := data.find(b"\x1f\x8b\x08", k + 1)) >= 0:
                yield lo + k

        def one(at: int, last: bytes) -> tuple[int, int, int, bytes]:
            pieces, lines, bare = _inflated(file, at), 0, 0
            while True:
                try:
                    piece = next(pieces)
                except StopIteration as stop:
                    return stop.value, lines, bare, last
                lines += piece.count(b"\n")
                bare += piece.count(b"\r") - piece.count(b"\r\n") - (last == b"\r" and piece[:1] == b"\n")
                last = piece[-1:]

        first = None
        for at in candidates():
            try:
                end, lines, bare, last = one(at, b"")
            except zlib.error:
                continue
            first = at
            break
        if first is None:
            return None
        size = os.path.getsize(path)
        try:
            while end < min(hi, size):
                end, more, single, last = one(end, last)
                lines, bare = lines + more, bare + single
        except zlib.error:
            return first, end, lines, last == b"\n", False
        return first, end, lines, last in (b"\n", b""), bare == 0


def _chunk_lines(name: str, path: str, first: int, end: int, line: int, starts: bool) -> Iterator[pa.RecordBatch]:
    """The lines that start in a run of members, the last one to its end, wherever that is."""
    size = os.path.getsize(path)
    with open(path, "rb") as file:
        at, rest, skip = first, b"", not starts
        while at < size and (at < end or rest):
            beyond = at >= end
            pieces = _inflated(file, at)
            while True:
                try:
                    piece = next(pieces)
                except StopIteration as stop:
                    at = stop.value
                    break
                if skip:
                    cut = piece.find(b"\n") + 1
                    if not cut:
                        continue
                    piece, skip, line = piece[cut:], False, line + 1
                if beyond:
                    cut = piece.find(b"\n") + 1
                    rest += piece[:cut] if cut else piece
                    if cut:
                        yield _split(name, line, rest)
                        return
                    continue
                cut = piece.rfind(b"\n") + 1
                if cut:
                    batch = _split(name, line, rest + piece[:cut])
                    yield batch
                    line, rest = line + batch.num_rows, piece[cut:]
                else:
                    rest += piece
        if rest:
            yield _split(name, line, rest + b"\n")


def _split(name: str, line: int, text: bytes) -> pa.RecordBatch:
    """Whole lines as a batch, without a Python object a line; the mark of UTF-8 before the first one goes, as in Hadoop's reader."""
    text = text.removeprefix(b"\xef\xbb\xbf") if line == 0 else text
    data = np.frombuffer(text, np.uint8)
    ends = np.flatnonzero(data == 10)
    n = len(ends)
    offsets = np.zeros(n + 1, np.int32)
    offsets[1:] = ends - np.arange(n)
    values = pa.StringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(text.replace(b"\n", b"")))
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(name), n), pa.array(np.arange(line, line + n, dtype=np.int64)), values], names=["file", "line_no", "value"])


def _decoded(name: str, data: bytes):
    if name.endswith(".xz"):
        return lzma.open(io.BytesIO(data))
    import zstandard

    return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True))


def _numbered(name: str, start: int, lines: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name] * len(lines), pa.string()), pa.array(range(start, start + len(lines)), pa.int64()), pa.array(lines, pa.string())], names=["file", "line_no", "value"])


def readlines(path: str) -> list[str]:
    """All lines of a small file, at plan time; not decompressed."""
    with open(path, encoding="utf-8", newline="") as file:
        lines = file.read().split("\n")
    return [line.removesuffix("\r") for line in (lines[:-1] if lines and not lines[-1] else lines)]


def compressed(path: str) -> bool:
    return path.endswith((".gz", ".bz2", ".xz", ".zst", ".zstd"))


def open_output(path: str, mode: str = "wt"):
    """A file for writing or appending text ("wt") or bytes ("ab"), compressed as its extension says."""
    text = {"encoding": "utf-8", "newline": ""} if "t" in mode else {}
    if path.endswith(".gz"):
        return gzip.open(path, mode, **text)
    if path.endswith(".bz2"):
        return bz2.open(path, mode, **text)
    if path.endswith(".xz"):
        return lzma.open(path, mode, **text)
    if path.endswith((".zst", ".zstd")):
        import zstandard

        return zstandard.open(path, mode, **text)
    return open(path, mode, **text)


def open_input(path: str):
    """The bytes of a file, decompressed as its extension says."""
    if path.endswith((".zst", ".zstd")):
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True)
    return {".gz": gzip.open, ".bz2": bz2.open, ".xz": lzma.open}.get(os.path.splitext(path)[1], open)(path, "rb")


def copy_file(source: str, target: str) -> str:
    """A file as it is, or recompressed where the extensions ask for it, through a temporary sibling and a rename."""
    kind = lambda p: next((e for e in (".gz", ".bz2", ".xz", ".zst", ".zstd") if p.endswith(e)), "").replace("zstd", "zst")
    folder, name = os.path.split(os.path.abspath(target))
    temporary = f"{folder}/.{uuid.uuid4().hex}.{name}"
    same = kind(source) == kind(target)
    try:
        with open(source, "rb") if same else open_input(source) as read, open(temporary, "wb") if same else open_output(temporary, "wb") as write:
            shutil.copyfileobj(read, write, 1 << 20)
        os.replace(temporary, target)
    finally:
        if os.path.exists(temporary):
            os.unlink(temporary)
    return target


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share, under the one that the cluster names; a local one only where all tasks run in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "strandlake-checkpoints")
    path = f"{base.rstrip('/')}/strandlake-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(target)
    system.deleteOnExit(target)
    return path


def local_path(path: str) -> str:
    """A path of the local file system as Python and other programs take it."""
    if not is_local(path):
        raise ValueError(f"{path} is not in a file system that programs can read")
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def settled(df: DataFrame) -> DataFrame:
    """A frame written once, so that what depends on the order or number of its rows is not computed twice."""
    spark = df.sparkSession
    path = scratch(spark) + "/table"
    df.write.parquet(path)
    return spark.read.parquet(path)


#: Codecs of the tasks that write lines, by extension; others are compressed when parts are joined.
_CODECS = {".gz": "gzip", ".bz2": "bzip2"}


def write_parts(lines: DataFrame, folder: str, extension: str = "", column: str = "line") -> str:
    """Ordered lines to a folder, a file a partition, in the order of the files' names: nothing goes through the driver."""
    lines.select(column).write.option("compression", _CODECS.get(extension, "none")).text(folder)
    return folder


def write_single(lines: DataFrame, path: str, header: Sequence[str] = (), column: str = "line") -> str:
    """Ordered lines to one file. Tasks write (and compress) parts beside it; the driver only joins their bytes, and renames the whole.

    The path must be reachable by all executors. Standard output is written by the driver.
    """
    if path in ("/dev/stdout", "-"):
        for text in [*header, *(r[column] for r in lines.select(column).toLocalIterator())]:
            print(text)
        return path
    if not is_local(path):
        return _write_remote(lines, path, header, column)
    path = local_path(path)
    folder, name = os.path.split(os.path.abspath(path))
    extension = os.path.splitext(name)[1]
    parts, temporary = f"{folder}/.{uuid.uuid4().hex}.parts", f"{folder}/.{uuid.uuid4().hex}{extension}"
    write_parts(lines, f"file://{parts}", extension, column)
    try:
        with open_output(temporary) as file:
            file.writelines(f"{text}\n" for text in header)
        # members of gz and bz2 files can be joined as they are; other compressions are one stream
        with open(temporary, "ab") if extension in _CODECS or not compressed(name) else open_output(temporary, "ab") as file:
            for part in sorted(x for x in os.listdir(parts) if x.startswith("part-")):
                with open(os.path.join(parts, part), "rb") as one:
                    shutil.copyfileobj(one, file, 1 << 20)
        os.replace(temporary, path)
    finally:
        shutil.rmtree(parts, ignore_errors=True)
        if os.path.exists(temporary):
            os.unlink(temporary)
    return path


def _write_remote(lines: DataFrame, path: str, header: Sequence[str], column: str) -> str:
    """The same through Spark's file systems; compressed by gz or bz2 only."""
    extension = os.path.splitext(path)[1]
    if compressed(path) and extension not in _CODECS:
        raise ValueError(f"{path}: only .gz and .bz2 are compressed on a remote store")
    spark, hadoop = lines.sparkSession, lines.sparkSession._jvm.org.apache.hadoop
    conf, at = spark._jsc.hadoopConfiguration(), hadoop.fs.Path
    parts, temporary = f"{path}.{uuid.uuid4().hex}.parts", f"{path}.{uuid.uuid4().hex}.tmp"
    write_parts(lines, parts, extension, column)
    system = at(path).getFileSystem(conf)
    pack = {".gz": gzip.compress, ".bz2": bz2.compress}.get(extension, bytes)
    out = system.create(at(temporary), True)
    out.write(bytearray(pack("".join(f"{text}\n" for text in header).encode())))
    for part in sorted(f.getPath().getName() for f in system.listStatus(at(parts))):
        if part.startswith("part-"):
            one = system.open(at(f"{parts}/{part}"))
            hadoop.io.IOUtils.copyBytes(one, out, 1 << 20, False)
            one.close()
    out.close()
    system.delete(at(path), False)
    system.rename(at(temporary), at(path))
    system.delete(at(parts), True)
    return path


def expand(path: str, search: dict[str, str] | list[str]) -> str:
    """Fill the first `<name>` of a path from the search roots: named roots for that name, others for any."""
    if "<" not in path or ">" not in path:
        return path
    name = path[path.index("<") + 1 : path.index(">")]
    roots = search.items() if isinstance(search, dict) else [(r.partition("=")[0], r.partition("=")[2]) if "=" in r else ("", r) for r in search]
    for only, root in roots:
        if only in ("", name):
            found = path.replace(f"<{name}>", root, 1)
            if os.path.exists(found):
                return found
    return path


def is_local(path: str) -> bool:
    return urlsplit(path).scheme in ("", "file")


def failing(condition: Column, message: str | Column) -> Column:
    """Null, or a failed job with this message where the condition does not hold."""
    return F.when(~condition, F.raise_error(message))
