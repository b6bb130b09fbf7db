"""External programs: aligners on partitions of reads, assemblers and gene finders on files.

An aligner is a process a task: reads go in as interleaved FASTQ, mates together, and alignment lines come out, both as streams. The
reference must be indexed and reachable under one path on every executor.
"""

from __future__ import annotations

import itertools
import os
import shutil
import subprocess
import tempfile
import threading
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import References
from ..sources.fastq import encoded
from ..sources.sam import parse_lines
from ..sources.tables import split_fasta
from ..sources.text import expand, settled
from .count import choice
from .mapped import mapstats, merge_best

MAPPERS = ("bwa", "minimap2")
#: Files beside a reference that make up its index.
INDEX_FILES = {"bwa": (".amb", ".ann", ".bwt", ".pac", ".sa"), "minimap2": (".mm2.idx",)}
STALE_SECONDS, RETRY_SECONDS = 36 * 3600, 60


class ToolError(RuntimeError):
    """A program is missing or failed."""


def mapper_command(mapper: str, reference: str, mode_all: bool = False, threads: int = 1, extra: Sequence[str] = ()) -> list[str]:
    if choice("mapper", mapper, MAPPERS) == "bwa":
        return ["bwa", "mem", "-t", str(threads), "-K", "100000000", *(["-a"] if mode_all else []), *extra, "-p", reference, "-"]
    return ["minimap2", "-t", str(threads), "-a", *extra, reference, "-"]


# --- indexes -------------------------------------------------------------------------------------------------------


def index_place(fasta: str, index_path: str = "") -> str:
    """Where the index of a reference stands: beside it, or under the index path, where a link to it is made."""
    whole = os.path.abspath(fasta)
    if not index_path or whole.startswith(os.path.abspath(index_path) + os.sep):
        return fasta
    target = os.path.join(index_path, whole.lstrip("/"))
    os.makedirs(os.path.dirname(target), exist_ok=True)
    if not os.path.lexists(target):
        os.symlink(whole, target)
    return target


def has_index(fasta: str, mapper: str) -> bool:
    return all(os.path.exists(fasta + ext) for ext in INDEX_FILES[choice("mapper", mapper, MAPPERS)])


def ensure_index(fasta: str, mapper: str = "bwa", index_path: str = "", command: Sequence[str] | None = None) -> str:
    """The path to map against. An index is built once, under a lock file; one beside the reference is used in place."""
    if has_index(fasta, mapper):
        return fasta
    place = index_place(fasta, index_path)
    lock = f"{place}.index.lock"
    while not has_index(place, mapper):
        try:
            os.close(os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError:
            try:
                if time.time() - os.path.getmtime(lock) > STALE_SECONDS:
                    os.unlink(lock)
                else:
                    time.sleep(RETRY_SECONDS)
            except FileNotFoundError:  # given back meanwhile
                pass
            continue
        try:
            if not has_index(place, mapper):
                run_tool(*(command or (["bwa", "index"] if mapper == "bwa" else ["minimap2", "-d", place + INDEX_FILES["minimap2"][0]])), place)
        finally:
            os.unlink(lock)
        if not has_index(place, mapper):
            raise ToolError(f"no index of {place} was made")
    return place


# --- mapping -------------------------------------------------------------------------------------------------------


def _lines_of(command: Sequence[str], lines: Iterator[str]) -> Iterator[str]:
    """Lines that a process writes while lines are written to it; its errors are told with its end."""
    with tempfile.TemporaryFile() as errors:
        process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=errors, text=True)
        failed: list[BaseException] = []

        def write() -> None:
            try:
                for line in lines:
                    process.stdin.write(line + "\n")
                process.stdin.close()
            except BrokenPipeError:
                pass  # the process has ended: its code says how
            except BaseException as error:
                failed.append(error)
                process.kill()

        writer = threading.Thread(target=write, daemon=True)
        writer.start()
        try:
            yield from (line.rstrip("\n") for line in process.stdout)
            writer.join()
            code = process.wait()
        finally:
            if process.poll() is None:
                process.kill()
                process.wait()
        if failed:
            raise failed[0]
        if code:
            errors.seek(0)
            raise ToolError(f"{command[0]} ended with {code}: {errors.read()[-2000:].decode(errors='replace')}")


def map_reads(reads: DataFrame, reference: str, mapper: str = "bwa", mode_all: bool = False, threads: int = 1, extra: Sequence[str] = (), command: Sequence[str] | None = None) -> DataFrame:
    """Alignments of the reads: sample, line_no, group_id and the fields. A group is what a task's aligner says of one read name.

    Lines are numbered in the order in which they come, those of minimap2 in bytewise order.
    """
    command = list(command) if command else mapper_command(mapper, reference, mode_all, threads, extra)
    key = ["sample", "file_id", "rec_no"]
    single = F.when(F.col("mate") == 0, 1).otherwise(0)
    rows = encoded(reads).select(*key, "mate", single.alias("single"), "line").repartition(*key).sortWithinPartitions("sample", "single", "file_id", "rec_no", "mate")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not shutil.which(command[0]):
            raise ToolError(f"{command[0]} is not installed")
        pairs = (pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for sample, own in itertools.groupby(pairs, key=lambda pair: pair[0]):
            found = (line for line in _lines_of(command, (line for _, line in own)) if not line.startswith("@"))
            while out := list(itertools.islice(found, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array([sample] * len(out), pa.string()), pa.array(out, pa.string())], names=["sample", "value"])

    lines = rows.select("sample", "line").mapInArrow(run, "sample string, value string")
    if mapper == "minimap2":
        lines = lines.repartitionByRange("sample", "value").sortWithinPartitions("sample", "value")
    return parse_lines(lines.withColumn("line_no", F.monotonically_increasing_id()), ["sample"]).withColumn("group_id", F.xxhash64("sample", "qname"))


@dataclass
class Mapping:
    """Alignments, what they were mapped to, and their statistics (input, reference, statistics)."""

    rows: DataFrame
    reference: str
    stats: list[tuple[str, str, int, DataFrame]] = field(default_factory=list)


def map_read_set(
    spark: SparkSession, reads: DataFrame, reference: str | None = None, fafile: str | None = None, mapper: str = "bwa", mode_all: bool = False, block_size_megabases: int = 0, threads: int = 1,
    extra: Sequence[str] = (), references: References | None = None, search_path: Sequence[str] = (), index_path: str = "", command: Sequence[str] | None = None, index_command: Sequence[str] | None = None,
    name: str = "",
) -> Mapping:
    """Map reads to a packaged reference or a FASTA file, one of both; the index is built if it is missing.

    With a block size the reference is split into files of so many megabases, reads are mapped to each, and the best alignments of all
    are kept. `command` and `index_command` stand in for the mapper's own; the path mapped to, or indexed, is added to them.
    """
    if (reference is None) == (fafile is None):
        raise ValueError("map takes either a reference or a fafile")
    path = expand(fafile, list(search_path)) if fafile else (references or References()).find(reference)["fafile"]
    label = reference or path
    if block_size_megabases > 0:
        place = index_place(path, index_path)
        base = os.path.join(os.path.dirname(place), f"{os.path.splitext(os.path.basename(path))[0]}.splits_{block_size_megabases}m")
        files = split_fasta(spark, path, base, block_size_megabases * 1_000_000)
    else:
        files = [path]
    parts = []
    for one in files:
        place = ensure_index(one, mapper, index_path, index_command)
        parts.append(settled(map_reads(reads, place, mapper, mode_all, threads, extra, [*command, place] if command else None)))
    rows = parts[0]
    if len(parts) > 1:
        rows = settled(merge_best([p.withColumn("group_no", F.col("group_id")) for p in parts]).drop("part", "group_no"))
    return Mapping(rows, label, [(name or label, label, 0, mapstats(rows.drop("sample")))])


def run_tool(*command: str) -> None:
    if not shutil.which(command[0]):
        raise ToolError(f"{command[0]} is not installed")
    subprocess.run(command, check=True)


def assemble_command(first: str, second: str = "", singles: str = "", out: str = "assembled") -> list[str]:
    return ["megahit", *(["-1", first, "-2", second] if second else []), *(["-r", singles or first] if singles or not second else []), "-o", out]


def orf_command(fasta: str, out: str, is_metagenome: bool, include_fragments: bool = True, coords_out: str = "", prots_out: str = "") -> list[str]:
    return ["prodigal", "-i", fasta, "-d", out, *(["-p", "meta"] if is_metagenome else []), *([] if include_fragments else ["-c"]), *(["-o", coords_out] if coords_out else []), *(["-a", prots_out] if prots_out else [])]
