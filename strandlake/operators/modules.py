"""External functions: executables that take files and leave a file, described by a module's YAML, called on DataFrames.

An input is written as the file type that the function declares, compressed only as it can read; the output file is read back as the
declared kind. One call is one process on the driver's machine: for work on partitions see map_reads.
"""

from __future__ import annotations

import os
import shlex
import subprocess
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions import References
from ..sources.sam import samfile
from ..sources.tables import countfile
from ..sources.text import expand, local_path, scratch
from ..sources.write import write
from .count import choice
from .external import ToolError

ARGUMENTS = ("flag", "option", "int", "str", "readset", "counts", "mappedreadset", "sequenceset")
FILE_TYPES = ("fq1", "fq2", "fq3", "sam", "bam", "sam_or_bam", "tsv")
RETURNS = ("void", "counts", "mappedreadset", "sequenceset")


@dataclass
class FileType:
    """What a function reads: the format, and the compressions it can undo itself."""

    base: str
    can_gzip: bool = False
    can_bzip2: bool = False

    def extension(self) -> str:
        return ".gz" if self.can_gzip else ".bz2" if self.can_bzip2 else ""


@dataclass
class Argument:
    name: str
    kind: str
    required: bool = False
    default: object = None
    allowed: Sequence[str] = ()
    when_true: Sequence[str] | None = None
    expand_searchpath: bool = False
    file: FileType | None = None


@dataclass
class ExternalFunction:
    """A command, its first argument (a file-backed value), the others in the order of the command line, and what it returns."""

    name: str
    command: list[str]
    first: Argument
    others: list[Argument] = field(default_factory=list)
    returns: str = "void"
    output: str = ""  # the option that names the output file
    extension: str = ""

    def words(self, argument: Argument, value: object, search_path: Sequence[str] = ()) -> list[str]:
        """The words of the command line for one argument."""
        value = argument.default if value is None else value
        if value is None:
            if argument.required:
                raise ValueError(f"{self.name} needs the argument {argument.name}")
            return []
        if argument.kind == "flag":
            return list(argument.when_true if argument.when_true is not None else [f"--{argument.name}"]) if value else []
        if argument.kind == "option":
            choice(argument.name, str(value), argument.allowed or [str(value)])
        text = expand(str(value), list(search_path)) if argument.expand_searchpath else str(value)
        return [f"--{argument.name}={text}"]

    def files(self, spark: SparkSession, value: DataFrame | str, kind: FileType | None, head: DataFrame | None, folder: str) -> list[str]:
        """The files that stand for a value: up to three of reads, one of alignments or counts, a path as it is."""
        if isinstance(value, str):
            return [value]
        kind = kind or FileType("tsv")
        if kind.base in ("fq1", "fq2", "fq3"):
            write(value, f"{folder}/input.fq{kind.extension()}")
            found = sorted(x for x in os.listdir(folder) if x.startswith("input.") and ".fq" in x)
            wanted = {"fq1": (1,), "fq2": (2,), "fq3": (1, 2, 3)}[kind.base]
            if len(found) not in wanted:
                raise ValueError(f"{self.name} takes {kind.base}, not reads in {len(found)} files")
            return [f"{folder}/{x}" for x in found]
        name = "tsv" if kind.base == "tsv" else "bam" if kind.base == "bam" else "sam"
        path = f"{folder}/input.{name}{'' if name == 'bam' else kind.extension()}"
        write(value, path, None if name == "tsv" else name, head=head)
        return [path]

    def __call__(self, spark: SparkSession, value: DataFrame | str, head: DataFrame | None = None, search_path: Sequence[str] = (), **options: object) -> DataFrame | str | None:
        unknown = set(options) - {a.name for a in self.others}
        if unknown:
            raise ValueError(f"{self.name} has no arguments {sorted(unknown)}")
        folder = local_path(scratch(spark))
        line = [*self.command, *self.files(spark, value, self.first.file, head, folder)]
        for argument in self.others:
            given = options.get(argument.name)
            if argument.file is not None and not isinstance(given, str) and given is not None:
                within = f"{folder}/{argument.name}"
                os.makedirs(within)
                line += [f"--{argument.name}={x}" for x in self.files(spark, given, argument.file, None, within)]
            else:
                line += self.words(argument, given, search_path)
        target = f"{folder}/output.{self.extension or 'txt'}"
        if self.returns != "void":
            line.append(f"--{self.output}={target}" if self.output else target)
        done = subprocess.run(line, capture_output=True, text=True)
        if done.returncode:
            raise ToolError(f"{self.name} ended with {done.returncode}: {done.stderr[-2000:]}")
        if self.returns == "counts":
            return countfile(spark, target)
        return samfile(spark, target)[0] if self.returns == "mappedreadset" else target if self.returns == "sequenceset" else None


@dataclass
class Module:
    name: str
    version: str
    functions: dict[str, ExternalFunction]


def _argument(given: dict, first: bool = False) -> Argument:
    kind = choice("atype", given.get("atype", "readset" if first else "str"), ARGUMENTS)
    file = FileType(choice("filetype", given["filetype"], FILE_TYPES), bool(given.get("can_gzip")), bool(given.get("can_bzip2"))) if "filetype" in given else None
    when = given.get("when-true")
    when = shlex.split(when) if isinstance(when, str) else when
    return Argument(given.get("name", ""), kind, bool(given.get("required")), given.get("def"), given.get("values", ()), when, bool(given.get("expand_searchpath")), file)


def load_module(path: str, references: References | None = None) -> Module:
    """Functions of a module's YAML by their names; its references are added to those given."""
    import yaml

    with open(path, encoding="utf-8") as file:
        given = yaml.safe_load(file)
    folder, functions = os.path.dirname(os.path.abspath(path)), {}
    for f in given.get("functions", ()):
        command = shlex.split(f["arg0"])
        if command[0].startswith("."):
            command[0] = os.path.join(folder, command[0])
        back = f.get("return", {})
        functions[f["nglName"]] = ExternalFunction(f["nglName"], command, _argument(f["arg1"], True), [_argument(a) for a in f.get("additional", ())], choice("rtype", back.get("rtype", "void"), RETURNS), back.get("name", ""), back.get("extension", ""))
    for r in given.get("references", ()):
        names = {"fafile": r.get("fasta-file"), "gff_file": r.get("gtf-file"), "functional_map": r.get("map-file")}
        if references is not None:
            references.add(r["name"], **{k: v if os.path.isabs(v) else os.path.join(folder, v) for k, v in names.items() if v})
    return Module(given["name"], str(given.get("version", "")), functions)
