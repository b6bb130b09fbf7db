"""Scalars of scripts: numbers as text, text as numbers, paths, lists, constants, packaged references."""

from __future__ import annotations

import json
import math
import os
import posixpath
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.fastq import DataError

#: Constants of scripts.
STDIN, STDOUT = "/dev/stdin", "/dev/stdout"


def arguments() -> list[str]:
    """The arguments of the running script, its own name first."""
    return list(sys.argv)


def item(values: Sequence, index: int):
    """An element by its place from 0; places outside the list, and negative ones, are errors."""
    if not 0 <= index < len(values):
        raise DataError(f"index {index} outside a list of {len(values)}")
    return values[index]


def check(condition: bool, message: str = "assertion failed") -> None:
    if not condition:
        raise AssertionError(message)


def show(x: int | float | str, end: str = "") -> None:
    """print; with a line's end println. Numbers as to_string has them."""
    sys.stdout.write((x if isinstance(x, str) else to_string(x)) + end)


def example(reads: DataFrame, **options) -> DataFrame:
    """Shows its arguments and returns its input: a pattern for added functions."""
    show(", ".join(f"{k}={v}" for k, v in sorted(options.items())), "\n")
    return reads


def export_plan(df: DataFrame, path: str) -> str:
    """The optimised plan of a result as JSON."""
    with open(path, "w", encoding="utf-8") as file:
        json.dump(json.loads(df._jdf.queryExecution().optimizedPlan().toJSON()), file, indent=1)
    return path


def double_text(x: float) -> str:
    """Fixed notation from 0.1 up to ten million, scientific elsewhere; always with a point."""
    if math.isnan(x) or math.isinf(x):
        return "NaN" if math.isnan(x) else ("Infinity" if x > 0 else "-Infinity")
    if x == 0:
        return "-0.0" if math.copysign(1, x) < 0 else "0.0"
    if 0.1 <= abs(x) < 1e7:
        text = repr(float(x))
        if "e" not in text:
            return text
    mantissa, _, exponent = f"{float(x)!r}".partition("e")
    digits = mantissa.replace("-", "").replace(".", "").lstrip("0").rstrip("0") or "0"
    power = math.floor(math.log10(abs(x))) if not exponent else int(exponent) + (len(mantissa.replace("-", "").split(".")[0]) - 1)
    if abs(x) >= 10.0 ** (power + 1):
        power += 1
    return f"{'-' if x < 0 else ''}{digits[0]}.{digits[1:] or '0'}e{power}"


def to_string(x: int | float) -> str:
    return str(x) if isinstance(x, int) else double_text(x)


def _read(text: str, default, kind: Callable, name: str):
    text = text.strip()
    if not text:
        if default is None:
            raise DataError(f"empty text is not {name}")
        return default
    try:
        return kind(text)
    except ValueError as error:
        raise DataError(f"{text!r} is not {name}") from error


def read_int(text: str, on_empty_return: int | None = None) -> int:
    return _read(text, on_empty_return, int, "an integer")


def read_double(text: str, on_empty_return: float | None = None) -> float:
    return _read(text, on_empty_return, float, "a number")


def read_int_column(text: str | Column, on_empty_return: int | None = None) -> Column:
    """The same on a column: a bad text fails the job."""
    trimmed = F.trim(text)
    value = trimmed.try_cast("long")
    empty = F.raise_error("empty text is not an integer") if on_empty_return is None else F.lit(on_empty_return).cast("long")
    return F.when(trimmed == "", empty).when(value.isNull(), F.raise_error(F.concat(trimmed, F.lit(" is not an integer")))).otherwise(value)


def join_path(left: str, right: str) -> str:
    """An absolute right side wins."""
    return posixpath.join(left, right)


def job_index() -> tuple[bool, int]:
    """(valid, index) of an array job, 0 without one."""
    for name in ("LSB_JOBINDEX", "SGE_TASK_ID"):
        value = os.environ.get(name, "")
        if value.isdigit() and int(value) > 0:
            return True, int(value)
    return False, 0


#: Names of packaged references and the longer names they also go by: fixed values.
PACKAGED = {
    "bosTau4": "Bos_taurus_UMD3.1",
    "ce10": "Caenorhabditis_elegans_WBcel235",
    "canFam3": "Canis_familiaris_CanFam3.1",
    "dm5": "Drosophila_melanogaster_BDGP5",
    "dm6": "Drosophila_melanogaster_BDGP6",
    "gg4": "Gallus_gallus_Galgal4",
    "gg5": "Gallus_gallus_5.0",
    "hg19": "Homo_sapiens_GRCh37.p13",
    "hg38.p7": "Homo_sapiens_GRCh38.p7",
    "hg38.p10": "Homo_sapiens_GRCh38.p10",
    "mm10.p2": "Mus_musculus_GRCm38.p2",
    "mm10.p5": "Mus_musculus_GRCm38.p5",
    "rn5": "Rattus_norvegicus_Rnor_5.0",
    "rn6": "Rattus_norvegicus_Rnor_6.0",
    "sacCer3": "Saccharomyces_cerevisiae_R64-1-1",
    "susScr11": "Sus_scrofa.Sscrofa11.1",
}
#: Files of an installed reference by what they are.
REFERENCE_FILES = {"fafile": ("Sequence/BWAIndex/reference.fa.gz", "reference.fa.gz", "reference.fa"), "gff_file": ("Annotation/annotation.gtf.gz", "annotation.gtf.gz", "annotation.gff"), "functional_map": ("Annotation/functional.map.gz", "functional.map")}


class References:
    """Packaged references by name: those added by modules first, then installed folders, the user's before the global one.

    A name or its longer one finds the folder of either. Nothing is downloaded.
    """

    def __init__(self, folders: tuple[str, ...] = (), aliases: dict[str, str] | None = None) -> None:
        self.folders, self.added = folders, {}
        self.aliases = {long: short for short, long in PACKAGED.items()} | (aliases or {})

    def add(self, name: str, **files: str) -> None:
        self.added[name] = files

    def find(self, name: str) -> dict[str, str]:
        names = dict.fromkeys([name, self.aliases.get(name, name)])
        for one in names:
            if one in self.added:
                return self.added[one]
        for folder in self.folders:
            for base in (os.path.join(folder, one) for one in names):
                if os.path.isdir(base):
                    known = {kind: next((p for f in files if os.path.exists(p := os.path.join(base, f))), "") for kind, files in REFERENCE_FILES.items()}
                    return {f.rpartition(".")[0] or f: os.path.join(base, f) for f in sorted(os.listdir(base))} | {k: p for k, p in known.items() if p}
        raise DataError(f"reference {name!r} is not installed")


class Functions:
    """Functions that modules add: callables from DataFrames to DataFrames, by name."""

    def __init__(self) -> None:
        self.known: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
        def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self.known[name] = f
            return f

        return add

    def call(self, name: str, *args, **options) -> DataFrame:
        if name not in self.known:
            import difflib

            near = difflib.get_close_matches(name, self.known, 1)
            raise ValueError(f"no function {name!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
        return self.known[name](*args, **options)
