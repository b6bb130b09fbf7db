"""What the corpus operators share: table access, shared scratch space, bounded slices of batches, word splitting and hashing."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: What a Python worker works on at once: bytes of text, and rows. A longer text stands alone.
SLICE_BYTES, SLICE_ROWS = 1 << 18, 1000
#: Bytes of an Arrow batch between the JVM and Python, where the session does not say.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: str | Column) -> Column:
    """Number of words of a text, 0 for null; stays in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it. A local one is made only where none is set and all tasks run in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    local = os.path.join(tempfile.gettempdir(), "strandlake-checkpoints")
    os.makedirs(local, exist_ok=True)
    return local


def settle(df: DataFrame) -> DataFrame:
    """Materialise a narrow intermediate once, in the shared folder, and cut its lineage.

    A lost executor costs nothing already settled. Spark's context cleaner drops the files when the frame is no longer used.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write a wide intermediate as Parquet to the shared folder and read it back; it is deleted when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandlake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.parquet(path)


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors wherever the driver found it, and bound the bytes of Arrow batches."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    sc = spark.sparkContext
    if getattr(sc, "_strandlake_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="strandlake-")), "strandlake_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    sc.addPyFile(target)
    sc._strandlake_shipped = True


# --- bounded memory in Python workers ------------------------------------------------------------------------------


def give_back() -> None:
    """Return freed memory to the system: workers are reused, and would keep the most that any task has needed."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches that leaves no memory behind in its worker."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        yield from run(batches)
        give_back()

    return wrapped


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | object) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(lean(run), schema)


def chunked(sizes: list[int], most: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `rows` rows and about `most` bytes each; a single larger row stands alone."""
    start, total = 0, 0
    for k, n in enumerate(sizes):
        if k > start and (total + n > most or k - start >= rows):
            yield start, k
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def slices(column: pa.Array, most: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[tuple[int, int]]:
    """The same ranges for a column of texts or bytes; nothing becomes a Python object for it."""
    yield from chunked(pc.fill_null(pc.binary_length(column), 0).to_pylist(), most, rows)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a column as UTF-8, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


# --- hashing of words and word windows, vectorised over a whole batch of texts -------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


class Roller:
    """Polynomial hashes mod 2**64 of substrings, read off prefix sums: no loop over bytes or words.

    Prefix sums carry base**position; multiplying by base**-start makes equal sequences equal wherever they stand. Sums are made a
    block at a time and kept at the places asked for only, so memory does not grow with the bytes of a text.
    """

    STEP = 1 << 16

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.letters = rng.integers(0, 2**64, 256, np.uint64, endpoint=False)
        base = int(rng.integers(0, 2**63)) * 8 + 5 & (2**64 - 1)
        inverse = pow(base, -1, 2**64)
        self.up, self.down = _powers(base, self.STEP), _powers(inverse, self.STEP)
        self.far, self.back = pow(base, self.STEP, 2**64), pow(inverse, self.STEP, 2**64)

    def _sums(self, block: Callable[[int, int], np.ndarray], n: int, places: np.ndarray) -> np.ndarray:
        """The sum of values before each of the places, which ascend; `block` gives the values of a range."""
        out = np.empty(len(places), np.uint64)
        edges = np.searchsorted(places, np.arange(0, n + 2 * self.STEP, self.STEP))
        before, power = 0, 1
        local = np.zeros(self.STEP + 1, np.uint64)
        for k, a in enumerate(range(0, n + 1, self.STEP)):
            b = min(a + self.STEP, n)
            np.cumsum(block(a, b) * self.up[: b - a], out=local[1 : b - a + 1])
            lo, hi = edges[k], edges[k + 1]
            out[lo:hi] = local[places[lo:hi] - a] * np.uint64(power) + np.uint64(before)
            before = (before + power * int(local[b - a])) & (2**64 - 1)
            power = power * self.far & (2**64 - 1)
        return out

    def _hash(self, block: Callable[[int, int], np.ndarray], n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = self._sums(block, n, ends) - self._sums(block, n, starts)
        shift = self.down[starts % self.STEP] * _powers(self.back, n // self.STEP + 1)[starts // self.STEP]
        return mix64(sums * shift ^ (ends - starts).astype(np.uint64))

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of values[start:end]; starts and ends ascend."""
        return self._hash(lambda a, b: values[a:b], len(values), starts, ends)

    def words(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self._hash(lambda a, b: self.letters[raw[a:b]], len(raw), starts, ends)


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word of a UTF-8 buffer."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_SPACE[raw]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
