"""Removing repeated passages: a count-min sketch of window keys first, exact grouping of what it lets through second.

A window's key is the least hash of the runs of words inside it. Equal windows have equal keys, and windows that start near each
other mostly share theirs, so that a document has about one key for a dozen words. Every task sketches the keys of its documents; the
sketches of a shard are merged by saturating addition, so that a cell says whether it was met twice. A count-min estimate is never
below the count, so a window of two documents has all its key's cells met twice and none is lost. The second pass sends only windows
with a key estimated repeated, as 96-bit hashes, to exact grouping: the smallest document of each window, joined back to the
documents that hold it.

At scale: sketches travel as sorted cells with gaps of about a byte, not as rows; the merged sketch is broadcast and has a fixed
bound (`MOST_BITS`, 96 MB). It is sized to the corpus up to that bound, which is full at about 2 GB of text and still rules out most
windows that are met once at 50 GB; beyond, more and more windows are grouped, with the same result. Windows are shuffled once, as 96
bits and a document. Those that very many tasks have met are grouped apart: partial aggregates, one row a window and task, joined back
to a settled table, which adaptive execution can split. Only texts that lose words are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Roller, give_back, map_batches, mix64, settle, slices, utf8, word_spans

WINDOW = 50
#: Bits of the merged sketch: so many for a byte of text, and at most; and its rows.
BITS_PER_BYTE, MOST_BITS, LEAST_BITS, DEPTH = 0.4, 3 << 28, 1 << 16, 2
#: Keys that a task sketches before it sends them on, and bytes of text for a shard.
FLUSH, SHARD_BYTES = 500_000, 64 << 20
#: A cell that so many partial sketches have met is common; common cells are marked in so many bits.
COMMON, COMMON_BITS = 100, 1 << 22
BROADCAST_IDS = 2_000_000
_ROLL, _ROLL2 = Roller(23), Roller(29)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours: from running minima of blocks, to the right and to the left."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    blocks = np.concatenate([x, np.full(-len(x) % width, x.max(), x.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


class Windows:
    """Every window of some texts: document, first word's place; and the number of words of every document."""

    def __init__(self, texts: list[bytes], width: int) -> None:
        self.width = width
        self.raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        self.s, self.e = word_spans(self.raw)
        doc = np.searchsorted(begin, self.s, "right") - 1
        self.n_words = np.bincount(doc, minlength=len(texts))
        self.first = np.concatenate([[0], np.cumsum(self.n_words)])
        start = np.arange(len(self.s))
        self.start = start[start + width <= self.first[doc + 1]]
        self.of = doc[self.start]
        self.words = _ROLL.words(self.raw, self.s, self.e)

    @property
    def place(self) -> np.ndarray:
        return self.start - self.first[self.of]

    def keys(self) -> np.ndarray:
        """The least hash of the runs of three fifths of a window's words inside it."""
        run = max(1, 3 * self.width // 5)
        at = np.arange(max(0, len(self.words) - run + 1))
        return sliding_min(_ROLL.spans(self.words, at, at + run), self.width - run + 1)[self.start]

    def hashes(self, keep: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the windows, or of some of them."""
        start = self.start[keep]
        return _ROLL.spans(self.words, start, start + self.width), _ROLL2.spans(_ROLL2.words(self.raw, self.s, self.e), start, start + self.width)


def distinct(of: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of the first of equal values of a document."""
    order = np.lexsort((x, of))
    new = np.ones(len(of), bool)
    new[1:] = (of[order][1:] != of[order][:-1]) | (x[order][1:] != x[order][:-1])
    return order[new]


# --- the sketch ----------------------------------------------------------------------------------------------------


def cells(keys: np.ndarray, row: int, width: int) -> np.ndarray:
    """The cell of every key in one row of the sketch: 32 bits of a hash, scaled."""
    bits = mix64(keys + np.uint64(row)) >> np.uint64(32)
    return (bits * np.uint64(width) >> np.uint64(32)).astype(np.uint32)


def packed(sorted_cells: np.ndarray) -> bytes:
    gaps = np.diff(sorted_cells, prepend=np.uint32(0)).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)


def partial_sketch(keys: np.ndarray, width: int, shards: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(row and shard, cells met, cells met twice) of some keys."""
    size = -(-width // shards)
    for row in range(DEPTH):
        met, times = np.unique(cells(keys, row, width), return_counts=True)
        edges = np.searchsorted(met, np.arange(shards + 1) * size)
        for k in range(shards):
            a, b = edges[k], edges[k + 1]
            if a < b:
                own = met[a:b] - np.uint32(k * size)
                yield row * shards + k, packed(own), packed(own[times[a:b] > 1])


def merged_sketch(texts: DataFrame, width: int, shards: int, window: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Bits of every row of the sketch: the cell was met at least twice; and bits of common cells of its first row."""
    size = -(-width // shards)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            rows = list(zip(*partial_sketch(np.concatenate(found), width, shards), strict=True))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())], names=["shard", "once", "twice"])

        found, held = [], 0
        for batch in batches:
            for a, b in slices(batch.column(1)):
                windows = Windows(utf8(batch.column(1)[a:b]), window)
                keys, of = windows.keys(), windows.of
                change = np.ones(len(of), bool)  # neighbours mostly share their key
                change[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
                keys, of = keys[change], of[change]
                found.append(keys[distinct(of, keys)])
                held += len(found[-1])
                if held >= FLUSH:
                    yield from send(found)
                    found, held = [], 0
        if held:
            yield from send(found)

    def merge(table: pa.Table) -> pa.Table:
        met, twice = np.zeros(size, np.uint8), np.zeros(size, bool)
        for once, more in zip(table["once"], table["twice"], strict=True):
            own = unpacked(once.as_py())
            met[own] += met[own] < 255
            twice[unpacked(more.as_py())] = True
        twice |= met > 1
        shard = table["shard"][0].as_py()
        common = np.unique((np.flatnonzero(met >= COMMON) + shard * size) % COMMON_BITS) if shard < shards else []
        give_back()
        return pa.table({"shard": pa.array([shard], pa.int32()), "bits": pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary()), "common": pa.array([common], pa.list_(pa.int32()))})

    parts = map_batches(texts, sketch, "shard int, once binary, twice binary")
    bits = [np.zeros(size * shards // 8 + 8, np.uint8) for _ in range(DEPTH)]
    common = np.zeros(COMMON_BITS, bool)
    for r in parts.groupBy("shard").applyInArrow(merge, "shard int, bits binary, common array<int>").toLocalIterator():
        row, k = divmod(r["shard"], shards)
        bits[row][k * size // 8 : k * size // 8 + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
        common[r["common"]] = True
    return bits, common


def estimated_repeated(bits: list[np.ndarray], width: int, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for row, some in enumerate(bits):
        c = cells(keys, row, width)
        out &= (some[c >> np.uint32(3)] >> (c & np.uint32(7)).astype(np.uint8) & 1).astype(bool)
    return out


# --- the operator --------------------------------------------------------------------------------------------------


def repeated_windows(texts: DataFrame, window: int = WINDOW, most_bits: int = MOST_BITS) -> DataFrame:
    """texts (id, text) -> (id, h1): the hash of every distinct window of a document that also starts in one of smaller id."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = int(min(max(size * BITS_PER_BYTE, LEAST_BITS), most_bits)) // DEPTH
    shards = max(1, size // SHARD_BYTES)
    width = -(-width // (shards * 8)) * shards * 8  # shards of whole bytes
    merged, common = merged_sketch(texts, width, shards, window)
    sketch = texts.sparkSession.sparkContext.broadcast((merged, common))

    def windows(wanted: bool) -> DataFrame:
        """(h1, h2, id) of the windows estimated repeated: the common ones, or the others."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits, often = sketch.value
            for batch in batches:
                ids = np.asarray(batch.column(0))
                for a, b in slices(batch.column(1)):
                    found = Windows(utf8(batch.column(1)[a:b]), window)
                    keys = found.keys()
                    keep = np.flatnonzero(estimated_repeated(bits, width, keys))
                    keep = keep[often[cells(keys[keep], 0, width) % COMMON_BITS] == wanted]
                    if not len(keep):
                        continue
                    h1, h2 = found.hashes(keep)
                    of = found.of[keep]
                    some = distinct(of, h1)
                    short = (h2[some] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(h1[some].view(np.int64)), pa.array(short), pa.array(ids[a + of[some]])], names=["h1", "h2", "id"])

        return map_batches(texts, run, "h1 long, h2 int, id long")

    earliest = F.min("id").over(Window.partitionBy("h1", "h2"))
    out = windows(False).withColumn("first", earliest).where(F.col("first") < F.col("id")).select("id", "h1")
    if common.any():
        rows = settle(windows(True))
        first = settle(rows.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where(F.col("first") < F.col("last")).drop("last"))
        out = out.unionByName(rows.join(first, ["h1", "h2"]).where(F.col("first") < F.col("id")).select("id", "h1"))
    return out


def _cover(raw: bytes, lost: np.ndarray | None, window: int) -> tuple[list[bytes], np.ndarray]:
    """Words, and which of them the lost windows cover, given by their hashes."""
    words = raw.split()  # of bytes: exactly the six ASCII white-space characters
    gone = np.zeros(len(words), bool)
    if lost is not None and len(lost):
        found = Windows([raw], window)
        h1 = _ROLL.spans(found.words, found.start, found.start + window)
        hit = np.zeros(len(words) + 1, np.int32)
        starts = found.place[np.isin(h1.view(np.int64), lost)]
        np.add.at(hit, starts, 1)
        np.add.at(hit, starts + window, -1)
        gone = np.cumsum(hit[:-1]) > 0
    return words, gone


def remove_repeats(docs: DataFrame, window: int = WINDOW, most_bits: int = MOST_BITS, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept words joined by one space, of every document.

    Null and empty texts have no words. Rows without an id are neither changed nor compared. Rows that repeat an id are one
    document: they do not remove each other's words. Of equal passages that of the smallest id stays. Empty table: empty result. Other
    columns, whatever their names, are not read. A long text takes a worker about 50 bytes of memory a byte.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    gone = repeated_windows(texts.where(F.col("id").isNotNull()), window, most_bits).groupBy("id").agg(F.collect_list("h1").alias("lost"))
    gone = settle(gone.withColumnRenamed("id", "of"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                n, removed, digest, kept = [], [], [], []
                for k, raw in enumerate(utf8(batch.column(1)[a:b]), a):
                    own = np.asarray(batch.column(2)[k].values) if batch.num_columns > 2 and batch.column(2)[k].is_valid else None
                    words, out = _cover(raw, own, window)
                    left = b" ".join([w for w, x in zip(words, out.tolist(), strict=True) if not x] if out.any() else words)
                    n.append(len(words))
                    removed.append(int(out.sum()))
                    digest.append(hashlib.sha256(left).hexdigest())
                    if keep_text:
                        kept.append(left.decode("utf-8", "replace"))
                columns = [batch.column(0)[a:b], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), *([pa.array(kept, pa.string())] if keep_text else [])]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    n_changed = gone.count()
    if n_changed > BROADCAST_IDS:
        return map_batches(texts.join(gone, F.col("id") == F.col("of"), "left").select("id", "text", "lost"), run, schema)
    same = texts.join(F.broadcast(gone.select("of")), F.col("id") == F.col("of"), "left_anti").select("id", "text")
    ids = F.broadcast(gone.select(F.col("of").alias("_of")))
    changed = texts.join(ids, F.col("id") == F.col("_of"), "left_semi").join(gone.hint("shuffle_hash"), F.col("id") == F.col("of")).select("id", "text", "lost")
    return map_batches(same, run, schema).unionByName(map_batches(changed, run, schema))
