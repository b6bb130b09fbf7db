"""Packing documents into fixed-length sequences by cutting-stock column generation.

Documents are cut into full sequences and one remainder each. Piece lengths, rounded up to a class of `grain` tokens, are
the orders of a cutting-stock problem: a linear program over patterns (how many pieces of each class share a sequence),
whose columns a knapsack dynamic programme prices. Whole parts of the solution are used as they are, the bounded rest is
filled largest first. Ranked pieces of a class then take the class's places in the patterns, in order.

At scale: the driver sees a histogram of at most capacity / grain classes, whatever the corpus. Ranks within a class are
two-level (class and hash slice), as a third of all pieces may share one length; the map from ranks to sequences is a
table bounded by the number of classes squared, and is broadcast.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, settle, slices, utf8

CAPACITY, GRAIN, END_ID = 2048, 8, 1

# --- tokens --------------------------------------------------------------------------------------------------------

_TOKENIZERS: dict[tuple, Encoder] = {}


@dataclass(frozen=True)
class Vocabulary:
    """Where a vocabulary is: for tokenizers, and, if there is one, the same vocabulary as ranks with its pattern for tiktoken.

    Ranks only make texts cheaper to encode; the ids are the same. Ranks of another vocabulary are refused.
    """

    path: str
    ranks: str | None = None
    pattern: str | None = None


#: How the byte-level pre-tokeniser cuts texts, fixed by the format.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones for themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def same_vocabulary(made: dict, ranks: dict[bytes, int]) -> bool:
    """Whether a tokenizer file is a plain byte-level BPE, the ranks are the ids of its tokens, and its merges are in their order."""
    model, cut = made["model"], made.get("pre_tokenizer") or {}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    level = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
    if not (model.get("type") == "BPE" and plain and level and not made.get("normalizer") and all(t["special"] for t in made["added_tokens"])):
        return False
    letters, special = _byte_letters(), {t["content"] for t in made["added_tokens"]}
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    return {bytes(letters[c] for c in t): i for t, i in vocab.items()} == ranks and merged == sorted(merged)


class Encoder:
    """Token ids of whole texts, as little-endian 32-bit bytes: by the tokenizer, or by the same vocabulary's ranks, which is quicker."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary.path)
        self.tokenizer.encode_special_tokens = True
        self.ranked = None
        if vocabulary.ranks:
            import tiktoken

            with open(vocabulary.path, encoding="utf-8") as file:
                made = json.load(file)
            with open(vocabulary.ranks, "rb") as file:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
            if vocabulary.pattern != BYTE_LEVEL or not same_vocabulary(made, ranks):
                raise ValueError(f"{vocabulary.ranks} is not the vocabulary of {vocabulary.path}")
            self.ranked = tiktoken.Encoding("ranks", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, vocabulary: Vocabulary) -> Encoder:
        key = (vocabulary.path, vocabulary.ranks, vocabulary.pattern)
        if key not in _TOKENIZERS:
            _TOKENIZERS[key] = cls(vocabulary)
        return _TOKENIZERS[key]

    def plain(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.ranked is None:
            return self.plain(texts)
        return [self.ranked.encode_to_numpy(t, disallowed_special=()).astype("<u4", copy=False).tobytes() for t in texts]


PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()),
])


def pieces(docs: DataFrame, vocabulary: Vocabulary, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, the ids themselves."""
    schema = T.StructType([*PIECES.fields, T.StructField("ids", T.BinaryType())]) if keep_ids else PIECES

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder.of(vocabulary), np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            for a, b in slices(batch.column(1)):
                out: list[tuple] = []
                for i, raw in zip(batch.column(0)[a:b].to_pylist(), encoder.encode([t.decode("utf-8", "replace") for t in utf8(batch.column(1)[a:b])]), strict=True):
                    raw += end
                    total = len(raw) // 4
                    for s in range(0, total, capacity):
                        part = raw[4 * s : 4 * min(total, s + capacity)]
                        out.append((i, s, len(part) // 4, zlib.crc32(part), total, *([part] if keep_ids else [])))
                columns = zip(*out, strict=True)
                kinds = [pa.int64()] * 5 + [pa.binary()] * keep_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.name for f in schema.fields])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), cut, schema)


# --- the cutting-stock problem -------------------------------------------------------------------------------------


def best_pattern(sizes: np.ndarray, worth: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the counts of each size, within `room`, that are worth the most."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    for u in range(1, room + 1):
        n = int(np.searchsorted(sizes, u, "right"))
        best[u], last[u] = best[u - 1], -2
        if n:
            value = best[u - sizes[:n]] + worth[:n]
            k = int(np.argmax(value))
            if value[k] > best[u] + 1e-12:
                best[u], last[u] = value[k], k
    counts, u = np.zeros(len(sizes), np.int64), room
    while u > 0:
        if last[u] >= 0:
            counts[last[u]] += 1
            u -= int(sizes[last[u]])
        else:
            u -= 1
    return float(best[room]), counts


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = 5e-4, most: int = 6000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) of an optimal basis and how often the linear programme uses each.

    Ends when no column prices above 1 + gap, or when the dual bound (used / price) or the sum of all lengths is less than one
    sequence, or a share of `gap`, away.
    """
    m = len(sizes)
    basis = np.diag((room // sizes).astype(float))
    inverse, used = np.diag(1.0 / np.diag(basis)), demand / np.diag(basis)
    least = float(sizes @ demand) / room
    for _ in range(most):
        total = used.sum()
        if total - least < max(0.9, gap * total):
            break
        worth = inverse.sum(axis=0)
        value, column = best_pattern(sizes, worth, room)
        if value <= 1 + gap or total * (1 - 1 / value) < 0.9:
            break
        direction = inverse @ column
        grows = direction > 1e-9
        if not grows.any():
            break
        ratio = np.full(m, np.inf)
        ratio[grows] = used[grows] / direction[grows]
        out = int(np.argmin(ratio))
        step = ratio[out]
        used = np.maximum(used - step * direction, 0)
        used[out] = step
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        basis[:, out] = column
    return np.rint(basis).astype(np.int64), used


def solve(histogram: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ({class: pieces}, sequences) that hold all pieces of the histogram {class: pieces}."""
    sizes = np.array(sorted(histogram), np.int64)
    if not len(sizes):
        return []
    left = np.array([histogram[c] for c in sizes.tolist()], np.int64)
    found: list[tuple[dict[int, int], int]] = []
    basis, used = column_generation(sizes, left.astype(float), room)
    for k, times in enumerate(np.floor(used + 1e-9).astype(np.int64).tolist()):
        if times:
            found.append(({int(c): int(a) for c, a in zip(sizes, basis[:, k], strict=True) if a}, times))
            left = left - basis[:, k] * times
    left = np.maximum(left, 0)  # what rounding left over: largest first; its number is bounded by classes times pieces a pattern
    while left.any():
        pattern, free, times = {}, room, None
        for k in range(len(sizes) - 1, -1, -1):
            if n := min(int(left[k]), free // int(sizes[k])):
                pattern[k], free = n, free - n * int(sizes[k])
        times = max(1, min(int(left[k]) // n for k, n in pattern.items()))
        for k, n in pattern.items():
            left[k] -= n * times
        found.append(({int(sizes[k]): n for k, n in pattern.items()}, times))
    return found


def places(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, rank after the last, pieces a sequence, first sequence) of each class in each pattern."""
    out, base, begun = [], 0, {}
    for pattern, times in patterns:
        for c, n in pattern.items():
            start = begun.get(c, 0)
            out.append((c, start, start + n * times, n, base))
            begun[c] = start + n * times
        base += times
    return out


def assign(found: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """pieces, settled -> the same with sequence_id and offset."""
    spark = found.sparkSession
    n_slices = max(1, int(found.count() ** 0.5))
    ranked = found.withColumn("_class", F.ceil(F.col("length") / grain).cast("int"))
    ranked = ranked.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(n_slices)).cast("int"))
    counts = settle(ranked.groupBy("_class", "_slice").agg(F.count(F.lit(1)).alias("_n")))
    histogram = {r["_class"]: r["n"] for r in counts.groupBy("_class").agg(F.sum("_n").alias("n")).collect()}
    where = spark.createDataFrame(places(solve(histogram, capacity // grain)), "_c int, _from long, _to long, _each long, _base long")
    earlier = Window.partitionBy("_class").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_class").alias("_k"), F.col("_slice").alias("_s"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    ranked = ranked.join(starts, (F.col("_class") == F.col("_k")) & (F.col("_slice") == F.col("_s")))
    in_slice = Window.partitionBy("_class", "_slice").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = ranked.withColumn("_rank", F.col("_before") + F.row_number().over(in_slice) - 1)
    placed = ranked.join(F.broadcast(where), (F.col("_class") == F.col("_c")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    placed = placed.withColumn("sequence_id", F.col("_base") + F.floor((F.col("_rank") - F.col("_from")) / F.col("_each")))
    in_sequence = Window.partitionBy("sequence_id").orderBy(F.col("_class").desc(), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(in_sequence), F.lit(0)))
    return placed.select(*found.columns, "sequence_id", "offset")


def pack(docs: DataFrame, vocabulary: Vocabulary, capacity: int = CAPACITY, grain: int = GRAIN, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    Null and empty texts are the end id alone. Rows that repeat an id are packed one by one; equal rows take each other's places.
    Texts longer than a sequence are cut; no length is dropped. Empty table: empty result. Other columns of the input, whatever
    their names, are not read. A long text takes a worker some 30 bytes of memory a byte.
    """
    return assign(settle(pieces(docs, vocabulary, capacity, end_id, keep_ids)), capacity, grain)


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """packed with ids -> sequence_id, ids (little-endian 32-bit), n_tokens; padded to capacity unless the fill is a power of two."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    ids = F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")
    pad = F.lit(capacity) - F.when(F.expr("bit_count(n_tokens) = 1"), F.lit(capacity)).otherwise(F.col("n_tokens"))
    padding = F.repeat(F.hex(F.lit(np.asarray([pad_id], "<u4").tobytes())), pad.cast("int"))
    return rows.select("sequence_id", F.unhex(F.concat(ids, padding)).alias("ids"), "n_tokens")
