"""Quality classification by a generalised additive model with pairwise interactions.

Every feature has a lookup table over its bins, learned by cyclic boosting: round after round, a shallow tree on one feature
at a time takes a small step towards the residual. The strongest pairs of features get two-way tables the same way. A
score is a sum of table entries, so scoring is a few vectorised additions a row, and each table can be read.

At scale: one scan computes features of whole texts, a map without shuffle; the narrow feature table is settled and read
twice. Learning sees a bounded sample of labelled rows (`TRAIN_ROWS`); the model is a few KB in the task closure.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Roller, map_batches, settle, slices, utf8, word_spans

#: The labelled rows used for learning, at most (in expectation): a documented bound, sampled by a hash of the id.
TRAIN_ROWS = 20_000
FEATURES = (
    "log_words", "word_bytes", "letters", "capitals", "symbols", "stops", "shouts", "digits", "repeats", "local_variety", "top_word",
    "repeated_lines", "repeated_runs", "short_words", "longest_word", "bare_words", "line_words", "non_ascii",
)

# --- features of whole texts ---------------------------------------------------------------------------------------

_CLASS = np.zeros((256, 8), np.float32)  # letters, capitals, symbols, stops, shouts, digits, non-ascii, newline
for _c in range(256):
    _ch = chr(_c)
    _CLASS[_c] = (_c >= 128 or _ch.isalpha(), "A" <= _ch <= "Z", _ch in "#$%&*+/<=>@[\\]^_`{|}~", _ch in ".,;:", _ch in "!?", _ch.isdigit() and _c < 128, _c >= 0xC0, _c == 10)
_LETTER = _CLASS[:, 0] > 0
_ROLL = Roller(7)


def _grouped_max(keys: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    np.maximum.at(out, keys, values)
    return out


def _byte_counts(raw: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """How often each byte stands in each document, a block of bytes at a time."""
    out = np.zeros((len(begin) - 1, 256), np.int64)
    for k, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
        for at in range(a, b, 1 << 16):
            out[k] += np.bincount(raw[at : min(b, at + (1 << 16))], minlength=256)
    return out


def features(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES for every UTF-8 text; empty texts are all zeros."""
    n = len(texts)
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.array([len(t) for t in texts])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    size = np.maximum(sizes, 1)
    counts = _byte_counts(raw, begin) @ _CLASS
    s, e = word_spans(raw)
    doc = np.searchsorted(begin, s, "right") - 1
    words = np.bincount(doc, minlength=n)
    w = np.maximum(words, 1)
    h = _ROLL.words(raw, s, e)
    length = e - s
    per = lambda x: np.bincount(doc, weights=x, minlength=n)
    bare = ~np.logical_or.reduceat(_LETTER[raw], s) if len(s) else np.zeros(0, bool)  # to the next word; white space has no letters
    same_doc = np.zeros(len(s), bool)
    same_doc[1:] = doc[1:] == doc[:-1]
    repeat = np.zeros(len(s))
    repeat[1:] = same_doc[1:] & (h[1:] == h[:-1])
    first_word = np.concatenate([[0], np.cumsum(words)])[:-1]
    block = (np.arange(len(s)) - first_word[doc]) // 50  # variety is measured within 50 words, so that length does not matter
    place = doc.astype(np.uint64) << np.uint64(40) | block.astype(np.uint64) << np.uint64(16)
    order = np.lexsort((h, place))
    new = np.ones(len(s), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (place[order][1:] != place[order][:-1])
    variety = np.bincount(doc[order], weights=new, minlength=n)
    order = np.lexsort((h, doc))
    new = np.ones(len(s), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    edges = np.flatnonzero(new)
    top = _grouped_max(doc[order][edges], np.diff(np.append(edges, len(s))), n)

    def repeated(keys: np.ndarray, of: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Share of weight of what has stood in its document before."""
        order = np.lexsort((keys, of))
        again = np.zeros(len(keys))
        again[1:] = (keys[order][1:] == keys[order][:-1]) & (of[order][1:] == of[order][:-1])
        total = np.bincount(of, weights=weight, minlength=n)
        return np.bincount(of[order], weights=again * weight[order], minlength=n) / np.maximum(total, 1)

    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    full = ends > starts
    line_doc = np.searchsorted(begin, starts[full], "right") - 1
    lines = repeated(_ROLL.words(raw, starts[full], ends[full]), line_doc, (ends - starts)[full].astype(float))
    runs = np.zeros(n)
    if len(s) > 4:
        ok = doc[4:] == doc[:-4]
        runs = repeated(_ROLL.spans(h, np.flatnonzero(ok), np.flatnonzero(ok) + 5), doc[:-4][ok], np.ones(int(ok.sum())))
    out = np.stack([
        np.log1p(words), per(length) / w, counts[:, 0] / size, counts[:, 1] / np.maximum(counts[:, 0], 1), counts[:, 2] / size, counts[:, 3] / w, counts[:, 4] / w, counts[:, 5] / size,
        per(repeat) / w, variety / w, top / w, lines, runs, per(length <= 1) / w, np.log1p(_grouped_max(doc, length, n)), per(bare) / w, words / np.maximum(counts[:, 7], 1), counts[:, 6] / size,
    ], axis=1)
    out[words == 0] = 0
    return out


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id and `f`, the features of the whole text (null: empty) as an array of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                x = features(utf8(batch.column(1)[a:b]))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["doc_id", "f"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, f array<double>")


# --- the model -----------------------------------------------------------------------------------------------------


@dataclass
class AdditiveModel:
    edges: list[np.ndarray]  # of every feature's bins
    bias: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    coarse: list[np.ndarray]  # from bins to the few bins of pair tables
    pair_tables: list[np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), int)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(np.nan_to_num(x))
        out = np.full(len(x), self.bias)
        for k, t in enumerate(self.tables):
            out += t[b[:, k]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _step(g: np.ndarray, h: np.ndarray, leaves: int, reg: float, least: float) -> np.ndarray:
    """A tree of a few leaves over ordered bins: Newton steps that lower the loss most, by greedy splits."""
    cuts, cg, ch = [0, len(g)], np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain_of = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + reg)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:], strict=False):
            m = np.arange(a + 1, b)
            m = m[(ch[m] - ch[a] >= least) & (ch[b] - ch[m] >= least)]
            if len(m):
                gain = gain_of(a, m) + gain_of(m, b) - gain_of(a, b)
                k = int(np.argmax(gain))
                best = max(best, (float(gain[k]), int(m[k])), key=lambda x: x[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + reg)
    return out


def fit(x: np.ndarray, y: np.ndarray, n_bins: int = 32, rounds: int = 120, rate: float = 0.15, leaves: int = 3, n_pairs: int = 6, reg: float = 1.0, least: float = 0.5) -> AdditiveModel:
    """Cyclic boosting of one-feature trees, then of the pairs with the largest gain on what is left."""
    n, m = x.shape
    p0 = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(p0 / (1 - p0)))
    if len(np.unique(y)) < 2:
        return AdditiveModel([], bias, [], [], [], [])
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, n_bins + 1)[1:-1])) for k in range(m)]
    model = AdditiveModel(edges, bias, [np.zeros(len(e) + 1) for e in edges], [], [np.arange(len(e) + 1) * 6 // (len(e) + 1) for e in edges], [])
    b, f = model.bins(x), np.full(n, bias)
    for _ in range(rounds):
        for k in range(m):
            p = 1 / (1 + np.exp(-f))
            size = len(edges[k]) + 1
            step = rate * _step(np.bincount(b[:, k], y - p, size), np.bincount(b[:, k], p * (1 - p), size), leaves, reg, least)
            model.tables[k] += step
            f += step[b[:, k]]
    for k, t in enumerate(model.tables):  # centred, so that the bias is the mean
        mean = float(t[b[:, k]].mean())
        model.tables[k], model.bias = t - mean, model.bias + mean
    p = 1 / (1 + np.exp(-f))
    found = []
    for i in range(m):
        for j in range(i + 1, m):
            cell = model.coarse[i][b[:, i]] * 6 + model.coarse[j][b[:, j]]
            g, h = np.bincount(cell, y - p, 36), np.bincount(cell, p * (1 - p), 36)
            found.append((float((g * g / (h + reg)).sum()), i, j))
    model.pairs = [(i, j) for _, i, j in sorted(found, reverse=True)[:n_pairs]]
    model.pair_tables = [np.zeros((6, 6)) for _ in model.pairs]
    for _ in range(rounds // 4):
        for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
            p = 1 / (1 + np.exp(-f))
            cell = model.coarse[i][b[:, i]] * 6 + model.coarse[j][b[:, j]]
            g, h = np.bincount(cell, y - p, 36).reshape(6, 6), np.bincount(cell, p * (1 - p), 36).reshape(6, 6)
            # depth two: cut the first feature, then the second within each side
            halves = np.split(np.arange(6), [1 + int(np.argmax([(g[:c].sum() ** 2) / (h[:c].sum() + reg) + (g[c:].sum() ** 2) / (h[c:].sum() + reg) for c in range(1, 6)]))])
            step = np.zeros((6, 6))
            for rows in halves:
                step[rows] = rate * _step(g[rows].sum(0), h[rows].sum(0), 2, reg, least)
            t += step
            f += step.ravel()[cell]
    return model


# --- the operator --------------------------------------------------------------------------------------------------


def fold(doc_id: str | Column, folds: int) -> Column:
    return F.pmod(F.crc32(F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))), F.lit(folds))


def train_rows(labels: DataFrame, target: str, folds: int, held: int, most: int) -> DataFrame:
    """(doc_id, y) of the labelled rows outside the held-out fold, thinned by a hash of the id to `most` in expectation."""
    rows = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), F.col(target).cast("double").alias("y"))
    rows = rows.where(fold("_id", folds) != held).groupBy("_id").agg(F.max("y").alias("y"))
    keep = min(1.0, most / max(1, rows.count()))
    return rows.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(keep * 1_000_000))


def train(table: DataFrame, rows: DataFrame) -> AdditiveModel:
    """Fit on the feature table's rows of the ids in `rows` (_id, y)."""
    found = table.join(F.broadcast(rows), F.col("doc_id") == F.col("_id")).select("doc_id", "f", "y").orderBy("doc_id").collect()
    if not found:
        return AdditiveModel([], 0.0, [], [], [], [])
    return fit(np.array([r["f"] for r in found]), np.array([r["y"] for r in found]))


def score(table: DataFrame, model: AdditiveModel, folds: int = 3, held: int = 1, cut: float = 0.5) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    scored = map_batches(table.select("doc_id", "f"), run, "doc_id long, score double")
    return scored.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Null and empty texts are scored as texts without words. Repeated rows get equal scores, and so do texts with equal features.
    Without labels every score is 0.5. Of an id labelled twice, the larger label counts. Empty table: empty result. Other columns,
    whatever their names, are not read. A long text takes a worker about 30 bytes of memory a byte.
    """
    found = settle(feature_table(docs))
    return score(found, train(found, train_rows(labels, "quality", 3, 1, TRAIN_ROWS)))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.5) -> DataFrame:
    """The rows whose text scores at least `cut`, with all their columns. Scored in place: texts are not shuffled.

    Null and empty texts, repeated rows, empty tables: as `classify` has it; a row stays or goes by its text alone.
    """
    rows = settle(train_rows(labels, "quality", 3, 1, TRAIN_ROWS))
    model = train(feature_table(docs.select("doc_id", "text").join(F.broadcast(rows.select("_id")), F.col("doc_id") == F.col("_id"), "left_semi")), rows)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(at)):
                yield batch.slice(a, b - a).filter(pa.array(model.score(features(utf8(batch.column(at)[a:b]))) >= cut))

    at, names = docs.columns.index("text"), docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return map_batches(plain, mask, plain.schema).toDF(*names)
