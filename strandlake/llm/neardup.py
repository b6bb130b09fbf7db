"""Near-duplicate documents: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

A document is the set of its distinct four-word shingles. One hash deals the shingles into bins and the least of each bin is the
signature; an empty bin takes the value of the first full bin in its own random order of bins. Bands of the signature are
buckets. A bucket gives a star, not all pairs: every member's edge to the smallest member, kept if the signatures agree.
Edges make families, within which links are confirmed on full sets; confirmed links make components.

A star can miss a link between two members of a bucket that are each unlike its centre. So buckets that still hold several
families are gone through again: members outside a bucket's largest family are compared with all its members, in blocks, and
families of likely pairs are joined, until no bucket has such a pair. Within a family, sets are compared in blocks as products
of incidence matrices, which give all exact overlaps without a row a pair; a block returns a spanning forest of its links. Each
block of members is compared within itself and with the family's centre first; only what is not of the family's largest
component then is compared with all other members.

At scale: equal sets are one class from the start, by partial aggregation, so that thousands of copies are one member of their
buckets. Only sets of families move: once, and again if their family is still several components. Everything that can be skewed
(classes, buckets, stars) is either a partial aggregate or a join of settled tables with one row on the other side, which adaptive
execution can split; a large family is many blocks, bounded by members and by bytes. The work within a family grows with its
members times those outside its largest component.

A text that is long takes a worker about 60 bytes of memory a byte; its set is sent as 8 bytes a distinct shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Roller, give_back, map_batches, mix64, settle, slices, utf8, word_spans

SHINGLE, BINS, ROWS = 4, 128, 4
BANDS = BINS // ROWS
#: Links hold 100 * |common| >= PERCENT * |union|.
PERCENT = 80
#: Signature bins that agree, at least, for two texts to be of one family: for sets of fewer than SMALL shingles, whose bins are mostly
#: copies of a few, and for others. Of 200,000 simulated pairs at the threshold none of 4 to 800 shingles had fewer than 70 and 80.
SMALL, LIKELY_SMALL, LIKELY = 64, 64, 76
#: Up to so many documents of families their ids are broadcast (24 bytes each).
BROADCAST_IDS = 1_000_000
LEFT, RIGHT, BLOCK = 500, 2000, 512
#: Bytes of sets that a block of a family, and a task of blocks, hold (in expectation; a longer set stands alone).
BLOCK_BYTES, TASK_BYTES = 4 << 20, 8 << 20
_ROLL, _LOWER = Roller(3), np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SALTS = mix64(np.arange(1, BINS + 1, dtype=np.uint64))
_ORDERS = np.argsort(np.random.default_rng(17).random((BINS, BINS)), axis=1)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of every distinct shingle, sorted by both."""
    raw = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    s, e = word_spans(raw)
    doc = np.searchsorted(begin, s, "right") - 1
    words = _ROLL.words(raw, s, e)
    n = np.bincount(doc, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(n)])
    # a shingle starts at every word that has three more behind it, and at the first word of shorter documents
    start = np.arange(len(words))
    fits = (start + SHINGLE <= first[doc + 1]) | (start == first[doc])
    start = start[fits]
    of = doc[fits]
    hashes = _ROLL.spans(words, start, np.minimum(start + SHINGLE, first[of + 1]))
    order = np.lexsort((hashes, of))
    of, hashes = of[order], hashes[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
    return of[new], hashes[new]


def signatures(of: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """document, bin -> the least shingle of the bin, empty bins filled. Sets without shingles stay zero."""
    out, full = np.zeros((n, BINS), np.uint64), np.zeros((n, BINS), bool)
    bins = (hashes >> np.uint64(57)).astype(np.int64)
    first = np.ones(len(of), bool)
    first[1:] = (of[1:] != of[:-1]) | (bins[1:] != bins[:-1])
    out[of[first], bins[first]], full[of[first], bins[first]] = hashes[first], True
    d, b = np.nonzero(~full & full.any(1)[:, None])
    for k in range(0, len(d), 4_000):
        dd, bb = d[k : k + 4_000], b[k : k + 4_000]
        source = _ORDERS[bb, np.argmax(full[dd[:, None], _ORDERS[bb]], axis=1)]
        out[dd, bb] = out[dd, source]
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """document, band -> key of its bucket."""
    mixed = mix64(signature ^ _SALTS)
    return mix64(mixed.reshape(len(signature), BANDS, ROWS).sum(axis=2, dtype=np.uint64)).view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, n, s1, s2, bands, sig): size and digest of every document's set, its buckets, and 16 bits of every bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                of, hashes = shingle_sets(utf8(batch.column(1)[a:b]))
                n = np.bincount(of, minlength=b - a)
                full = np.concatenate([[0], np.cumsum(n)])
                digest = [np.concatenate([[0], np.cumsum(mix64(hashes ^ salt), dtype=np.uint64)]).astype(np.uint64) for salt in _SALTS[:2]]
                s1, s2 = ((c[full[1:]] - c[full[:-1]]).view(np.int64) for c in digest)
                sig = signatures(of, hashes, b - a)
                keys = bands(sig)
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[n > 0].ravel(), pa.int64()))
                short = (mix64(sig) >> np.uint64(48)).astype("<u2")
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(n, pa.int64()), pa.array(s1), pa.array(s2), lists, pa.array([x.tobytes() for x in short], pa.binary())], names=["doc_id", "n", "s1", "s2", "bands", "sig"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n long, s1 long, s2 long, bands array<long>, sig binary")


def agreeing(agree: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether two sets of n and m shingles can be linked by their sizes and the number of bins that agree."""
    least, most = np.minimum(n, m), np.maximum(n, m)
    return (agree >= np.where(least < SMALL, LIKELY_SMALL, LIKELY)) & (100 * least >= percent * most)


def likely(pairs: DataFrame, sigs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b) -> those whose sizes and signatures agree."""
    x, y = (sigs.select(F.col("id").alias(i), F.col("n").alias(f"n{i}"), F.col("sig").alias(f"s{i}")) for i in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4_000):
                part = batch.slice(at, 4_000)
                left, right = (np.frombuffer(b"".join(part.column(k).to_pylist()), "<u2").reshape(-1, BINS) for k in (2, 3))
                keep = agreeing((left == right).sum(1), np.asarray(part.column(4)), np.asarray(part.column(5)), percent)
                yield pa.RecordBatch.from_arrays(part.columns[:2], names=["a", "b"]).filter(pa.array(keep))

    return map_batches(pairs.join(y, "b").join(x, "a").select("a", "b", "sa", "sb", "na", "nb"), run, "a long, b long")


def _links_within(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest (member, least member) of the links between the sets of two sides, or of one if all are 0."""
    n, size = len(sets), np.array([len(x) for x in sets])
    member, value = np.repeat(np.arange(n), size), np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    value, member = value[order], member[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    word = np.cumsum(new) - 1
    shared = np.bincount(word)[word] > 1
    word, member = word[shared], member[shared]
    two = bool(side.any())
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(n), np.arange(n))
    row, column = np.zeros(n, np.int64), np.zeros(n, np.int64)
    row[left], column[right] = np.arange(len(left)), np.arange(len(right))
    on_left = side[member] == 0
    on_right = ~on_left if two else on_left
    common = np.zeros((len(left), len(right)), np.float32)
    word = np.unique(word, return_inverse=True)[1]
    for a in range(0, int(word[-1]) + 1 if len(word) else 0, 2048):  # a slice of shingles at a time
        k = slice(*np.searchsorted(word, [a, a + 2048]))
        x, y = np.zeros((len(left), 2048), np.float32), np.zeros((len(right), 2048), np.float32)
        x[row[member[k][on_left[k]]], word[k][on_left[k]] - a] = 1
        y[column[member[k][on_right[k]]], word[k][on_right[k]] - a] = 1
        common += x @ y.T
    both = common.astype(np.int64)
    linked = 100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)
    label = np.arange(n)
    while True:
        least = label.copy()
        if linked.size:
            least[left] = np.minimum(least[left], np.where(linked, label[right][None, :], n).min(1))
            least[right] = np.minimum(least[right], np.where(linked, label[left][:, None], n).min(0))
        if (least == label).all():
            return [(k, int(v)) for k, v in enumerate(label) if v != k]
        label = least


def _blocks(members: str | Column, shingles: str | Column) -> Column:
    return F.ceil(F.greatest(members / F.lit(BLOCK), 8 * shingles / F.lit(BLOCK_BYTES))).cast("int")


def family_sets(docs: DataFrame, families: DataFrame) -> tuple[DataFrame, int]:
    """families (id, family, n) -> (id, family, blocks, k, set), the sets of their documents, dealt into blocks by id; and their bytes."""
    sizes = settle(families.groupBy("family").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total")))  # so that a join can split a large family
    blocks = _blocks(F.col("size"), F.col("total"))
    rows = settle(families.join(sizes, "family").select(F.col("id").alias("_id"), "family", "n", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("k")))
    n_rows, total = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
    rows = rows.drop("n")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    chosen = texts.join(F.broadcast(rows) if n_rows <= BROADCAST_IDS else rows, F.col("id") == F.col("_id"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0)):
                of, hashes = shingle_sets(utf8(batch.column(0)[a:b]))
                ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=b - a))])
                raw = hashes.tobytes()
                sets = pa.array([raw[8 * x : 8 * y] for x, y in zip(ends, ends[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c[a:b] for c in batch.columns[1:]), sets], names=["id", "family", "blocks", "k", "set"])

    sets = map_batches(chosen.select("text", "id", "family", "blocks", "k"), read, "id long, family long, blocks int, k int, set binary")
    return sets, 8 * (total or 0)


def _links_of_blocks(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """rows (id, family, i, j, side, set), of about `size` bytes -> (a, b): links between the sides of each (family, i, j), or within side 0 where there is no other."""

    def run(table: pa.Table) -> pa.Table:
        family, i, j, side, ids = (np.asarray(table[c]) for c in ("family", "i", "j", "side", "id"))
        values = table["set"]
        order = np.lexsort((ids, side, j, i, family))
        change = np.flatnonzero((np.diff(family[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)) + 1
        a, b = [], []
        for own in np.split(order, change):
            own = own[np.concatenate([[True], (np.diff(ids[own]) != 0) | (np.diff(side[own]) != 0)])]  # an id that repeats counts once
            if len(own) > 1:
                for x, y in _links_within([np.frombuffer(values[t].as_py(), np.uint64) for t in own.tolist()], side[own], percent):
                    a.append(int(ids[own[y]]))
                    b.append(int(ids[own[x]]))
        give_back()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    tasks = max(1, size // TASK_BYTES)
    return rows.withColumn("g", F.pmod(F.xxhash64("family", "i", "j"), F.lit(tasks))).groupBy("g").applyInArrow(run, "a long, b long")


def link_families(docs: DataFrame, families: DataFrame, percent: int = PERCENT) -> DataFrame:
    """families (id, family, n) -> (node, component) of every id that is linked; a family is named by one of its ids.

    Blocks of members are compared within themselves and with the family's centre, then what is not of the family's largest
    component is compared with all its members.
    """
    sets, size = family_sets(docs, families)
    sets = settle(sets)
    at = F.when(F.col("id") == F.col("family"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("k"))
    first = sets.withColumn("i", F.explode(at)).select("id", "family", "i", F.lit(-1).alias("j"), F.lit(0).alias("side"), "set")
    parts = components(_links_of_blocks(first, size, percent))
    inside = settle(families.join(parts, F.col("id") == F.col("node"), "left").select("id", "family", "n", F.coalesce("component", "id").alias("component")))
    sizes = inside.groupBy("family", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t"))
    split = sizes.groupBy("family").agg(F.max(F.struct("c", "component", "t")).alias("top"), F.sum("c").alias("c"), F.sum("t").alias("t"), F.count(F.lit(1)).alias("k")).where(F.col("k") > 1)
    minor, shingles = F.col("c") - F.col("top.c"), F.col("t") - F.col("top.t")
    moved = 8 * (shingles * _blocks(F.col("c"), F.col("t")) + F.col("t") * _blocks(minor, shingles))
    split = settle(split.select(F.col("family").alias("of"), F.col("top.component").alias("major"), _blocks(minor, shingles).alias("n_left"), moved.alias("moved")))
    n_split, size = split.agg(F.count(F.lit(1)), F.sum("moved")).first()
    if not n_split:
        return parts
    split = split.drop("moved")
    members = sets.join(F.broadcast(split) if n_split <= BROADCAST_IDS else split, F.col("family") == F.col("of"))
    members = members.join(inside.select(F.col("id").alias("_id"), "component"), F.col("id") == F.col("_id")).select("id", "family", "blocks", "k", "component", "major", "n_left", "set")
    left = members.where(F.col("component") != F.col("major")).withColumns({"i": F.pmod(F.xxhash64("id", F.lit(1)), "n_left").cast("int"), "j": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    right = members.withColumns({"j": F.col("k"), "i": F.explode(F.sequence(F.lit(0), F.col("n_left") - 1))})
    columns = ["id", "family", "i", "j"]
    both = left.select(*columns, F.lit(0).alias("side"), "set").unionByName(right.select(*columns, F.lit(1).alias("side"), "set"))
    return components(parts.select("node", "component").union(_links_of_blocks(both, size, percent)).toDF("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, component): the least node reachable, by alternating large and small stars until nothing changes.

    Only the first join can meet a node of many rows, the least one of a star: both its sides are settled tables, so that adaptive
    execution can split it.
    """
    edges = settle(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
        larger = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = settle(edges.union(larger).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        # every larger neighbour of a node to the least of the node and its neighbours
        large = settle(larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        edges = settle(large.join(least, "u").select(moved).select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct())


def _likely_pairs(members: DataFrame, sigs: DataFrame, most: int, percent: int = PERCENT) -> DataFrame:
    """members (key, id, component) -> (a, b): pairs of one bucket, in different components, whose signatures agree.

    A member gives its `most` likeliest partners of each block; those it leaves out are found again, once components are
    joined, if they still matter: no link is lost, since the caller goes on until no such pair is left.
    """
    sizes = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    ranked = sizes.groupBy("key").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"))
    split = settle(ranked.where(F.col("k") > 1).select(F.col("key").alias("of"), F.col("top.component").alias("major"), (F.col("n") - F.col("top.c")).alias("minor"), "n"))
    inside = members.join(split, F.col("key") == F.col("of")).join(sigs.select("id", F.col("n").alias("m"), "sig"), "id")
    n_left, n_right = F.ceil(F.col("minor") / LEFT).cast("int"), F.ceil(F.col("n") / RIGHT).cast("int")
    salt = lambda n: F.pmod(F.xxhash64("id", "key"), n).cast("int")
    left = inside.where(F.col("component") != F.col("major")).select("key", "id", "component", "m", "sig", F.lit(0).alias("side"), salt(n_left).alias("i"), F.explode(F.sequence(F.lit(0), n_right - 1)).alias("j"))
    right = inside.select("key", "id", "component", "m", "sig", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), n_left - 1)).alias("i"), salt(n_right).alias("j"))
    rows = settle(left.union(right))
    n_groups = max(1, rows.count() // 20_000)

    def run(table: pa.Table) -> pa.Table:
        key, i, j, side = (np.asarray(table[c]) for c in ("key", "i", "j", "side"))
        ids, comps, n = np.asarray(table["id"]), np.asarray(table["component"]), np.asarray(table["m"])
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), "<u2").reshape(-1, BINS)
        order = np.lexsort((ids, side, j, i, key))
        change = np.flatnonzero((np.diff(key[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)) + 1
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for run_ in np.split(order, change):
            lefts, rights = run_[side[run_] == 0], run_[side[run_] == 1]
            for k in lefts.tolist():
                others = rights[comps[rights] != comps[k]]
                agree = (sig[others] == sig[k]).sum(1)
                fine = agreeing(agree, n[others], n[k], percent)
                good = others[fine]
                if len(good):
                    best = good[np.argsort(-agree[fine], kind="stable")[:most]]
                    out.append((np.full(len(best), ids[k]), ids[best]))
        a, b = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        give_back()
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    found = rows.withColumn("g", F.pmod(F.xxhash64("key", "i", "j"), F.lit(n_groups))).groupBy("g").applyInArrow(run, "a long, b long")
    return found.distinct()


def link(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(sketches, classes): documents with the digest of their set, and classes (s1, s2, n, component)."""
    found = settle(sketch(docs))
    full = found.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = settle(full.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    sigs = classes.select("id", "n", "sig")
    members = classes.select(F.explode("bands").alias("key"), "id")
    centres = members.groupBy("key").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
    shared = settle(members.join(centres, "key"))
    stars = shared.where(F.col("id") != F.col("centre")).select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    parts = components(likely(stars, sigs, percent))
    others = shared.where(F.col("c") > 2).select("key", "id")  # a bucket of two is its star
    while True:
        inside = others.join(parts, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("component"))
        more = settle(_likely_pairs(inside, sigs, 4, percent))
        if more.isEmpty():
            break
        parts = components(parts.union(more).toDF("a", "b"))
    roots = parts.select("component").distinct()
    families = parts.select(F.col("node").alias("id"), F.col("component").alias("family")).union(roots.select("component", "component"))
    parts = link_families(docs, settle(families.join(classes.select("id", "n"), "id")), percent)
    component = classes.select("s1", "s2", "n", "id").join(parts, F.col("id") == F.col("node"), "left").select("s1", "s2", "n", F.coalesce("component", "id").alias("component"))
    return found, component


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Null and empty texts have no shingles and are linked with nothing. Rows without an id are members of their class, but never
    its id. Rows that repeat an id are kept or dropped together. Of equal texts the smallest id is kept. Empty table: empty result.
    Other columns, whatever their names, are not read.
    """
    found, classes = link(docs, percent)
    rows = found.select("doc_id", "n", "s1", "s2").join(classes.select("s1", "s2", "n", "component"), ["s1", "s2", "n"], "left")
    component = F.coalesce("component", "doc_id")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component, with all its columns, whatever their names; of rows that repeat an id one. Rows without an id stay.

    Null and empty texts stay. Texts are not shuffled, but for those of repeated ids.
    """
    result = settle(deduplicate(docs, percent).where(F.col("doc_id").isNotNull()))
    names = [f"c{i}" for i in range(len(docs.columns))]
    key = names[docs.columns.index("doc_id")]

    def without(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, F.col(key) == F.col("doc_id"), how)

    kept = without(docs.toDF(*names), settle(result.where(~F.col("kept")).select("doc_id").distinct()), "left_anti")
    again = settle(result.where("kept").groupBy("doc_id").count().where(F.col("count") > 1).select("doc_id"))
    if not again.isEmpty():
        kept = without(kept, again, "left_anti").unionByName(without(kept, again, "left_semi").dropDuplicates([key]))
    return kept.toDF(*docs.columns)
