"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are projected on Gaussian directions and cut into slots; k slots are a bucket, and there are several tables. A query does
not only visit its own bucket: occupied buckets are visited first in the order of their estimated success, the chance that a
neighbour at the distance of the wanted rank falls there. The 20th best score found so bounds the query's result from below, and
all buckets of one table are visited that the bound does not rule out. So the result is exact, whatever the estimate is worth for
a query. What the tables find is merged and ranked by exact inner products in double precision.

Inner products become distances by one more component that gives all vectors the largest norm. The chance of a bucket is that
of the slots of a neighbour whose cosine is `near`, estimated from a bounded sample (a tenth of all rows, `SAMPLE` at most); projections of such a
neighbour are normal around near times the query's. It orders the first visits only. A bucket is ruled out by its slots: how far the
query's projections are from them bounds the inner product with all that the bucket can hold.

At scale: a bucket's vectors and its queries are cut into blocks, so that a bucket with a third of all vectors is many tasks and a
task is one matrix product of bounded size; after the first visits, small buckets that lie together are visited as one. A block
returns only what is above the query's bound. (A first bound is the 20th best of the sample.) A query with near neighbours leaves
most buckets out; one whose neighbours are hardly nearer than other vectors visits nearly all rows. The driver sees counts by
bucket: at most tables times slots to the power k.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, ship

SAMPLE, TABLES, FUNCTIONS, SLOT, BLOCK = 2000, 2, 4, 1.5, 2000
#: The first visits are to buckets that hold so many times the wanted rows at least, in each table; smaller tables are visited whole.
LEAST = 10
#: Share of the chances that the first visits make up, at least.
FIRST = 0.3


@dataclass
class Hashing:
    """Directions and shifts of every table, and what is known of neighbours."""

    directions: np.ndarray  # table, function, component
    shifts: np.ndarray  # table, function
    slot: float
    norm: float  # the largest
    near: float  # cosine, of vectors made equally long, at the wanted rank

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(0, self.norm**2 - (x * x).sum(1)))[:, None]], axis=1) / self.norm

    def aim(self, q: np.ndarray) -> np.ndarray:
        return np.concatenate([q / np.sqrt((q * q).sum(1))[:, None], np.zeros((len(q), 1))], axis=1)

    def slots(self, lifted: np.ndarray, table: int) -> np.ndarray:
        return np.floor((lifted @ self.directions[table].T + self.shifts[table]) / self.slot).astype(np.int64)

    def chances(self, aimed: np.ndarray, table: int, buckets: np.ndarray) -> np.ndarray:
        """query, bucket -> chance that a neighbour falls there."""
        at = self.near * (aimed @ self.directions[table].T)
        spread = max(1e-3, (1 - self.near**2) ** 0.5)
        out = np.ones((len(aimed), len(buckets)))
        for f in range(buckets.shape[1]):
            low = (buckets[None, :, f] * self.slot - self.shifts[table, f] - at[:, None, f]) / spread
            out *= np.maximum(_phi(low + self.slot / spread) - _phi(low), 1e-300)
        return out

    def reach(self, aimed: np.ndarray, table: int, buckets: np.ndarray) -> np.ndarray:
        """query, bucket -> a bound from above on the cosine with any lifted vector of the bucket."""
        at = aimed @ self.directions[table].T + self.shifts[table]
        away = np.zeros((len(aimed), len(buckets)))
        for f in range(buckets.shape[1]):
            low = buckets[None, :, f] * self.slot
            away += np.maximum(0, np.maximum(low - at[:, None, f], at[:, None, f] - low - self.slot) - 1e-9) ** 2
        # projections stretch a distance by the root of this at most
        stretch = np.linalg.eigvalsh(self.directions[table] @ self.directions[table].T)[-1]
        return 1 - away / (2 * stretch)


def _phi(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, to 1e-7 (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = np.exp(-x * x / 2) / 2.5066282746310002 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x < 0, tail, 1 - tail)


def usable(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): vectors that take part, as doubles; of an id that repeats, the least vector."""
    v = F.col(vector)
    fine = v.isNotNull() & F.col(key).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return table.where(fine).select(F.col(key).cast("long").alias("id"), v.cast("array<double>").alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def fit(rows: DataFrame, dim: int, top: int, seed: int = 5, sample: int = SAMPLE) -> tuple[Hashing, np.ndarray, np.ndarray]:
    """The hashing, and the sample's ids and vectors."""
    n, norm = rows.agg(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    some = rows.orderBy(F.xxhash64("id"), "id").limit(max(1, min(sample, n // 10))).collect()
    ids, x = np.array([r["id"] for r in some], np.int64), np.array([r["v"] for r in some]).reshape(len(some), dim)
    rng = np.random.default_rng(seed)
    made = Hashing(rng.normal(size=(TABLES, FUNCTIONS, dim + 1)), rng.uniform(0, SLOT, (TABLES, FUNCTIONS)), SLOT, norm**0.5 * (1 + 1e-12), 0.0)
    if len(x) > 1:
        some_queries = slice(0, 300)
        cosines = made.aim(x[some_queries]) @ made.lift(x).T
        cosines[np.arange(len(cosines)), np.arange(len(cosines))] = -2
        rank = min(max(1, round(top * len(x) / n)), len(x) - 1)
        made.near = float(np.clip(np.median(-np.sort(-cosines, axis=1)[:, rank - 1]), 0.0, 0.999))
    return made, ids, x


def search(table: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, top: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose id is divisible by `every`, the `top` rows with the largest inner product.

    Vectors that are null, zero, or hold nulls or non-finite components take no part, nor do rows without an id. Of rows that
    repeat an id one counts; a query is not its own candidate. Vectors of another length than the most frequent one are
    searched among themselves. Ties go to the smaller id. Empty table: empty result.
    """
    ship(table.sparkSession)
    rows = settle(usable(table, key, vector))
    out = None
    for r in rows.groupBy(F.size("v").alias("dim")).count().orderBy("dim").collect():
        found = _search(rows.where(F.size("v") == r["dim"]), r["dim"], every, top)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(-1, dim)


def _search(rows: DataFrame, dim: int, every: int, top: int) -> DataFrame:
    spark = rows.sparkSession
    made, sample_ids, sample = fit(rows, dim, top)

    def index(batches):
        for batch in batches:
            lifted = made.lift(_matrix(batch.column(1), dim))
            for t in range(TABLES):
                names = [f"{t}:" + ",".join(map(str, s)) for s in made.slots(lifted, t).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), batch.column(0), batch.column(1)], names=["bucket", "id", "v"])

    indexed = settle(rows.select("id", "v").mapInArrow(index, "bucket string, id long, v array<double>"))
    sizes = {r["bucket"]: r["count"] for r in indexed.groupBy("bucket").count().collect()}
    names = [sorted((b for b in sizes if b.startswith(f"{t}:")), key=lambda b: [int(s) for s in b.split(":")[1].split(",")]) for t in range(TABLES)]
    held = [np.array([sizes[b] for b in some], np.int64) for some in names]
    buckets = [np.array([[int(s) for s in b.split(":")[1].split(",")] for b in some], np.int64).reshape(-1, FUNCTIONS) for some in names]

    # buckets of the first table, those that lie together as one unit of a block or more
    unit_of = np.concatenate([[0], np.cumsum(held[0])[:-1] // BLOCK]).astype(np.int64) if len(held[0]) else np.zeros(0, np.int64)
    units = np.unique(unit_of)

    def asked(batches):
        """(ids, column of vectors, vectors, a bound from below on the score of the wanted rank) of up to 512 queries."""
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                ids, q = np.asarray(part.column(0)), _matrix(part.column(1), dim)
                scores = q @ sample.T
                scores[ids[:, None] == sample_ids[None, :]] = -np.inf
                least = np.partition(scores, -top, axis=1)[:, -top] if scores.shape[1] >= top else np.full(len(q), -np.inf)
                least = np.maximum(least, part.column(2).to_numpy(zero_copy_only=False))
                yield ids, part.column(1), q, np.where(np.isfinite(least), least - 1e-9 * (1 + np.abs(least)), -np.inf)

    def probes(places, ids, column, least, who, where):
        return pa.RecordBatch.from_arrays([pa.array([places[b] for b in where], pa.string()), pa.array(ids[who]), column.take(pa.array(who)), pa.array(least[who])], names=["bucket", "id", "v", "least"])

    def probe_first(batches):
        for ids, column, q, least in asked(batches):
            for t in range(TABLES):
                chance = made.chances(made.aim(q), t, buckets[t])
                order = np.argsort(-chance, axis=1, kind="stable")
                sorted_chance, rows_held = np.take_along_axis(chance, order, 1), held[t][order]
                total, rows_seen = np.cumsum(sorted_chance, axis=1), np.cumsum(rows_held, axis=1)
                who, place = np.nonzero((total - sorted_chance < FIRST * total[:, -1:]) | (rows_seen - rows_held < LEAST * top))
                yield probes(names[t], ids, column, least, who, order[who, place])

    def probe_rest(batches):
        for ids, column, q, least in asked(batches):
            reach = made.reach(made.aim(q), 0, buckets[0])
            reach = np.stack([reach[:, unit_of == u].max(1) for u in units], axis=1)
            length = np.sqrt((q * q).sum(1)) * made.norm
            who, where = np.nonzero(reach * length[:, None] >= least[:, None])
            yield probes([str(u) for u in units], ids, column, least, who, where)

    kinds = "bucket string, id long, v array<double>, least double"
    queries = settle(rows.where(F.col("id") % every == 0).select("id", "v"))

    def rank(mine: pa.Table, asking: pa.Table) -> pa.Table:
        ids, who, where, exact = np.asarray(mine["id"]), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        query_ids = np.asarray(asking["id"])
        if len(ids) and len(query_ids):
            x, q, least = _matrix(mine["v"], dim), _matrix(asking["v"], dim), np.asarray(asking["least"])
            scores = q @ x.T
            scores[query_ids[:, None] == ids[None, :]] = -np.inf
            if len(ids) > top:
                best = np.partition(scores, -top, axis=1)[:, -top]
                least = np.maximum(least, best - 1e-9 * (1 + np.abs(best)))
            who, where = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
            exact = np.concatenate([(q[who[a : a + 65536]] * x[where[a : a + 65536]]).sum(1) for a in range(0, len(who), 65536)] or [exact])
            # equal scores of many equal vectors: the smaller ids suffice
            order = np.lexsort((ids[where], -exact, who))
            who, where, exact = who[order], where[order], exact[order]
            place = np.arange(len(who)) - np.searchsorted(who, who, "left")
            who, where, exact = who[place < top], where[place < top], exact[place < top]
        return pa.table({"query_id": pa.array(query_ids[who] if len(who) else who, pa.int64()), "vec_id": pa.array(ids[where] if len(where) else where, pa.int64()), "score": pa.array(exact, pa.float64())})

    def visit(probes: DataFrame, indexed: DataFrame, sizes: dict[str, int]) -> DataFrame:
        """(query_id, vec_id, score) of what the probes find, the best `top` of each query."""
        n_asked = {r["bucket"]: r["count"] for r in probes.groupBy("bucket").count().collect()}
        blocks = spark.createDataFrame([(b, -(-n // BLOCK), -(-n_asked[b] // BLOCK)) for b, n in sizes.items() if b in n_asked], "b string, n_rows int, n_asked int")
        block = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
        left = indexed.join(F.broadcast(blocks), F.col("bucket") == F.col("b")).withColumns({"i": block("n_rows", 1), "j": F.explode(F.sequence(F.lit(0), F.col("n_asked") - 1))})
        right = probes.join(F.broadcast(blocks), F.col("bucket") == F.col("b")).withColumns({"j": block("n_asked", 2), "i": F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1))})
        on = ["bucket", "i", "j"]
        found = left.select(*on, "id", "v").groupBy(*on).cogroup(right.select(*on, "id", "v", "least").groupBy(*on)).applyInArrow(rank, "query_id long, vec_id long, score double")
        return best(found)

    def best(found: DataFrame) -> DataFrame:
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    first = settle(queries.select("id", "v", F.lit(float("-inf")).alias("bound")).mapInArrow(probe_first, kinds))
    first = settle(visit(first, indexed, sizes))
    bound = first.where(F.col("rank") == top).select(F.col("query_id").alias("of"), F.col("score").alias("bound"))
    bounded = queries.join(bound, F.col("id") == F.col("of"), "left").select("id", "v", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
    unit_rows = {str(u): int(held[0][unit_of == u].sum()) for u in units}
    unit_names = spark.createDataFrame([(b, str(u)) for b, u in zip(names[0], unit_of.tolist(), strict=True)], "of string, unit string")
    in_units = indexed.join(F.broadcast(unit_names), F.col("bucket") == F.col("of")).select(F.col("unit").alias("bucket"), "id", "v")
    found = visit(settle(bounded.mapInArrow(probe_rest, kinds)), in_units, unit_rows)
    every_found = best(first.select("query_id", "vec_id", "score").unionByName(found.select("query_id", "vec_id", "score")))
    return every_found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def exact_search(table: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, top: int = 20) -> dict[int, list[int]]:
    """Brute force on the driver, for tests and for measuring recall on small tables."""
    rows = usable(table, key, vector).collect()
    ids, x = np.array([r["id"] for r in rows]), np.array([r["v"] for r in rows])
    out = {}
    for k in np.flatnonzero(ids % every == 0):
        s = (x * x[k]).sum(1)
        order = [i for i in np.lexsort((ids, -s)) if i != k][:top]
        out[int(ids[k])] = ids[order].tolist()
    return out
