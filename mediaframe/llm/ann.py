"""Operator 10: approximate nearest neighbours by an inverted file with product-quantised residuals.

Coarse centroids and the code books of residuals are fitted on a bounded sample; every row is indexed. A query
probes the lists whose centroids have the largest inner products with it, adds up its tables of inner products
with the code words (asymmetric: the query itself is not quantised), and the best candidates are reranked by the
exact measure on the original vectors. How many lists are probed is measured on the sample, against brute force.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, written

#: Rows that centroids, code books, probes and bars are fitted on, by the smallest hashes of vec_id: 16 for each list, within these bounds.
SAMPLE_ROWS, SAMPLE_MOST = 16_384, 131_072
#: Rows whose products with all centroids or with the whole sample are in memory at a time.
CHUNK = 512
#: Parts of a vector that are quantised each by itself, and code words of each.
PARTS, WORDS = 32, 256
#: Candidates of a query that are reranked exactly.
RERANK = 160
#: Share of the sample's true neighbours that the probed lists must hold.
TARGET = 0.965
#: Rows of the index, and queries, that meet in one task.
INDEX_BLOCK, QUERY_BLOCK = 8192, 8192


def valid(c: Column) -> Column:
    """Whether a vector takes part: not null, empty or zero, no null or non-finite component."""
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(c, lambda x: x != 0), F.lit(False))


def sample_rows(rows: int) -> int:
    return min(SAMPLE_MOST, max(SAMPLE_ROWS, 16 * math.isqrt(rows)))


def _chunked(f, x: np.ndarray) -> np.ndarray:
    return np.concatenate([f(x[k : k + CHUNK]) for k in range(0, max(len(x), 1), CHUNK)])


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    bias = 0.5 * (c * c).sum(1)
    return _chunked(lambda own: np.argmax(own @ c.T - bias, 1), x)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        a = _nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, a, x)
        n = np.bincount(a, minlength=len(c))
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class Index:
    """What the sample gives: centroids, code books, probes, and the sample itself for the bars of queries."""

    def __init__(self, sample: np.ndarray, rows: int, k: int, seed: int = 10) -> None:
        rng = np.random.default_rng(seed)
        self.dim, self.rows, self.sample = sample.shape[1], rows, sample
        self.width = PARTS * math.ceil(self.dim / PARTS)
        # as many lists as the root of the rows, which with the sample grow up to SAMPLE_MOST / 16
        self.centroids = _kmeans(sample, max(1, min(len(sample) // 16, math.isqrt(rows))), rng)
        rest, _ = self._directions(self._padded(sample - self.centroids[self.assign(sample)]))
        d = self.width // PARTS
        self.books = [_kmeans(rest[:, m * d : (m + 1) * d], WORDS, rng) for m in range(PARTS)]
        self.probes = self._probes(k)
        #: a candidate's score must reach the query's bar: what about RERANK rows of all are expected to reach
        self.bar_rank = min(len(sample) - 1, math.ceil(2 * RERANK * len(sample) / max(rows, 1)) + 3)

    def _padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.width - self.dim))) if self.width > self.dim else x

    def assign(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.centroids)

    @staticmethod
    def _directions(rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residuals as directions and lengths: the error of a code is in proportion to its own residual, so crowded places keep their order."""
        size = np.sqrt((rest * rest).sum(1))
        return rest / np.where(size > 0, size, 1)[:, None], size

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists, d = self.assign(x), self.width // PARTS
        rest, size = self._directions(self._padded(x - self.centroids[lists]))
        codes = [_nearest(rest[:, m * d : (m + 1) * d], b) for m, b in enumerate(self.books)]
        return lists, np.stack(codes, 1).astype(np.uint8), size.astype(np.float32)

    def _probes(self, k: int) -> int:
        q = self.sample[:256]
        near = np.argsort(-(q @ self.sample.T), 1)[:, 1 : k + 1]
        order = np.argsort(-(q @ self.centroids.T), 1)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), 1)
        need = np.sort(np.take_along_axis(rank, self.assign(self.sample)[near], 1).ravel())
        return int(need[min(len(need) - 1, int(TARGET * len(need)))]) + 1 if len(need) else len(self.centroids)

    def lists_of(self, q: np.ndarray) -> np.ndarray:
        return _chunked(lambda own: np.argsort(-(own @ self.centroids.T), 1, kind="stable")[:, : self.probes], q)

    def bars(self, q: np.ndarray) -> np.ndarray:
        at = len(self.sample) - 1 - self.bar_rank
        return _chunked(lambda own: np.partition(own @ self.sample.T, at, 1)[:, at], q)

    def scores(self, q: np.ndarray, which: int, codes: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Approximate inner products of queries with the rows of a list, from the queries' tables."""
        d, wide = self.width // PARTS, self._padded(q)
        out = np.zeros((len(q), len(codes)), np.float32)
        for m, b in enumerate(self.books):
            out += (wide[:, m * d : (m + 1) * d] @ b.T)[:, codes[:, m]]
        return out * size + (q @ self.centroids[which])[:, None]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows found nearest to each row that is a query, the largest inner product first, ties to the smaller id.

    Queries do not find themselves. Vectors that are null, empty, zero, or hold null or non-finite components, rows
    with a null id, and vectors of another size than most of the sample take no part. Rows that share an id are one item,
    which counts with its best score. A query gets fewer than k rows only where there are fewer. Other columns, whatever
    their names, are left out; an empty table gives an empty result. Vectors that are finite but outside the range of
    32-bit numbers are not in the index: they are compared one by one.
    """
    prepare(vectors.sparkSession)
    spark = vectors.sparkSession
    every = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v"), is_query.alias("q"), F.col(vec_col).cast("array<double>").alias("x"))
    every = every.where(valid(F.col("x")) & F.col("id").isNotNull())
    rows = every.where(valid(F.col("v")))
    # SAMPLE_MOST at most
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows(rows.count())).select("v").toArrow()["v"].combine_chunks()
    if not len(picked):
        dim = every.agg(F.max(F.size("x"))).first()[0]
        every = every.where(F.size("x") == F.lit(dim))
        return _named(brute(every, every.where("q").select(F.col("id").alias("query"), F.col("x").alias("qx")), k))
    sizes = np.diff(picked.offsets.to_numpy())
    dim = int(np.bincount(sizes).argmax())
    rows = rows.where(F.size("v") == dim)
    n = rows.count()
    sample = _matrix(picked.filter(pa.array(sizes == dim)), dim)
    shared = spark.sparkContext.broadcast(Index(sample, n, k))

    def index(batches):
        for b in batches:
            lists, codes, size = shared.value.encode(_matrix(b.column(1), dim)) if b.num_rows else (np.zeros(0, int), np.zeros((0, PARTS), np.uint8), np.zeros(0, np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), b.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(size, pa.float32())], ["list", "id", "code", "size"])

    def probe(batches):
        for b in batches:
            q = _matrix(b.column(1), dim)
            found, bars = (shared.value.lists_of(q), shared.value.bars(q)) if len(q) else (np.zeros((0, 1), int), np.zeros(0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.tolist(), pa.list_(pa.int32())), pa.array(bars, pa.float32()), b.column(1)], ["query", "lists", "bar", "qv"])

    def meet(key, left, right):
        ids, codes = left["id"].to_numpy(), np.frombuffer(b"".join(left["code"].to_pylist()), np.uint8).reshape(-1, PARTS)
        size = left["size"].to_numpy()
        own, bars = right["query"].to_numpy(), right["bar"].to_numpy()
        qv = _matrix(right["qv"].combine_chunks(), dim) if right.num_rows else np.zeros((0, dim), np.float32)
        out = []
        for at in range(0, len(own) if len(ids) else 0, 64):
            s = shared.value.scores(qv[at : at + 64], key[0].as_py(), codes, size)
            s[own[at : at + 64, None] == ids[None, :]] = -np.inf
            ok = s >= bars[at : at + 64, None]
            if len(ids) > RERANK:
                ok &= s >= np.partition(s, len(ids) - RERANK, 1)[:, len(ids) - RERANK][:, None]
            r, c = np.nonzero(ok & np.isfinite(s))
            out.append((own[at + r], ids[c], s[r, c]))
        cols = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)]
        return pa.table({"query": pa.array(cols[0], pa.int64()), "id": pa.array(cols[1], pa.int64()), "near": pa.array(cols[2], pa.float32())})

    coded, _ = written(rows.select("id", "v").mapInArrow(index, "list int, id long, code binary, size float"), "ivf")
    queries, _ = written(rows.where("q").select("id", "v").mapInArrow(probe, "query long, lists array<int>, bar float, qv array<float>"), "queries")
    # A long list is dealt over blocks, and so are the queries that probe it: a task holds one of each. No list meets queries that do not probe it.
    probed = queries.withColumn("list", F.explode("lists")).drop("lists")
    blocks = lambda c, size: F.ceil(F.count("*") / size).cast("int").alias(c)
    deal = coded.groupBy("list").agg(blocks("blocks", INDEX_BLOCK)).join(probed.groupBy("list").agg(blocks("asked", QUERY_BLOCK)), "list")
    deal, _ = written(deal, "lists")  # a row per list
    left = coded.join(F.broadcast(deal), "list").withColumn("blk", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("asked") - 1)))
    right = probed.join(F.broadcast(deal), "list").withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("qb", F.pmod(F.xxhash64("query"), "asked").cast("int"))
    left, right = left.drop("blocks", "asked"), right.drop("blocks", "asked")
    keys = ["list", "blk", "qb"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query long, id long, near float")
    best = met.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), "id"))).where(f"r <= {RERANK}")
    exact = F.aggregate(F.zip_with("qx", "x", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    own = rows.where("q").select(F.col("id").alias("query"), F.col("x").alias("qx"))
    scored = best.select("query", "id").join(rows.select("id", "x"), "id").join(own, "query").select("query", "id", exact.alias("score"))
    scored = scored.groupBy("query", "id").agg(F.max("score").alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(f"rank <= {k}")
    ranked, _ = written(ranked, "near")
    # The few queries whose lists or bars left them short are compared with every row, in blocks.
    items = rows.select("id").distinct().count()
    short = own.select("query").distinct().join(ranked.groupBy("query").count(), "query", "left").where(F.coalesce("count", F.lit(0)) < min(k, items - 1)).select("query")
    short, _ = written(short, "short")
    if not short.isEmpty():
        again = brute(rows, own.join(short, "query", "left_semi"), k)
        ranked = ranked.join(short, "query", "left_anti").unionByName(again)
    odd = every.where(~valid(F.col("v")) & (F.size("x") == dim))
    if not odd.isEmpty():
        asked = lambda x: x.where("q").select(F.col("id").alias("query"), F.col("x").alias("qx"))
        more = brute(odd, asked(rows), k).unionByName(brute(every.where(F.size("x") == dim), asked(odd), k))
        both = ranked.unionByName(more.withColumn("rank", F.col("rank").cast("int"))).groupBy("query", "id").agg(F.max("score").alias("score"))
        ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(f"rank <= {k}")
    return _named(ranked)


def _named(ranked: DataFrame) -> DataFrame:
    return ranked.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def brute(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, id, score, rank) of a stated set of queries against all rows: each block of rows keeps its own best k of a query."""
    blocks = 64
    deal = rows.select("id", "x", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("bigint").alias("blk"))
    asked = queries.withColumn("blk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    exact = F.aggregate(F.zip_with("qx", "x", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    s = asked.join(deal, "blk").where("id <> query").select("blk", "query", "id", exact.alias("score")).groupBy("blk", "query", "id").agg(F.max("score").alias("score"))
    order = [F.desc("score"), F.col("id")]
    s = s.withColumn("r", F.row_number().over(Window.partitionBy("blk", "query").orderBy(*order))).where(f"r <= {k}")
    s = s.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(f"rank <= {k}")
    return s.select("query", "id", "score", "rank")
