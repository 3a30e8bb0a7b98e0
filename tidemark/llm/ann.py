"""Approximate nearest neighbours by adaptive dimension scan.

A last component that gives all vectors the same length turns the largest inner product into the smallest distance.
k-means on a bounded sample makes lists; every row enters the list of its centre. A query visits the lists whose centres
are nearest, as many as the sample needs for RECALL. In a list, vectors are turned by a random rotation and read in
blocks of columns: after each block a hypothesis test on the distance so far abandons the candidates that are beyond the
query's bound. The bound begins as the query's k-th nearest vec_id in a small sample (one row of each vec_id, so no
worse than its true k-th) and tightens with what the list itself has given; the FIRST nearest lists are scanned before
the others, which begin with the bound that those have given. Survivors are scored exactly, in double precision, on the
original vectors. All answers come from the lists, whatever the size of the table.

Large lists and large sets of queries are split into chunks, so no task holds more than POINTS rows and QUERIES queries;
each chunk sends on at most K rows for each of its queries.
Vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part, nor
do rows without vec_id. Rows of one vec_id count once, with the best score; a query of several rows takes the least
vector. Equal scores rank by vec_id, smaller first. Empty table: empty result. Columns other than vec_id and embedding
are neither read nor returned, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

K, EVERY = 20, 20
#: Rows that centres and the number of visited lists are fitted on, queries among them, and rows that first bounds come from.
SAMPLE, TUNING, BOUNDS = 16_384, 256, 1024
#: Lists at most, rows of the sample for each of them at least, and lists that are scanned before the others.
LISTS, LEAST, FIRST = 1024, 16, 8
RECALL = 0.97
#: Columns of a block; the test's width: larger abandons later and errs less.
COLUMNS, EPSILON = 16, 2.4
POINTS, QUERIES = 32_768, 8192
#: Pairs of a query and a row looked at together, and rows of a list after which bounds tighten.
PAIRS, STEP = 2_000_000, 1024


def valid(vector: Column, dims: int) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (F.size(vector) == dims) & ~odd & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


class Index:
    """What is fitted: centres, rotation, the common length, visited lists, and the rows for first bounds."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, longest: float, n: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.longest, self.ids, self.rows = longest, ids[:BOUNDS], rows[:BOUNDS]
        dims = rows.shape[1] + 1
        self.rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        full = self.full(rows)
        lists = int(max(1, min(LISTS, len(rows) // LEAST, np.sqrt(n))))
        self.centres = full[rng.choice(len(full), lists, replace=False)]
        for _ in range(8):
            home = self.near(full, 1)[:, 0]
            count = np.bincount(home, minlength=lists)
            sums = np.zeros_like(self.centres)
            np.add.at(sums, home, full)
            self.centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], self.centres)
        self.visits = self._visits(rows, full, rng)

    def _visits(self, rows: np.ndarray, full: np.ndarray, rng: np.random.Generator) -> int:
        """The least number of lists that gives RECALL within the sample."""
        pick = rng.choice(len(full), min(TUNING, len(full)), replace=False)
        score = rows[pick] @ rows.T
        score[np.arange(len(pick)), pick] = -np.inf
        k = min(K, len(rows))
        best = np.argpartition(-score, k - 1, axis=1)[:, :k]
        home = self.near(full, 1)[:, 0]
        order = self.near(self.full(rows[pick], query=True), len(self.centres))
        rank = np.argsort(order, axis=1)
        seen = np.bincount(np.take_along_axis(rank, home[best], axis=1).ravel(), minlength=len(self.centres)).cumsum()
        return int(np.searchsorted(seen, RECALL * seen[-1])) + 1

    def full(self, rows: np.ndarray, query: bool = False) -> np.ndarray:
        """With the last component: what is missing to the common length, or 0 for a query."""
        rest = np.zeros(len(rows)) if query else np.sqrt(np.maximum(0, self.longest**2 - (rows**2).sum(1)))
        return np.column_stack([rows, rest])

    def near(self, full: np.ndarray, n: int) -> np.ndarray:
        far = (self.centres**2).sum(1) - 2 * full @ self.centres.T
        return far.argmin(1)[:, None] if n == 1 else np.argsort(far, axis=1, kind="stable")[:, :n]

    def bounds(self, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Each query's K-th best score within the small sample, without itself; -inf if that has fewer."""
        out = np.full(len(rows), -np.inf)
        if len(self.rows) > K:
            for a in range(0, len(rows), 1024):
                score = rows[a : a + 1024] @ self.rows.T
                score[ids[a : a + 1024, None] == self.ids[None, :]] = -np.inf
                out[a : a + 1024] = np.partition(score, -K, axis=1)[:, -K]
        # A little less, so that no rounding shuts out the k-th itself.
        return np.where(np.isfinite(out), out - 1e-12 * (1 + np.abs(out)), out)

    def scan(self, ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Query number, row number and score of what survives in one list, the K best vec_ids of each query, and how many candidates were abandoned before their last column."""
        points, asked = self.full(rows) @ self.rotation, self.full(queries, query=True) @ self.rotation
        bound, abandoned, done = bound.copy(), 0, []
        step = max(1, PAIRS // STEP)
        for a in range(0, len(queries), step):
            own = slice(a, min(a + step, len(queries)))
            found = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
            for b in range(0, len(points), STEP):
                qi, pi, lost = self.survivors(points[b : b + STEP], asked[own], self.most(queries[own], bound[own]))
                abandoned += lost
                qi, pi = qi + a, pi + b
                left = ids[pi] != query_ids[qi]
                qi, pi = qi[left], pi[left]
                score = np.einsum("ij,ij->i", queries[qi], rows[pi])
                left = score >= bound[qi]
                new = qi[left], pi[left], score[left]
                found = self.best(*(np.concatenate(x) for x in zip(found, new, strict=True)), ids)
                # Where K vec_ids are known, the last of them is the new bound.
                full = np.flatnonzero(np.diff(np.append(found[0], -1)) != 0)
                full = full[full >= K - 1]
                full = full[found[0][full - K + 1] == found[0][full]]
                bound[found[0][full]] = np.maximum(bound[found[0][full]], found[2][full])
            done.append(found)
        return *(np.concatenate(x) for x in zip(*done, strict=True)), abandoned

    def most(self, queries: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The distance, squared, that a score of the bound stands for."""
        most = (queries**2).sum(1) + self.longest**2 - 2 * bound
        return most + np.where(np.isfinite(most), 1e-9 * (1 + np.abs(most)), 0)

    def survivors(self, points: np.ndarray, asked: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Numbers of the queries and points that no test has abandoned, and how many pairs the tests have."""
        dims = points.shape[1]
        width = min(COLUMNS, dims)
        q, p = asked[:, :width], points[:, :width]
        far = (q**2).sum(1)[:, None] + (p**2).sum(1)[None, :] - 2 * q @ p.T
        qi, pi = np.nonzero(far <= self.limit(most, width, dims)[:, None])
        far, abandoned = far[qi, pi], far.size - len(qi) if width < dims else 0
        while width < dims and len(qi):
            block = slice(width, width := min(width + COLUMNS, dims))
            far = far + ((asked[qi, block] - points[pi, block]) ** 2).sum(1)
            left = far <= self.limit(most, width, dims)[qi]
            if width < dims:
                abandoned += int((~left).sum())
            qi, pi, far = qi[left], pi[left], far[left]
        return qi, pi, abandoned

    @staticmethod
    def best(qi: np.ndarray, pi: np.ndarray, score: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The K best vec_ids of each query, best first, a row of each."""
        order = np.lexsort((-score, ids[pi], qi))
        qi, pi, score = qi[order], pi[order], score[order]
        # Of the rows of a vec_id the best one.
        left = np.append(True, (np.diff(qi) != 0) | (np.diff(ids[pi]) != 0))[: len(qi)]
        qi, pi, score = qi[left], pi[left], score[left]
        order = np.lexsort((ids[pi], -score, qi))
        qi, pi, score = qi[order], pi[order], score[order]
        left = np.arange(len(qi)) - np.searchsorted(qi, qi) < K
        return qi[left], pi[left], score[left]

    @staticmethod
    def limit(most: np.ndarray, width: int, dims: int) -> np.ndarray:
        """The partial distance beyond which a candidate is abandoned; exact when all columns are read."""
        return most if width == dims else most * (1 + EPSILON / np.sqrt(width)) ** 2 * width / dims


def nearest(df: DataFrame, is_query: Callable[[Column], Column] = lambda c: F.pmod(c, F.lit(EVERY)) == 0) -> DataFrame:
    """query_id, rank, vec_id and score of rows of vec_id and embedding, for the rows that is_query names."""
    spark = df.sparkSession
    shape = "query_id long, rank int, vec_id long, score double"
    usual = df.where("embedding IS NOT NULL AND size(embedding) > 0").groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if usual is None:
        return spark.createDataFrame([], shape)
    dims = usual.dims
    df = df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & valid(F.col("embedding"), dims))
    n, ids_known, longest = df.agg(F.count("*"), F.countDistinct("vec_id"), F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)))).first()
    if not n:
        return spark.createDataFrame([], shape)
    # One row of each of at most SAMPLE vec_ids: a bound from several rows of one vec_id would shut out right neighbours.
    chosen = df.select("vec_id").distinct().orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id").limit(SAMPLE)
    got = df.join(F.broadcast(chosen), "vec_id").groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id").toArrow()
    ids, rows = got.column("vec_id").to_numpy(), matrix(got.column("embedding").combine_chunks(), dims)
    index = spark.sparkContext.broadcast(Index(ids, rows, longest * (1 + 1e-12), n))
    visits = index.value.visits

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                home = index.value.near(index.value.full(matrix(batch.column("embedding"), dims)), 1)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), *batch.columns], ["list", "vec_id", "embedding"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = matrix(batch.column("embedding"), dims)
                lists = index.value.near(index.value.full(rows, query=True), visits).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("embedding"), pa.array(index.value.bounds(batch.column("vec_id").to_numpy(), rows)), pa.array(list(lists))], ["vec_id", "embedding", "bound", "lists"])

    points = written(df.mapInArrow(homes, "list int, vec_id long, embedding array<double>"), "ann-points")
    queries = df.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    queries = written(queries.mapInArrow(asked, "vec_id long, embedding array<double>, bound double, lists array<int>"), "ann-queries")
    first = nearest_in_lists(index, points, queries.withColumn("lists", F.slice("lists", 1, FIRST)), dims)
    reached = first.where(F.col("rank") == K).select(F.col("query_id").alias("vec_id"), F.col("score").alias("reached"))
    rest = queries.where(F.size("lists") > FIRST).join(reached.hint("merge"), "vec_id", "left")
    rest = rest.select("vec_id", "embedding", F.greatest("bound", "reached").alias("bound"), F.slice("lists", FIRST + 1, len(index.value.centres)).alias("lists"))
    found = written(best_of(first.unionByName(nearest_in_lists(index, points, written(rest, "ann-rest"), dims))), "ann-found")
    # The lists of a few queries may hold fewer than K rows within the bound: those queries visit all lists, without one.
    known = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"))
    short = queries.join(known, "vec_id", "left").where(F.coalesce("n", F.lit(0)) < min(K, ids_known - 1)).select("vec_id", "embedding")
    every = F.sequence(F.lit(0), F.lit(len(index.value.centres) - 1))
    short = written(short.withColumns({"bound": F.lit(float("-inf")), "lists": every}), "ann-short")
    if not short.isEmpty():
        again = nearest_in_lists(index, points, short, dims)
        found = found.join(short.select(F.col("vec_id").alias("query_id")).hint("merge"), "query_id", "left_anti").unionByName(again)
    return found.select("query_id", "rank", "vec_id", "score")


def nearest_in_lists(index: Broadcast, points: DataFrame, queries: DataFrame, dims: int) -> DataFrame:
    """query_id, rank, vec_id and score: the K best that the scan of its lists finds for each query (vec_id, embedding, bound, lists)."""
    # A row for each list, and there are at most LISTS.
    sizes = points.groupBy("list").agg(F.count("*").alias("n"))
    visitors = queries.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count("*").alias("m"))
    chunks = F.broadcast(sizes.join(visitors, "list").select("list", F.ceil(F.col("n") / POINTS).cast("int").alias("parts"), F.ceil(F.col("m") / QUERIES).cast("int").alias("asks")))
    part = lambda n: F.pmod(F.xxhash64(F.lit(9), "vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cells = ["list", "part", "ask"]
    left = points.join(chunks, "list").select("list", part("parts").alias("part"), every("asks").alias("ask"), "vec_id", "embedding")
    right = queries.withColumn("list", F.explode("lists")).join(chunks, "list").select("list", every("parts").alias("part"), part("asks").alias("ask"), "vec_id", "embedding", "bound")

    def scan(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        ids, asks = a.column("vec_id").to_numpy(), b.column("vec_id").to_numpy()
        qi, pi, score, _ = index.value.scan(ids, matrix(a.column("embedding").combine_chunks(), dims), asks, matrix(b.column("embedding").combine_chunks(), dims), b.column("bound").to_numpy())
        return pa.table([pa.array(asks[qi]), pa.array(ids[pi]), pa.array(score)], names=names)

    found = left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(scan, "query_id long, vec_id long, score double")
    return written(best_of(found), "ann-lists")


def best_of(found: DataFrame) -> DataFrame:
    """The K best vec_ids of each query, with their rank."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= K).select("query_id", "rank", "vec_id", "score")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
