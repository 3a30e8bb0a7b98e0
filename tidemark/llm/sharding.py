"""Sharding by best-fit-decreasing bin packing.

Groups of equal texts stay whole. They are taken by falling size, and each enters the shard whose remaining capacity is
the smallest that still holds it (the emptiest, if none does); a balanced tree over the remaining capacities finds that
shard. The capacity is the least possible one, all bytes divided by the shards, so the law `bytes` holds: shard sizes are
near equal.

Groups of one size are interchangeable, so the greedy order needs only the number of groups of each size: the driver
places runs of equal groups through the tree, exactly as one by one. There are at most sqrt(2 x all bytes) sizes, in
practice far fewer. The groups of a size are then ranked, in hash cells whose counts are added up first, and find the
run, and with it the shard, of their rank.

A group larger than a shard can't stay whole under this law; its rows are cut into pieces, each a fraction of a shard,
which are packed like groups. A null text has no bytes (size 8, crc of no bytes) and belongs with the empty texts. Rows
of equal doc_id are all kept. Ties of size are broken by the hash of the text, ties of capacity by shard number. Empty
table: empty result. Columns other than doc_id and text are neither read nor returned, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import documents, written

SHARDS = 24
OVERHEAD = 8
#: Groups of at least this part of all rows find their shard through a broadcast; there are at most so many.
HEAVY = 10_000
#: Pieces for each capacity that an oversized group holds.
PIECES = 16
#: Hash cells that a size is counted in, and rows that one bucket of a shard has at most, on average.
CELLS, BUCKET_ROWS = 64, 50_000


@dataclass
class Node:
    key: tuple[float, int]
    level: int = 1
    left: Node | None = None
    right: Node | None = None


class RemainingCapacity:
    """Shards by remaining capacity in a balanced tree (AA tree): insert, remove, tightest fit, emptiest."""

    def __init__(self) -> None:
        self.root: Node | None = None

    @staticmethod
    def _balanced(t: Node) -> Node:
        if t.left and t.left.level == t.level:  # skew
            a = t.left
            t.left, a.right, t = a.right, t, a
        if t.right and t.right.right and t.level == t.right.right.level:  # split
            b = t.right
            t.right, b.left = b.left, t
            b.level += 1
            t = b
        return t

    def insert(self, remaining: float, shard: int) -> None:
        def put(t: Node | None) -> Node:
            if t is None:
                return Node((remaining, shard))
            if (remaining, shard) < t.key:
                t.left = put(t.left)
            else:
                t.right = put(t.right)
            return self._balanced(t)

        self.root = put(self.root)

    def remove(self, remaining: float, shard: int) -> None:
        def without(t: Node | None, key: tuple[float, int]) -> Node | None:
            if t is None:
                return None
            if key < t.key:
                t.left = without(t.left, key)
            elif key > t.key:
                t.right = without(t.right, key)
            elif t.left is None or t.right is None:
                return t.left or t.right
            else:
                n = t.right
                while n.left:
                    n = n.left
                t.key = n.key
                t.right = without(t.right, n.key)
            low = min(t.left.level if t.left else 0, t.right.level if t.right else 0) + 1
            if low < t.level:
                t.level = low
                if t.right and t.right.level > low:
                    t.right.level = low
            t = self._balanced(t)
            if t.right:
                t.right = self._balanced(t.right)
            return self._balanced(t)

        self.root = without(self.root, (remaining, shard))

    def tightest(self, size: float) -> tuple[float, int] | None:
        best, t = None, self.root
        while t:
            if t.key[0] >= size:
                best, t = t.key, t.left
            else:
                t = t.right
        return best

    def emptiest(self) -> tuple[float, int]:
        t = self.root
        while t.right:
            t = t.right
        return t.key

    def place(self, size: float, most: int) -> tuple[int, int]:
        """Puts up to `most` groups of a size into the tightest shard that holds one, or else one into the emptiest: the shard, and how many."""
        remaining, shard = self.tightest(size) or self.emptiest()
        n = max(1, min(most, math.floor(remaining / size)))
        self.remove(remaining, shard)
        self.insert(remaining - n * size, shard)
        return shard, n


def runs_of(sizes: list[tuple[int, int]], shards: int, capacity: float) -> list[tuple[int, int, int, int]]:
    """Of (size, groups) rows: size, first rank, rank behind the last, and shard of each run of equal groups."""
    tree, runs = RemainingCapacity(), []
    for i in range(shards):
        tree.insert(float(capacity), i)
    for size, n in sorted(sizes, reverse=True):
        at = 0
        while at < n:
            shard, k = tree.place(size, n - at)
            runs.append((size, at, at + k, shard))
            at += k
    return runs


def pack(df: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, h (hash of the text), row (a number of its own) and shard for every row of doc_id and text."""
    spark = df.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    facts = df.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("h"))
    facts = written(facts.withColumn("row", F.monotonically_increasing_id()), "shard-facts")
    total, rows = facts.agg(F.sum("size"), F.count("*")).first()
    capacity = max(1, -(-(total or 0) // shards))
    sums = written(facts.groupBy("h").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "shard-groups")
    # Fewer than `shards` groups can be larger than a shard.
    over = sums.where(F.col("bytes") > capacity).withColumn("cuts", F.ceil(F.col("bytes") * PIECES / capacity)).select("h", "cuts")
    if over.isEmpty():
        facts, groups = facts.withColumn("piece", F.lit(0)), sums.withColumn("piece", F.lit(0))
    else:
        facts = facts.join(F.broadcast(over), "h", "left").withColumn("piece", F.when(F.col("cuts").isNull(), 0).otherwise(F.pmod(F.xxhash64("row"), F.col("cuts"))).cast("int")).drop("cuts")
        cut = facts.join(F.broadcast(over), "h", "left_semi").groupBy("h", "piece").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        groups = sums.where(F.col("bytes") <= capacity).withColumn("piece", F.lit(0)).unionByName(cut)
    groups = written(groups.select("h", "piece", "bytes", "rows", F.pmod(F.xxhash64("h", "piece"), F.lit(CELLS)).cast("int").alias("cell")), "shard-pieces")
    cells = groups.groupBy("bytes", "cell").agg(F.count("*").alias("n"))
    cells = written(cells.withColumn("before", F.sum("n").over(Window.partitionBy("bytes").orderBy("cell")) - F.col("n")), "shard-cells")
    found = cells.groupBy("bytes").agg(F.sum("n").alias("n")).toArrow()  # a row for each size
    runs = list(zip(*runs_of(list(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True)), shards, capacity), strict=True)) or [()] * 4
    kinds = {"bytes": pa.int64(), "low": pa.int64(), "high": pa.int64(), "shard": pa.int32()}
    runs = spark.createDataFrame(pa.table({name: pa.array(x, kind) for (name, kind), x in zip(kinds.items(), runs, strict=True)}))
    ranked = groups.join(cells.drop("n").hint("merge"), ["bytes", "cell"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("bytes", "cell").orderBy("h", "piece")) - 1)
    placed = written(ranked.join(runs.hint("merge"), "bytes").where("rank >= low AND rank < high").select("h", "piece", "rows", "shard"), "shard-places")
    # Groups of many rows, at most HEAVY of them, don't pass through a shuffle; no other key has more than that part of all rows.
    heavy = F.broadcast(placed.where(F.col("rows") * HEAVY >= (rows or 1)).select("h", "piece", "shard"))
    of_heavy = facts.join(heavy, ["h", "piece"])
    others = facts.join(heavy.select("h", "piece"), ["h", "piece"], "left_anti").join(placed.select("h", "piece", "shard").hint("merge"), ["h", "piece"])
    return written(of_heavy.unionByName(others).select("doc_id", "size", "text_crc32", "h", "row", "shard"), "shards")


def numbered(df: DataFrame) -> DataFrame:
    """Adds slot: rows of each shard are numbered from 0 without gaps, in hash buckets that are counted first."""
    n = df.count()
    buckets = max(64, min(65_536, n // BUCKET_ROWS))
    df = df.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h", "row"), F.lit(buckets)).cast("int"))
    counts = df.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "h", "row")
    return df.withColumn("own", F.row_number().over(inside) - 1).join(F.broadcast(before), ["shard", "bucket"]).withColumn("slot", F.col("before") + F.col("own"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = numbered(pack(documents(spark, sf_dir, "doc_id", "text")))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
