"""SimHash near-dedup over vantage-point trees.

Fingerprints of at most RADIUS differing bits are linked, and links make components. Only distinct fingerprints are
compared; copies meet in a sum by fingerprint first. The 64 bits are read as BLOCKS blocks: fingerprints that differ in
at most RADIUS bits differ in at most RADIUS // BLOCKS bits of some block. For each block a vantage-point tree, built
from a bounded sample, deals the fingerprints out by their Hamming distance in that block. A fingerprint lives in one
leaf (the shard), and is asked in every leaf that the triangle bound can't exclude, so those near a boundary are asked
on both sides. Within a shard all asked and living fingerprints are compared exactly, over all 64 bits. Links leave a
shard as a star around the least fingerprint of each group, so their number never exceeds the rows of the shard; rounds
of large-star and small-star join the stars of all shards into components.

Texts are lower-cased (A-Z) and split into the words `[^\\x20\\x09-\\x0D]+`; a fingerprint comes from the XXH64 (seed 42)
of all their runs of `shingle` words, repeats included. Fewer words give one shingle, none (and a null) fingerprint 0,
linked like any other. A bit set in exactly half of the hashes is 0. Rows of equal doc_id are all kept; a component's id
is its least doc_id (null if it has none). Empty table: empty result. Columns other than doc_id and text are neither read
nor returned, whatever their names.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import by_bytes, documents, words, written

SHINGLE, RADIUS, BLOCKS, SEED = 3, 3, 2, 42
#: Fingerprints that the trees are built from: one of PART, but LEAST at least and SAMPLE at most (8 MB). Shards of about
#: SHARD fingerprints, so up to SHARD / 2 x SAMPLE distinct ones; rows of one comparison.
PART, LEAST, SAMPLE, SHARD, CELL = 32, 4096, 1 << 20, 2048, 8192
#: Bytes of text hashed at once.
BATCH = 2 << 20


def shingles(texts: pa.Array, size: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All words joined by single spaces; begin and end of each shingle in there, and the number of each row's first shingle (one more at the end)."""
    found, rows = words(texts)
    n = len(found)
    offsets = np.frombuffer(found.buffers()[1], dtype=np.int64)[found.offset : found.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
    each = np.diff(offsets)
    data = np.full(int(offsets[-1]) + n, 0x20, dtype=np.uint8)
    data[np.arange(int(offsets[-1])) + np.repeat(np.arange(n), each)] = np.frombuffer(found.buffers()[2], dtype=np.uint8)[: int(offsets[-1])] if n else 0
    count = np.diff(rows)
    runs = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
    first = np.zeros(len(runs) + 1, dtype=np.int64)
    np.cumsum(runs, out=first[1:])
    start = np.arange(first[-1]) - np.repeat(first[:-1], runs) + np.repeat(rows[:-1], runs)
    last = np.minimum(start + size, np.repeat(rows[1:], runs)) - 1
    return data.tobytes(), offsets[start] + start, offsets[last + 1] + last, first


def fingerprints_of(texts: pa.Array, size: int = SHINGLE) -> np.ndarray:
    import xxhash

    data, start, end, first = shingles(texts, size)
    hashed, view = xxhash.xxh64_intdigest, memoryview(data)
    h = np.fromiter((hashed(view[a:b], SEED) for a, b in zip(start.tolist(), end.tolist(), strict=True)), dtype=np.uint64, count=len(start))
    out, n = np.zeros(len(first) - 1, dtype=np.uint64), np.diff(first)
    full = np.flatnonzero(n)
    if len(full):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, first[:-1][full], axis=0, dtype=np.int32)
        out[full] = np.packbits(ones * 2 > n[full, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(df: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row of doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints_of(batch.column("text"), size).view(np.int64))], ["doc_id", "fp"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


@dataclass
class Tree:
    """A vantage-point tree over one block of the bits: node i sends what lies within reach[i] of vantage[i] to inner[i], the rest to outer[i]; a negative child is leaf -1 - child."""

    mask: int
    vantage: np.ndarray
    reach: np.ndarray
    inner: np.ndarray
    outer: np.ndarray

    @classmethod
    def built(cls, sample: np.ndarray, mask: int, leaf: int, rng: random.Random) -> Tree:
        nodes: list[list[int]] = []
        leaves = 0

        def grow(points: np.ndarray) -> int:
            nonlocal leaves
            if len(points) > leaf:
                vantage = int(points[rng.randrange(len(points))])
                far = np.bitwise_count(points ^ np.uint64(vantage))
                reach = int(np.median(far))
                if not (far > reach).any():
                    reach -= 1
                near = far <= reach
                if near.any() and not near.all():
                    me = len(nodes)
                    nodes.append([vantage, reach, 0, 0])
                    nodes[me][2] = grow(points[near])
                    nodes[me][3] = grow(points[~near])
                    return me
            leaves += 1
            return -leaves

        top = grow(sample & np.uint64(mask))
        if top < 0:
            nodes.append([0, 64, -1, -1])
        table = list(zip(*nodes, strict=True))
        return cls(mask, np.array(table[0], dtype=np.uint64), *(np.array(x, dtype=np.int64) for x in table[1:]))

    def leaves(self, fps: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
        """Which fingerprint comes to which leaf, if the triangle bound leaves a slack to both sides (0: its home)."""
        who, node = np.arange(len(fps)), np.zeros(len(fps), dtype=np.int64)
        block, done = fps & np.uint64(self.mask), []
        while len(who):
            far = np.bitwise_count(block[who] ^ self.vantage[node]).astype(np.int64)
            inside, outside = far - slack <= self.reach[node], far + slack > self.reach[node]
            who, node = np.concatenate([who[inside], who[outside]]), np.concatenate([self.inner[node[inside]], self.outer[node[outside]]])
            over = node < 0
            done.append((who[over], -1 - node[over]))
            who, node = who[~over], node[~over]
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))


def block_masks(blocks: int) -> list[int]:
    width = -(-64 // blocks)
    return [((1 << min(width, 64 - at)) - 1) << at for at in range(0, 64, width)]


def stars(living: np.ndarray, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint that is linked within one shard, and the least of its group."""
    nodes = np.unique(np.concatenate([living, asked]))
    p, q = np.searchsorted(nodes, np.unique(living)), np.searchsorted(nodes, np.unique(asked))
    root = np.arange(len(nodes))
    step = max(1, (4 << 20) // max(1, len(p)))
    for a in range(0, len(q), step):
        part = q[a : a + step]
        i, j = np.nonzero(np.bitwise_count(nodes[part][:, None] ^ nodes[p][None, :]) <= radius)
        u, v = part[i], p[j]
        left = u != v
        u, v = u[left], v[left]
        while len(u):
            u, v = root[u], root[v]
            left = u != v
            u, v = u[left], v[left]
            np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
            while (again := root[root] != root).any():
                root[again] = root[root[again]]
    linked = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[linked], nodes[root[linked]]


def links(classes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """u and v: fingerprints (column fp, distinct) of one group, enough to connect all that differ in at most radius bits."""
    spark = classes.sparkSession
    n = classes.count()
    sample = np.array([r.fp for r in classes.orderBy(F.xxhash64(F.lit(1), "fp")).limit(min(SAMPLE, max(LEAST, n // PART))).collect()], dtype=np.int64).view(np.uint64)
    slack = radius // blocks
    leaf = max(2, round(SHARD * len(sample) / max(1, n)))
    rng = random.Random(23)
    trees = spark.sparkContext.broadcast([Tree.built(sample, mask, leaf, rng) for mask in block_masks(blocks)])

    def dealt(slack: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fps = batch.column("fp").to_numpy().view(np.uint64)
                for k, tree in enumerate(trees.value):
                    who, leaves = tree.leaves(fps, slack)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), k, dtype=np.int32)), pa.array(leaves.astype(np.int32)), pa.array(fps[who].view(np.int64))], ["tree", "leaf", "fp"])

        return run

    shape = "tree int, leaf int, fp long"
    living, asked = (classes.select("fp").mapInArrow(dealt(x), shape) for x in (0, slack))
    # A row for each leaf: at most BLOCKS x SAMPLE / 2, whatever the input, and one for about SHARD fingerprints.
    size = lambda df, name: df.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / CELL).cast("int").alias(name))
    counts = F.broadcast(written(size(living, "parts").join(size(asked, "asks"), ["tree", "leaf"]), "simhash-leaves"))
    every, one = (lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))), (lambda c: F.pmod(F.xxhash64(F.lit(2), "fp"), F.col(c)).cast("int"))
    cells = ["tree", "leaf", "part", "ask"]
    left = living.join(counts, ["tree", "leaf"]).select("tree", "leaf", one("parts").alias("part"), every("asks").alias("ask"), "fp")
    right = asked.join(counts, ["tree", "leaf"]).select("tree", "leaf", every("parts").alias("part"), one("asks").alias("ask"), "fp")

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        u, v = stars(*(x.column("fp").to_numpy().view(np.uint64) for x in (a, b)), radius)
        return pa.table([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    found = left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(compare, "u long, v long")
    return written(found.distinct(), "simhash-links")


def connected(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for every node of rows u and v, by rounds of large-star and
    small-star; each round's edges are written to the shared folder."""
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "star-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "star-small")
        after = state(edges)
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after


def components(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """fp, least_id (of its own documents) and component_id for every distinct fp of rows of doc_id and fp."""
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-classes")
    of = connected(links(classes, radius, blocks)).select(F.col("node").alias("fp"), "root")
    classes = classes.join(of, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = classes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return classes.join(ids.hint("merge"), "root").select("fp", "least_id", "component_id")


def near_duplicates(df: DataFrame, size: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id for every row of doc_id and text."""
    prints = written(fingerprints(df, size), "simhash-prints")
    found = written(components(prints, radius, blocks).select("fp", "component_id"), "simhash-components")
    return prints.join(found.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
