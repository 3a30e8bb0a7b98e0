"""Keeps one document of each group of near copies: texts whose sets of five-word shingles have a Jaccard similarity of
at least 0.8, and what is connected by such pairs. SimHash over vantage-point trees, as in simhash.py, with a radius wide
enough for that similarity, and an exact check.

Words are those of SimHash; a text of fewer words is one shingle, and texts without any are copies of one another. Copies
meet in a sum by the hash of their set first. A set's fingerprint has WORDS words of 64 bits. A vantage-point tree, built
from a bounded sample, deals the sets out to shards: first by their distance from the empty set, which is their size, then
by the Hamming distance of the first word from a vantage's. A set lives in one leaf and is asked in every leaf that the
triangle bound can't exclude (of sizes: those of 0.8 of its own and more; larger sets ask themselves). Within a shard all
asked and living sets are compared: at most FIRST differing bits in the first word, TWO in two and RADIUS in all make a candidate. A
pair of similarity 0.8 exceeds a bound once in 8,500 times for a set of four in one of five (the worst of the sizes tried),
once in 4 million for large sets (binomial, bits taken as independent). Connected candidates of a shard share a key; sets that share a key are compared exactly, on the
hashes of all their shingles, before they become a link. A key with many members is cut into parts, and each pair of parts
is compared. Star rounds join the links into groups. Null texts count as empty. Of a group the least doc_id stays (null
after all others; ties by the first row met); repeated rows are copies. Empty table: empty result. All columns are kept as
they are, whatever their names: a row travels as one struct beside the operator's own columns.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tidemark.llm import simhash
from tidemark.llm.common import by_bytes, words, written

SHINGLE, SEED = 5, 42
#: Least Jaccard similarity of a link, as a fraction.
LEAST = (4, 5)
#: Words of a fingerprint; most differing bits of a candidate in its first word, in its first two, and in all.
WORDS, FIRST, TWO, RADIUS = 4, 26, 44, 72
#: Sets of one shard; asked or living sets of one comparison; pairs that are compared at once.
SHARD, CELL, PAIRS = 8192, 16384, 1 << 17
#: Sets and shingles of one part of a key's members.
PART_SETS, PART_ITEMS = 1024, 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd factors for the places of a shingle, its length and the words of a fingerprint.
FACTORS = mixed(np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def sets_of(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each row's distinct shingles, ascending, and the number of each row's first (one more at the end)."""
    import xxhash

    found, rows = words(texts)
    count = np.diff(rows)
    if not len(found):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(rows), dtype=np.int64)
    column = found.dictionary_encode()
    each = np.array([xxhash.xxh64_intdigest(w, SEED) for w in column.dictionary.to_pylist()], dtype=np.uint64)
    word = np.append(each[column.indices.to_numpy(zero_copy_only=False)], np.zeros(size, dtype=np.uint64))
    runs = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
    first = np.zeros(len(runs) + 1, dtype=np.int64)
    np.cumsum(runs, out=first[1:])
    start = np.arange(first[-1]) - np.repeat(first[:-1], runs) + np.repeat(rows[:-1], runs)
    length = np.repeat(np.minimum(count, size), runs)
    h = length.astype(np.uint64) * FACTORS[-1]
    for k in range(size):
        h += np.where(k < length, mixed(word[start + k]) * FACTORS[-2 - k], np.uint64(0))
    h = mixed(h)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        h[a:b].sort()
    new = np.append(True, h[1:] != h[:-1])
    new[first[:-1][runs > 0]] = True
    kept = np.zeros(len(h) + 1, dtype=np.int64)
    np.cumsum(new, out=kept[1:])
    return h[new], kept[first]


def majority(h: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For n hashes from first on (more than none, rows lie one behind another), the bits that over half of them set. Runs of up to 255 hashes are counted in bytes, eight bits at a time."""
    runs = -(-n // 255)
    ends = np.cumsum(runs)
    begin = np.repeat(first - 255 * (ends - runs), runs) + 255 * np.arange(ends[-1])
    ones = np.empty((len(begin), 8, 8), dtype=np.uint8)
    for bit in range(8):
        ones[:, :, bit] = np.add.reduceat((h >> np.uint64(bit)) & np.uint64(0x0101010101010101), begin).view(np.uint8).reshape(-1, 8)
    total = np.add.reduceat(ones.reshape(-1, 64), ends - runs, axis=0, dtype=np.int64)
    return np.packbits(total * 2 > n[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def prints_of(items: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each row's set, and the WORDS words of its fingerprint (a row each): a bit is set that is set in over half of the shingles' hashes. Both 0 if empty."""
    n = np.diff(first)
    full = np.flatnonzero(n)
    own, prints = np.zeros(len(n), dtype=np.uint64), np.zeros((len(n), WORDS), dtype=np.uint64)
    if len(full):
        at = first[:-1][full]
        own[full] = mixed(np.add.reduceat(mixed(items), at) + n[full].astype(np.uint64))
        for k in range(WORDS):
            prints[full, k] = majority(mixed(items ^ FACTORS[k]), at, n[full])
    return own, prints


def lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64)))


@dataclass
class Tree:
    """A vantage-point tree over sets: node i sends what lies within reach[i] of its vantage to inner[i], the rest to outer[i]; a negative child is leaf -1 - child. The vantage is a fingerprint's first word (by_print) or the empty set."""

    by_print: np.ndarray
    vantage: np.ndarray
    reach: np.ndarray
    inner: np.ndarray
    outer: np.ndarray

    @classmethod
    def built(cls, size: np.ndarray, word: np.ndarray, leaf: int, rng: random.Random) -> Tree:
        nodes: list[list[int]] = []
        leaves = 0

        def grow(at: np.ndarray) -> int:
            nonlocal leaves
            if len(at) > leaf:
                n = size[at]
                by_print, vantage = LEAST[0] * int(n.max()) <= LEAST[1] * int(n.min()), 0
                if by_print:
                    vantage = int(word[at[rng.randrange(len(at))]])
                    n = np.bitwise_count(word[at] ^ np.uint64(vantage)).astype(np.int64)
                reach = int(np.median(n))
                if not (n > reach).any():
                    reach -= 1
                near = n <= reach
                if near.any() and not near.all():
                    me = len(nodes)
                    nodes.append([by_print, vantage, reach, 0, 0])
                    nodes[me][3] = grow(at[near])
                    nodes[me][4] = grow(at[~near])
                    return me
            leaves += 1
            return -leaves

        if grow(np.arange(len(size))) < 0:
            nodes.append([True, 0, 64, -1, -1])
        table = list(zip(*nodes, strict=True))
        return cls(np.array(table[0], dtype=bool), np.array(table[1], dtype=np.uint64), *(np.array(x, dtype=np.int64) for x in table[2:]))

    def leaves(self, size: np.ndarray, word: np.ndarray, asked: bool) -> tuple[np.ndarray, np.ndarray]:
        """Which set comes to which leaf: to its home, or (asked) to all where a linked set of its size or less may live."""
        who, node, done = np.arange(len(size)), np.zeros(len(size), dtype=np.int64), []
        least, slack = (-(-LEAST[0] * size // LEAST[1]), FIRST) if asked else (size, 0)
        while len(who):
            by_print, reach = self.by_print[node], self.reach[node]
            far = np.bitwise_count(word[who] ^ self.vantage[node]).astype(np.int64)
            inside, outside = np.where(by_print, far - slack, least[who]) <= reach, np.where(by_print, far + slack, size[who]) > reach
            who, node = np.concatenate([who[inside], who[outside]]), np.concatenate([self.inner[node[inside]], self.outer[node[outside]]])
            over = node < 0
            done.append((who[over], -1 - node[over]))
            who, node = who[~over], node[~over]
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))


def near(living: tuple[np.ndarray, ...], asked: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one shard's sets (fp, size, words) those with a candidate among them, their sizes, and the least fp of their group. Pairs are met at their larger set's asking."""
    fp, place = np.unique(np.concatenate([living[0], asked[0]]), return_index=True)
    size, words = (np.concatenate([x, y])[place] for x, y in zip(living[1:], asked[1:], strict=True))
    p, q = (x[np.argsort(size[x], kind="stable")] for x in (np.searchsorted(fp, y[0]) for y in (living, asked)))
    sizes, root, waiting, pairs = size[p], np.arange(len(fp)), [], 0
    low, high = np.searchsorted(sizes, -(-LEAST[0] * size[q] // LEAST[1])), np.searchsorted(sizes, size[q], "right")
    (p0, p1), (q0, q1) = (words[x, :2].T.copy() for x in (p, q))

    def fitting(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        bits = np.bitwise_count(words[u] ^ words[v]).astype(np.int64)
        return (u != v) & (size[v] <= size[u]) & (LEAST[1] * size[v] >= LEAST[0] * size[u]) & (bits[:, 0] <= FIRST) & (bits.sum(axis=1) <= RADIUS)

    def join(u: np.ndarray, v: np.ndarray) -> None:
        while len(u):
            u, v = root[u], root[v]
            left = u != v
            u, v = u[left], v[left]
            np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
            while (again := root[root] != root).any():
                root[again] = root[root[again]]

    a = 0
    while a < len(q):
        b = min(len(q), a + max(1, PAIRS // max(1, int(high[a] - low[a]))))
        c, d = int(low[a]), int(high[b - 1])
        far = np.bitwise_count(q0[a:b, None] ^ p0[None, c:d])
        far += np.bitwise_count(q1[a:b, None] ^ p1[None, c:d])
        flags = np.zeros(-(-far.size // 8) * 8, dtype=bool)
        hit = flags[: far.size].reshape(far.shape)
        np.less_equal(far, TWO, out=hit)
        # Many hits are a large group: each set joins by its first hit, and pairs within one group go.
        for _ in range(16):
            if np.count_nonzero(hit) * 8 <= far.size:
                break
            i = np.flatnonzero(hit.any(axis=1))
            j = hit[i].argmax(axis=1)
            hit[i, j] = False
            fit = fitting(q[a + i], p[c + j])
            join(q[a + i[fit]], p[c + j[fit]])
            hit &= root[q[a:b], None] != root[None, p[c:d]]
        # Few are left, so eight are tested at a time.
        at = (np.flatnonzero(flags.view(np.uint64))[:, None] * 8 + np.arange(8)).reshape(-1)
        i, j = np.divmod(at[flags[at]], max(1, d - c))
        u, v = q[a + i], p[c + j]
        left = root[u] != root[v]
        u, v = u[left], v[left]
        left = fitting(u, v)
        waiting.append((u[left], v[left]))
        pairs += int(left.sum())
        a = b
        if pairs >= PAIRS or a == len(q):
            join(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
            waiting, pairs = [], 0
    found = np.flatnonzero(np.bincount(root, minlength=len(fp))[root] > 1)
    return fp[found], size[found], fp[root[found]]


def candidates(classes: DataFrame) -> DataFrame:
    """fp, n and key of all sets with a candidate: both sets of each candidate pair have a key in common. classes: fp (distinct), n and prints."""
    spark = classes.sparkSession
    sets = classes.where("n > 0").select("fp", "n", "prints")
    count = sets.count()
    sample = sets.orderBy(F.xxhash64(F.lit(1), "fp")).limit(min(simhash.SAMPLE, max(simhash.LEAST, count // simhash.PART))).select("n", F.col("prints")[0].alias("word")).toArrow()
    leaf = max(2, round(SHARD * sample.num_rows / max(1, count)))
    tree = spark.sparkContext.broadcast(Tree.built(sample.column("n").to_numpy(), sample.column("word").to_numpy().view(np.uint64), leaf, random.Random(23)))

    def rows(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, ...]:
        prints = table.column("prints")
        prints = prints.combine_chunks() if isinstance(prints, pa.ChunkedArray) else prints
        return table.column("fp").to_numpy(), table.column("n").to_numpy(), prints.flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)

    def dealt(asked: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                _, size, words = rows(batch)
                who, leaves = tree.value.leaves(size, words[:, 0], asked)
                for a in range(0, len(who), CELL):
                    part = batch.take(pa.array(who[a : a + CELL]))
                    yield pa.RecordBatch.from_arrays([pa.array(leaves[a : a + CELL].astype(np.int32)), *part.columns], ["leaf", "fp", "n", "prints"])

        return run

    living, asked = (sets.mapInArrow(dealt(x), "leaf int, fp long, n long, prints array<long>") for x in (False, True))
    # A row for each leaf: at most SAMPLE / 2, whatever the input, and one for about SHARD sets.
    size = lambda df, name: df.groupBy("leaf").agg(F.ceil(F.count("*") / CELL).cast("int").alias(name))
    counts = F.broadcast(written(size(living, "parts").join(size(asked, "asks"), "leaf"), "dedup-leaves"))
    every, one = (lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))), (lambda c: F.pmod(F.xxhash64(F.lit(2), "fp"), F.col(c)).cast("int"))
    cells, own = ["leaf", "part", "ask"], ["fp", "n", "prints"]
    left = living.join(counts, "leaf").select("leaf", one("parts").alias("part"), every("asks").alias("ask"), *own)
    right = asked.join(counts, "leaf").select("leaf", every("parts").alias("part"), one("asks").alias("ask"), *own)

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        return pa.table([pa.array(x) for x in near(rows(a), rows(b))], names=["fp", "n", "key"])

    found = left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(compare, "fp long, n long, key long")
    return written(found.distinct(), "dedup-candidates")


def linked(items: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each set, the number of the first one of its group, if those of similarity LEAST and more are linked."""
    codes = np.unique(items, return_inverse=True)[1].reshape(-1)
    n, group = np.diff(first), np.arange(len(first) - 1)
    mark = np.zeros(len(items), dtype=bool)
    for i in range(len(n)):
        low, high = np.minimum(n, n[i]), np.maximum(n, n[i])
        others = np.flatnonzero((group != group[i]) & (LEAST[1] * low >= LEAST[0] * high))
        others = others[others > i]
        if not len(others):
            continue
        mark[codes[first[i] : first[i + 1]]] = True
        size = n[others]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(first[:-1][others] - ends + size, size)
        both = np.add.reduceat(mark[codes[at]], ends - size, dtype=np.int64)
        mark[codes[first[i] : first[i + 1]]] = False
        for j in np.unique(group[others[LEAST[1] * both >= LEAST[0] * (size + n[i] - both)]]):
            a, b = sorted((int(group[i]), int(j)))
            group[group == b] = a
    return group


def links(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """u and v: set hashes (column fp) of one group, enough to connect all similar pairs among the candidates. rows: own_row and doc; classes: fp, row, n and prints."""
    keys = candidates(classes)
    seal = F.bit_xor(F.xxhash64(F.lit(4), "fp")).alias("seal")
    shared = keys.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("items"), seal).where("m > 1")
    shared = shared.groupBy("m", "items", "seal").agg(F.min("key").alias("key"))
    parts = F.ceil(F.greatest(F.col("m") / PART_SETS, F.col("items") / PART_ITEMS)).cast("int").alias("parts")
    members = written(keys.select("fp", "key").join(shared.select("key", parts).hint("merge"), "key"), "dedup-members")
    needed = members.select("fp").distinct().join(classes.select("fp", "row").hint("merge"), "fp")
    texts = rows.select(F.col("own_row").alias("row"), F.col("doc.text").alias("text")).join(needed.hint("merge"), "row").select("fp", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", simhash.BATCH):
            yield pa.RecordBatch.from_arrays([batch.column("fp"), lists(*sets_of(batch.column("text")))], ["fp", "items"])

    found = written(texts.mapInArrow(sets, "fp long, items array<long>"), "dedup-sets")
    own = F.pmod(F.xxhash64(F.lit(6), "fp"), F.col("parts")).cast("int")
    other = F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("parts") - 1), F.col("own"))))
    cells = members.withColumn("own", own).withColumn("other", other).select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")

    def compare(cell: pa.Table) -> pa.Table:
        fps, items = cell.column("fp").to_numpy(), cell.column("items").combine_chunks()
        first = np.append(0, np.cumsum(items.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
        group = linked(items.flatten().to_numpy().view(np.uint64), first)
        joined = np.flatnonzero(group != np.arange(len(group)))
        return pa.table([pa.array(fps[joined]), pa.array(fps[group[joined]])], names=["u", "v"])

    pairs = cells.join(found.hint("merge"), "fp").groupBy("key", "a", "b").applyInArrow(compare, "u long, v long")
    return written(pairs.distinct(), "dedup-links")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, that hold the least doc_id of their component; of rows with equal
    doc_id, and of components without one, a single row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 40
        for batch in by_bytes(batches, "text", simhash.BATCH):
            items, first = sets_of(batch.column("text"))
            own, prints = prints_of(items, first)
            prints = lists(prints.reshape(-1), np.arange(len(own) + 1) * WORDS)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(own.view(np.int64)), pa.array(np.arange(at, at + batch.num_rows)), pa.array(np.diff(first)), prints], ["doc", "own_fp", "own_row", "own_n", "own_prints"])
            at += batch.num_rows

    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("text"))
    shape = StructType([StructField("doc", docs.schema), *(StructField(f"own_{c}", LongType()) for c in ("fp", "row", "n")), StructField("own_prints", ArrayType(LongType()))])
    rows = written(whole.mapInArrow(run, shape), "dedup-rows")
    doc_id = F.col("doc.doc_id")
    best = F.min(F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), "own_row")).alias("best")
    same = [F.min("own_row").alias("row"), F.any_value("own_n").alias("n"), F.any_value("own_prints").alias("prints")]
    classes = written(rows.groupBy(F.col("own_fp").alias("fp")).agg(best, *same), "dedup-classes")
    roots = simhash.connected(links(rows, classes)).select(F.col("node").alias("fp"), "root")
    kept = classes.select("fp", "best").join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("best").alias("best"))
    return rows.join(kept.select(F.col("best.own_row").alias("own_row")).hint("merge"), "own_row", "left_semi").select("doc.*")
