"""Delta-of-delta and XOR compression of samples, as analytics over a table: exact sizes, encoded blocks, and back.

A block holds samples of one series and one span, BLOCK_SAMPLES at most, so a group always fits into its task. The
timestamps' cost needs no coder: it is an expression over two lags.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.samples import zigzag
from tidemark.operators.catalog import split_blocks

#: Fixed values of the format: bits of a zigzag delta of deltas after its prefix; the first sample's bits.
STEPS = ((8, "10", 9), (12, "110", 12), (32, "1110", 32), (64, "1111", 64))
FIRST_BITS = 64
LEAD_BITS, SIZE_BITS, MOST_LEAD = 5, 6, 31


def cost_of(dod: Column) -> Column:
    """Bits of one timestamp: null is a block's first."""
    z = zigzag(dod)
    return F.when(dod.isNull(), FIRST_BITS).when(dod == 0, 1).when(F.shiftrightunsigned(z, 8) == 0, 11).when(F.shiftrightunsigned(z, 12) == 0, 15).when(F.shiftrightunsigned(z, 32) == 0, 36).otherwise(68)


def timestamp_bits(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Bits that the timestamps of each group of keys take. The first delta is compared with 0."""
    w = Window.partitionBy(*keys).orderBy("t", "seq")
    deltas = samples.select(*keys, "t", "seq", (F.col("t") - F.lag("t").over(w)).alias("delta"))
    dods = deltas.withColumn("dod", F.col("delta") - F.coalesce(F.lag("delta").over(w), F.lit(0)))
    return dods.groupBy(*keys).agg(F.sum(cost_of(F.col("dod"))).cast("long").alias("ts_bits"))


class Bits:
    """Bits in the order they are written, as text of 0 and 1 until the end."""

    def __init__(self) -> None:
        self.parts: list[str] = []

    def put(self, value: int, n: int) -> None:
        self.parts.append(format(value, f"0{n}b"))

    def data(self) -> bytes:
        text = "".join(self.parts)
        text += "0" * (-len(text) % 8)
        return int(text or "0", 2).to_bytes(len(text) // 8, "big")


def encode(t: np.ndarray, v: np.ndarray) -> bytes:
    """A block's samples, in order."""
    raw = v.astype(">f8").view(">u8").astype(np.uint64)
    bits = Bits()
    bits.put(int(t[0]) & (2**64 - 1), 64)
    bits.put(int(raw[0]), 64)
    delta = np.diff(t)
    dods = np.diff(delta, prepend=0) if len(delta) else delta
    window: tuple[int, int] | None = None  # leading zeros, and zeros behind
    for dod, x in zip(dods.tolist(), (raw[1:] ^ raw[:-1]).tolist(), strict=True):
        if dod == 0:
            bits.parts.append("0")
        else:
            z = (dod << 1) ^ (dod >> 63)
            top, prefix, n = next(s for s in STEPS if z < 1 << s[0] or s[0] == 64)
            bits.parts.append(prefix)
            bits.put(z & (2**64 - 1), n)
        if x == 0:
            bits.parts.append("0")
            continue
        lead, behind = min(64 - x.bit_length(), MOST_LEAD), (x & -x).bit_length() - 1
        if window and lead >= window[0] and behind >= window[1]:
            bits.parts.append("10")
            lead, behind = window
        else:
            bits.parts.append("11")
            window = lead, behind
        size = 64 - lead - behind
        bits.put(lead, LEAD_BITS)
        bits.put(size & 63, SIZE_BITS)  # 64 doesn't fit and is written as 0
        bits.put(x >> behind, size)
    return bits.data()


def decode(data: bytes, count: int) -> tuple[np.ndarray, np.ndarray]:
    text = format(int.from_bytes(data, "big"), f"0{8 * len(data)}b") if data else ""
    at = 0

    def take(n: int) -> int:
        nonlocal at
        if at + n > len(text):
            raise EOFError("the block ends within a sample")
        at += n
        return int(text[at - n : at], 2) if n else 0

    ts, raw, delta = [], [], 0
    for i in range(count):
        if i == 0:
            first = take(64)
            ts.append(first - (1 << 64) if first >> 63 else first)
            raw.append(take(64))
            continue
        ones = 0
        while ones < 4 and take(1):
            ones += 1
        z = take(STEPS[ones - 1][2]) if ones else 0
        delta += (z >> 1) ^ -(z & 1)
        ts.append(ts[-1] + delta)
        x = 0
        if take(1):
            take(1)  # a window used again is written again
            lead, size = take(LEAD_BITS), take(SIZE_BITS) or 64
            x = take(size) << (64 - lead - size)
        raw.append(raw[-1] ^ x)
    return np.array(ts, dtype=np.int64), np.array(raw, dtype=np.uint64).view(np.float64)


def blocks(samples: DataFrame) -> DataFrame:
    """series, block_base, part, min_ts, max_ts, count, size and payload of every block. Rows come to a task in order of
    block and time, so a task reads them once and holds one block at a time."""
    kinds = {"series": pa.string(), "block_base": pa.int64(), "part": pa.int32(), "min_ts": pa.int64(), "max_ts": pa.int64(), "count": pa.int32(), "size": pa.int32(), "payload": pa.binary()}
    keys = ["series", "block_base", "part"]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    def row(key: tuple, t: list[np.ndarray], v: list[np.ndarray]) -> tuple:
        t, v = np.concatenate(t), np.concatenate(v)
        data = encode(t, v)
        return *key, int(t.min()), int(t.max()), len(t), len(data), data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, t, v = None, [], []
        for batch in batches:
            done = []
            names, bases, parts = (batch.column(c).to_pylist() for c in keys)
            ts, vs = batch.column("t").to_numpy(), batch.column("v").to_numpy()
            at = 0
            while at < len(ts):
                now, end = (names[at], bases[at], parts[at]), at + 1
                while end < len(ts) and (names[end], bases[end], parts[end]) == now:
                    end += 1
                if now != key:
                    if key is not None:
                        done.append(row(key, t, v))
                    key, t, v = now, [], []
                t.append(ts[at:end])
                v.append(vs[at:end])
                at = end
            if done:
                yield packed(done)
        if key is not None:
            yield packed([row(key, t, v)])

    cut = split_blocks(samples.select("series", "block_base", "t", "v", "seq"))
    in_order = cut.repartition("series", "block_base").sortWithinPartitions("series", "block_base", "part", "t", "seq")
    return in_order.select(*keys, "t", "v").mapInArrow(run, "series string, block_base long, part int, min_ts long, max_ts long, count int, size int, payload binary")


def samples_of(encoded: DataFrame) -> DataFrame:
    """series, t and v of all blocks, and the order in the block as seq."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch.column("count").to_pylist()
            if counts:
                t, v = zip(*map(decode, batch.column("payload").to_pylist(), counts), strict=True)
                names = batch.column("series").take(pa.array(np.repeat(np.arange(len(counts)), counts)))
                yield pa.RecordBatch.from_arrays([names, pa.array(np.concatenate(t)), pa.array(np.concatenate(v)), pa.array(np.concatenate([np.arange(n) for n in counts]))], ["series", "t", "v", "seq"])

    return encoded.select("series", "count", "payload").mapInArrow(run, "series string, t long, v double, seq long")


def report(encoded: DataFrame) -> DataFrame:
    """Bytes a sample, and how many times smaller than 16 bytes a sample is that, for each series."""
    sums = encoded.groupBy("series").agg(F.sum("count").alias("samples"), F.sum("size").alias("bytes"))
    return sums.withColumn("bytes_per_sample", F.col("bytes") / F.col("samples")).withColumn("ratio", F.col("samples") * 16 / F.col("bytes"))


