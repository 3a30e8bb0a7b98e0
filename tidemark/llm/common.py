"""Shared helpers: the shared work folder, Arrow batches of bounded bytes, word slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task holds as one batch; a longer text is a batch of its own.
BATCH_BYTES = 8 << 20

#: Bytes that separate words: space and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Byte table that lower-cases A-Z and leaves all else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, spark.checkpoint.dir; in local mode a new temporary one, if none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: later steps read it, its lineage ends here, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like written, in buckets of a key: a later join or group on it moves the other side only."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = f"tidemark_{path.rpartition('/')[2].replace('-', '_')}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return spark.table(table)


def remainder(doc_id: Column, n: int = 5) -> Column:
    """crc32 of the id as text, modulo n; an id that is null counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes of a text column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = lengths(batch.column(column))
        part = np.cumsum(sizes) // most
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))


def lengths(texts: pa.Array) -> np.ndarray:
    """Bytes of each text; a null has none."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, one after another, and the offsets of the rows (a null is empty)."""
    size = lengths(texts)
    ends = np.zeros(len(size) + 1, dtype=np.int64)
    np.cumsum(size, out=ends[1:])
    if not ends[-1]:
        return np.zeros(0, dtype=np.uint8), ends
    if texts.null_count:
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    first = int(np.frombuffer(offsets, dtype=kind)[texts.offset])
    return np.frombuffer(data, dtype=np.uint8)[first : first + int(ends[-1])], ends


def pieces(data: np.ndarray, starts: np.ndarray, end: int) -> pa.Array:
    """Slices of bytes that lie one behind another, without a copy."""
    offsets = np.append(starts, end).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words `[^\\x20\\x09-\\x0D]+` of all rows, and for each row the number of its first word (one more at the end)."""
    data, rows = flat(texts)
    if not len(data):
        return pa.array([], pa.large_binary()), np.zeros(len(rows), dtype=np.int64)
    inside = ~IS_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = rows[:-1]
    at = at[at < len(data)]
    begins[at] = inside[at]
    kept = np.flatnonzero(inside)
    place = np.cumsum(inside) - 1
    starts = place[np.flatnonzero(begins)]
    count = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(begins, out=count[1:])
    return pieces(LOWER[data[kept]], starts, len(kept)), count[rows]


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)
