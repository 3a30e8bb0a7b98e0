"""Media columns: payloads in tar shards, addressed by their content.

A text's bytes, padded with 255 to a multiple of UNIT, are the samples of an 8-bit grey image of UNIT columns, stored
without loss as PNG. Each distinct content is stored once: digests are taken first, the 32 bytes of each are shuffled to
choose one owner (a scan task and its row) for each content, and a second scan stores what its task owns. Texts and images
never pass through a shuffle. Rows carry digest, shard, offset and length; all rows of one digest share one location.
Metadata columns come from range reads of the image header alone; features from the whole range, read back and unpacked.

Shards lie in the folder that the cluster shares, under names that no second attempt of a task uses again, so the rows
of the attempt that counts always name whole files; the files of a lost attempt stay behind, without rows. The tables of
digests, owners and locations are written once and read from there. Both scans must deal the rows out alike, as scans of
files do; digests are taken anew while storing, and a content that is missing or stored twice raises an error.

A null text is empty; rows of equal doc_id are all kept. Equal texts share a location; which row of them owns it is
fixed by task and row number. Empty table: empty result. Columns other than doc_id and text are neither read nor
returned, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import by_bytes, documents, flat, new_path, written

UNIT, PAD = 576, 255
#: A shard of more bytes is closed and a new one begun.
SHARD_BYTES = 1 << 30
LEVEL = 6
#: Bytes of images that one task reads back, about.
READ_BYTES = 64 << 20
#: The signature of PNG, and the bytes up to the end of its header chunk.
SIGNATURE, HEADER_BYTES = b"\x89PNG\r\n\x1a\n", 33
TAR_BLOCK = 512


def payload(text: np.ndarray) -> bytes:
    data = text.tobytes()
    return data + bytes([PAD]) * (-len(data) % UNIT or (0 if data else UNIT))


def to_png(data: bytes) -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    height = len(data) // UNIT
    lines = np.zeros((height, UNIT + 1), dtype=np.uint8)  # a filter byte of 0 before each line
    lines[:, 1:] = np.frombuffer(data, dtype=np.uint8).reshape(height, UNIT)
    head = struct.pack(">IIBBBBB", UNIT, height, 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines, LEVEL)) + chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample, from the first HEADER_BYTES bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("the bytes at this place are no image of the kind stored here")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> bytes:
    width, height, _ = png_header(data)
    at, body = HEADER_BYTES, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(data[at + 4 : at + 8 + size]):
            raise ValueError("a chunk of the stored image is damaged")
        if kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("the stored image has filtered lines")
    return lines[:, 1:].tobytes()


def feature(data: bytes) -> str:
    """Sum and sum of squares of the samples, least and largest, and how many lie in each sixteenth of the range."""
    x = np.frombuffer(data, dtype=np.uint8)
    bins = np.bincount(x >> 4, minlength=16)
    count = np.bincount(x, minlength=256)
    level = np.arange(256)
    return f"sum={int(count @ level)};squares={int(count @ level**2)};range={x.min()}-{x.max()};bins={','.join(map(str, bins.tolist()))}"


class Shard:
    """A tar file that is written front to back; `put` gives offset and length of a member's bytes."""

    def __init__(self, folder: str):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}.tar"
        self.file, self.at = system.open_output_stream(f"{path}/{self.name}"), 0

    def put(self, name: str, data: bytes) -> tuple[int, int]:
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.file.write(head + data + bytes(-len(data) % TAR_BLOCK))
        offset = self.at + len(head)
        self.at = offset + len(data) + -len(data) % TAR_BLOCK
        return offset, len(data)

    def close(self) -> None:
        self.file.write(bytes(2 * TAR_BLOCK))
        self.file.close()


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes, digest (SHA-256 of the payload), task and row (its number in the task) for every row of doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, at = TaskContext.get().partitionId(), 0
        for batch in by_bytes(batches, "text"):
            data, rows = flat(batch.column("text"))
            each = [hashlib.sha256(payload(data[a:b])).digest() for a, b in zip(rows[:-1], rows[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(rows)), pa.array(each, pa.binary()), pa.array(np.full(len(each), task, dtype=np.int32)), pa.array(np.arange(at, at + len(each)))], ["doc_id", "n_bytes", "digest", "task", "row"])
            at += len(each)

    return written(df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, digest binary, task int, row long"), "media-digests")


def owned(folder: str, task: int) -> np.ndarray:
    """The rows that a task owns, ascending; at most those of its own scan."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(f"{folder}/task={task}")
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return np.sort(np.concatenate([np.zeros(0, dtype=np.int64), *(pq.read_table(f.path, filesystem=system, columns=["row"], partitioning=None).column("row").to_numpy() for f in found if f.path.endswith(".parquet"))]))


def store(df: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(rows, places): doc_id, n_bytes and digest of every row of doc_id and text; digest, shard, offset and length of every content."""
    spark = df.sparkSession
    rows = digests(df)
    owners = rows.groupBy("digest").agg(F.min(F.struct("task", "row")).alias("o")).select("o.*")
    place = new_path(spark, "media-owners")
    owners.repartition("task").write.partitionBy("task").parquet(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        mine, at, shard = owned(place, TaskContext.get().partitionId()), 0, None
        for batch in by_bytes(batches, "text"):
            data, cuts = flat(batch.column("text"))
            here = mine[np.searchsorted(mine, at) : np.searchsorted(mine, at + batch.num_rows)] - at
            out = []
            for i in here.tolist():
                whole = payload(data[cuts[i] : cuts[i + 1]])
                digest = hashlib.sha256(whole).digest()
                if shard is not None and shard.at > SHARD_BYTES:
                    shard.close()
                    shard = None
                shard = shard or Shard(folder)
                out.append((digest, shard.name, *shard.put(f"{digest.hex()}.png", to_png(whole))))
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.binary(), pa.string(), pa.int64(), pa.int64()))], ["digest", "shard", "offset", "length"])
        if shard is not None:
            shard.close()

    places = written(df.select("doc_id", "text").mapInArrow(run, "digest binary, shard string, offset long, length long"), "media-places")
    seal = [F.count("*"), F.bit_xor(F.xxhash64("digest"))]
    if tuple(places.agg(*seal).first()) != tuple(rows.select("digest").distinct().agg(*seal).first()):
        raise RuntimeError("the two scans of the table have dealt its rows out differently; write the table first")
    return rows.select("doc_id", "n_bytes", "digest"), places


def in_order(places: DataFrame) -> DataFrame:
    """The locations in ranges of about READ_BYTES of images, each in the order of its files."""
    size = places.agg(F.sum("length")).first()[0] or 0
    n = max(int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // READ_BYTES))
    return places.repartitionByRange(n, "shard", "offset").sortWithinPartitions("shard", "offset")


class Reader:
    def __init__(self, folder: str):
        from pyarrow import fs

        self.system, self.path = fs.FileSystem.from_uri(folder)
        self.name, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            if self.file:
                self.file.close()
            self.name, self.file = shard, self.system.open_input_file(f"{self.path}/{shard}")
        return self.file.read_at(length, offset)


def metadata(places: DataFrame, folder: str) -> DataFrame:
    """digest, width, height, bits: range reads of the header alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder)
        for batch in batches:
            heads = [png_header(reader.read(s, o, HEADER_BYTES)) for s, o in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), *(pa.array([h[i] for h in heads], pa.int32()) for i in range(3))], ["digest", "width", "height", "bits"])

    return places.mapInArrow(run, "digest binary, width int, height int, bits int")


def features(places: DataFrame, folder: str) -> DataFrame:
    """What the stored bytes give when they are read back: a row for each digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder)
        for batch in batches:
            out = []
            for digest, shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length")), strict=True):
                width, height, bits = png_header(reader.read(shard, offset, HEADER_BYTES))
                stored = reader.read(shard, offset, length)
                data = from_png(stored)
                out.append((digest, width, height, bits, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(data)))
            kinds = {"digest": pa.binary(), "width": pa.int32(), "height": pa.int32(), "bits": pa.int32(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds.values())], list(kinds))

    return places.mapInArrow(run, "digest binary, width int, height int, bits int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media(df: DataFrame, folder: str | None = None) -> DataFrame:
    folder = folder or new_path(df.sparkSession, "media-shards")
    rows, places = store(df, folder)
    found = written(features(in_order(places), folder), "media-features")
    return rows.join(found, "digest").drop("digest")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media(documents(spark, sf_dir, "doc_id", "text"))


def members(data: bytes) -> dict[str, bytes]:
    """The members of a shard as any tar reader finds them."""
    with tarfile.open(fileobj=io.BytesIO(data)) as tar:
        return {m.name: tar.extractfile(m).read() for m in tar.getmembers()}
