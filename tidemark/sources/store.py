"""The sample table: Parquet, partitioned by block_base, its upkeep, and the numbers of its series."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.samples import block_base
from tidemark.functions.selector import identity, series_name
from tidemark.model import SAMPLES, SERIES
from tidemark.operators import catalog

FIELDS = [c.split()[0] for c in SAMPLES.split(", ")]
Listener = Callable[[DataFrame], None]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; in local mode without one, in a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def by_block(samples: DataFrame) -> DataFrame:
    """Rows in ranges of block and series, so that one block, as live samples are, is written by many tasks."""
    n = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return samples.repartitionByRange(n, "block_base", "series", "t").sortWithinPartitions("block_base", "series", "t", "seq")


class Files:
    """Files of a folder, through the file system that Spark itself uses."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.folder = self.jvm.org.apache.hadoop.fs.Path(path)
        self.system = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        if not self.system.exists(self.folder):
            return []
        return [f.getPath().getName() for f in self.system.listStatus(self.folder) if not f.getPath().getName().startswith((".", "_"))]

    def path(self, name: str):  # noqa: ANN201
        return self.jvm.org.apache.hadoop.fs.Path(self.folder, name)

    def exists(self, name: str) -> bool:
        return self.system.exists(self.path(name))


class SampleTable:
    """Appends are whole files that appear at once; a reader sees a batch entirely or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.listeners: list[Listener] = []

    def subscribe(self, listener: Listener) -> None:
        """Called with each batch after it is stored."""
        self.listeners.append(listener)

    def append(self, samples: DataFrame) -> None:
        """Samples before the epoch are refused. Rows of a block are written together, in order of series and time."""
        if not samples.where("t < 0").isEmpty():
            raise ValueError("t must be >= 0")
        rows = samples.withColumn("block_base", block_base(F.col("t"))).select(*FIELDS)
        by_block(rows).write.mode("append").partitionBy("block_base").parquet(self.path)
        for listener in self.listeners:
            listener(samples)

    def write(self, name: str, timestamps: list[int], values: list[float], first_seq: int = 0) -> None:
        """Samples of one series, given by its name."""
        if len(timestamps) != len(values):
            raise ValueError("as many timestamps as values are needed")
        metric, labels = identity(name)
        if timestamps:
            rows = [(metric, series_name(metric, labels), labels, int(t), float(v), first_seq + i, 0) for i, (t, v) in enumerate(zip(timestamps, values, strict=True))]
            self.append(self.spark.createDataFrame(rows, SAMPLES))

    def read(self) -> DataFrame:
        return self.spark.read.schema(SAMPLES).parquet(self.path)

    def compact(self, base: int, files: int = 1) -> None:
        """Writes the files that a block has now anew, as a few sorted ones. These are whole, in a hidden folder of this call
        alone, before they are moved in and exactly the files that were read go; what others append meanwhile stays. A
        reader that lists the block in the moment of the exchange may see rows twice, never too few."""
        folder = f"{self.path}/block_base={base}"
        block = Files(self.spark, folder)
        old = block.names()
        if not old:
            return
        rows = self.spark.read.schema(SAMPLES).option("basePath", self.path).parquet(*(f"{folder}/{name}" for name in old))
        hidden = f"{self.path}/_compact-{uuid.uuid4().hex}"
        rows.drop("block_base").repartitionByRange(max(1, files), "series", "t").sortWithinPartitions("series", "t", "seq").write.parquet(hidden)
        new = Files(self.spark, hidden)
        for name in new.names():
            if not block.system.rename(new.path(name), block.path(name)):
                raise OSError(f"{name} could not be moved into {folder}")
        for name in old:
            block.system.delete(block.path(name), False)
        new.system.delete(new.folder, True)


class SeriesNumbers:
    """The numbers of a table's series, stored beside it: a number once given stays, new series follow the largest."""

    def __init__(self, table: SampleTable):
        self.table, self.path = table, f"{table.path}__series"

    def known(self) -> DataFrame:
        files = Files(self.table.spark, self.path).names()
        return self.table.spark.read.schema(SERIES).parquet(self.path) if files else self.table.spark.createDataFrame([], SERIES)

    def current(self) -> DataFrame:
        """All series of the table with their numbers; new ones are numbered and stored first."""
        known = self.known()
        found = catalog.series(self.table.read()).join(known.select("name"), "name", "left_anti")
        if not found.isEmpty():
            catalog.with_ids(found, first=(known.agg(F.max("series_id")).first()[0] or 0) + 1).select(*(c.split()[0] for c in SERIES.split(", "))).write.mode("append").parquet(self.path)
        return self.known()
