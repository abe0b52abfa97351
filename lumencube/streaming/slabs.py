"""A progressive spectrum as a stream whose source deals out slabs of channels, each sized by the time that the last one took."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from time import perf_counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.store import read_file, scratch, write_file


class Slabs(DataSource):
    """Rows (first, last): half-open ranges of channels, one a batch, up to `channels`.

    Options: channels; size, of the first slab; target, the milliseconds that a slab's channels should take; memory, a file
    that holds how far the source has dealt and its last size, so that a query that starts again goes on there; took, a file
    with the milliseconds of the last slab and of an empty one, which every batch has besides. Without that file a batch's
    whole time counts. A slab is at most GROWTH times as large as the one before.
    """

    @classmethod
    def name(cls) -> str:
        return "slabs"

    def schema(self) -> str:
        return "first int, last int"

    def streamReader(self, schema: StructType) -> SlabReader:  # noqa: N802
        return SlabReader(self.options)


GROWTH = 8


class Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class SlabReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.channels, self.target, self.memory = int(options["channels"]), float(options.get("target", 1000)), options["memory"]
        self.took = options.get("took")
        self.at, self.size, self.asked = 0, max(1, int(options.get("size", 10))), None
        try:
            self.at, self.size = json.loads(read_file(self.memory))
        except FileNotFoundError:
            pass

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": 0}

    def last_took(self, now: float) -> float:
        """Milliseconds that grow with a slab's size: were those of an empty slab counted, slabs would shrink to one channel."""
        try:
            took, empty = json.loads(read_file(self.took)) if self.took else ((now - self.asked) * 1000, 0)
        except FileNotFoundError:
            took, empty = (now - self.asked) * 1000, 0
        return max(1e-3, took - empty)

    def latestOffset(self) -> dict:  # noqa: N802
        """Asked once a batch: the last slab has ended."""
        now = perf_counter()
        if self.asked is not None and self.at < self.channels:
            self.size = int(max(1, min(self.size * self.target / self.last_took(now), self.size * GROWTH, self.channels)))
        if self.at < self.channels:
            self.at, self.asked = min(self.channels, self.at + self.size), now
            write_file(self.memory, json.dumps([self.at, self.size]).encode())
        return {"at": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Range(start["at"], end["at"])]

    def read(self, partition: Range) -> Iterator[tuple[int, int]]:
        if partition.first < partition.last:
            yield partition.first, partition.last

    def commit(self, end: dict) -> None:
        pass


def progressive(spark: SparkSession, channels: int, read: Callable[[int, int], DataFrame], target_ms: float = 1000.0, first: int = 10) -> DataFrame:
    """Runs read(from, to) for slabs of channels until all are done; returns its rows with batch, first and last of their slab.

    A batch's rows land in Parquet in the shared folder, in a folder of their own that a batch that is run again
    overwrites; only the two ends of a slab reach the driver. After the first slab an empty one is run, whose time is taken
    off that of every slab. Without channels: no rows.
    """
    target, schema = scratch(spark, "slabs"), read(0, 0).schema
    spark.dataSource.register(Slabs)
    slabs = spark.readStream.format("slabs").option("channels", channels).option("size", first).option("target", target_ms).option("memory", f"{target}/dealt").option("took", f"{target}/took").load()
    empty: list[float] = []

    def write(lo: int, hi: int, path: str) -> float:
        """Milliseconds that the slab from lo to hi takes."""
        began = perf_counter()
        read(lo, hi).withColumns({"first": F.lit(lo), "last": F.lit(hi)}).write.mode("overwrite").parquet(path)
        return (perf_counter() - began) * 1000

    def land(df: DataFrame, batch: int) -> None:
        lo, hi = df.agg(F.min("first"), F.max("last")).first()
        if lo is not None:
            took = write(lo, hi, f"{target}/table/batch={batch}")
            if not empty:
                empty.append(write(lo, lo, f"{target}/empty"))
            write_file(f"{target}/took", json.dumps([took, empty[0]]).encode())

    q = slabs.writeStream.option("checkpointLocation", f"{target}/state").foreachBatch(land).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    schema = StructType([*schema.fields, *(StructField(c, IntegerType()) for c in ("first", "last", "batch"))])
    if not channels:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{target}/table").parquet(f"{target}/table")
