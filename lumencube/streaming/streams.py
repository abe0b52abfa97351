"""Streaming forms of session state and progressive results.

Every stream reads files as they come, keeps its state keyed (by session, window or channel), and lands in Parquet in the
shared folder through foreachBatch; a batch that is run again overwrites its own folder, so that each counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.expr import finite
from ..sources.store import locate, scratch


def files(spark: SparkSession, path: str, per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files at a path; per_batch limits how many a batch takes."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    reader = reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern, since a stream takes a single file only by one


def replay(table: DataFrame, by: str, parts: int = 4, rows_per_file: int = 1_000_000) -> DataFrame:
    """A stream of a table's rows in the order of `by` (a number or a time): so many ranges, written one after the other, a batch each.

    A range is written by many tasks, all ranges in the same number of files (empty ones where a range has fewer), so that a
    batch takes one range.
    """
    spark, path = table.sparkSession, scratch(table.sparkSession, "replay")
    at = table.select(by).schema[0].dataType.typeName()
    key = F.unix_micros(event_time(F.col(by))) if at.startswith("timestamp") else F.col(by)
    cuts, rows = table.agg(F.percentile_approx(key, [k / parts for k in range(1, parts)], 1000), F.count("*")).first()
    cuts, n = cuts or [], max(1, -(-rows // (parts * rows_per_file)))
    fs, inside = locate(path)
    for k in range(parts):
        low = key > cuts[k - 1] if k and cuts else F.lit(not k or not cuts)
        high = key <= cuts[k] if k < parts - 1 and cuts else F.lit(True)
        own = F.coalesce(low & high, F.lit(k == 0)) if cuts else F.lit(k == 0)  # rows without a key come first
        table.where(own).repartition(n).write.mode("append").parquet(path)
        names = [i.base_name for i in fs.get_file_info(pafs.FileSelector(inside)) if i.base_name.startswith("part-")]
        for _ in range(n * (k + 1) - len(names)):
            spark.createDataFrame([], table.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", n).parquet(path)


def land(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all there is and returns what it wrote, with the number of the batch in `batch`.

    complete: the last batch's whole table; append and update: the rows of every batch.
    """
    spark, target = stream.sparkSession, scratch(stream.sparkSession, "stream")

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{target}/table/" + ("batch=0" if mode == "complete" else f"batch={batch}"))

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{target}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch", IntegerType())])
    return spark.read.schema(schema).option("basePath", f"{target}/table").parquet(f"{target}/table")


def latest(commands: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last command of each key; the state is one command a key."""
    rest = [c for c in commands.columns if c not in key]
    return commands.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("m")).select(*key, "m.*")


def event_time(ts: Column) -> Column:
    return ts.cast("timestamp")


def windows(events: DataFrame, length: str, late: str = "10 minutes") -> DataFrame:
    """Events and the sum of their values by tumbling window and type."""
    e = events.withColumn("ts", event_time(F.col("ts"))).withWatermark("ts", late)
    out = e.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(finite(F.col("value"))).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events with pauses shorter than the gap."""
    e = events.withColumn("ts", event_time(F.col("ts"))).withWatermark("ts", late)
    out = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("stop"), "n")


def progressive_channels(px: DataFrame, inside: Column) -> DataFrame:
    """Sum, count, smallest and largest finite value of each channel so far; the order of the files does not matter."""
    f = finite(F.col("v"))
    return px.where(inside).groupBy("channel").agg(F.count(f).alias("n"), F.sum(f).alias("sum"), F.min(f).alias("min"), F.max(f).alias("max"))


def first_seen(commands: DataFrame) -> DataFrame:
    """When each (user_id, event_type) came first: (at, event_id), kept by user in custom state, and emitted when it changes.

    The state of a user has one entry a type. Rows of a batch are reduced as they pass; none are gathered.
    """
    schema = "user_id long, event_type string, at long, event_id long"

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen: dict = {}
        if state.exists:
            types, at, ids = state.get
            seen = {t: (a, i) for t, a, i in zip(types, at, ids, strict=True)}
        changed = set()
        for chunk in chunks:
            best = chunk.sort_values(["at", "event_id"]).drop_duplicates("event_type")
            for t, a, i in zip(best["event_type"], best["at"], best["event_id"], strict=True):
                if t not in seen or (a, i) < seen[t]:
                    seen[t] = (int(a), int(i))
                    changed.add(t)
        state.update(([*seen], [a for a, _ in seen.values()], [i for _, i in seen.values()]))
        rows = [(key[0], t, *seen[t]) for t in sorted(changed)]
        yield pd.DataFrame(rows, columns=["user_id", "event_type", "at", "event_id"])

    stream = commands.where("user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL")
    stream = stream.select("user_id", "event_type", F.unix_micros(event_time(F.col("ts"))).alias("at"), "event_id")
    return stream.groupBy("user_id").applyInPandasWithState(step, schema, "types array<string>, at array<long>, ids array<long>", "update", GroupStateTimeout.NoTimeout)
