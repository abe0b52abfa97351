"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

_OWN_ROOT: list[str] = []
_WRITTEN: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Where that is unset, an own folder, as in tests; on a cluster that is an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_ROOT:
        _OWN_ROOT.append(tempfile.mkdtemp(prefix="spark-shared-"))
    return _OWN_ROOT[0]


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet to the shared folder and reads it back, so that lost executors cost nothing."""
    path = f"{shared_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Intermediates:
    """Deletes the tables that are materialised inside of it, and those of `also`, when it ends; what keep() writes stays."""

    def __init__(self, spark: SparkSession, also: list[str] | None = None):
        self.spark, self.also, self.kept = spark, also or [], []

    def __enter__(self) -> Intermediates:
        self.before = len(_WRITTEN)
        return self

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        out = materialise(df, label)
        self.kept.append(_WRITTEN.pop())
        return out

    def __exit__(self, *error: object) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        for path in [*self.also, *_WRITTEN[self.before :]]:
            at = hadoop.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        del _WRITTEN[self.before :]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(parts: int, at: int) -> Column:
    """Whether crc32 of the doc_id as text leaves the remainder `at`; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts == at


def first_ids(docs: DataFrame, salt: str, most: int) -> DataFrame:
    """The `most` distinct doc_ids with the smallest crc32 of salt and id, ties by the id: a bounded sample; ids alone move."""
    order = F.crc32(F.concat(F.lit(salt), F.col("doc_id").cast("string")).cast("binary"))
    return docs.where("doc_id is not null").select("doc_id").distinct().orderBy(order, "doc_id").limit(most)


def give_back() -> None:
    """Returns memory that Python has freed to the system: workers live on between tasks, and share an executor with its JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def with_columns(docs: DataFrame, compute: Callable, added: T.StructType, drop: tuple[str, ...] = (), done: Callable[[], None] | None = None) -> DataFrame:
    """docs without the columns `drop`, plus the columns `added`, which compute(texts) gives as a list of arrays, batch by batch.

    All other columns pass as Arrow arrays, so ids of any size stay as they are beside nulls. done() is called when a task
    ends, to drop what compute has kept.
    """
    names = [c for c in docs.columns if c not in drop]
    schema = T.StructType([*[f for f in docs.schema.fields if f.name in names], *added.fields])

    def run(batches):
        kinds = [to_arrow_type(f.dataType) for f in added.fields]
        try:
            for whole in batches:
                for k in range(0, whole.num_rows, 256):  # a part's texts and results at a time
                    b = whole.slice(k, 256)
                    got = compute(b.column("text").to_pylist())
                    new = [pa.array(c, kind) for c, kind in zip(got, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *new], names=schema.names)
                    b = got = new = None
                whole = None
        finally:
            if done:
                done()
            give_back()

    return docs.mapInArrow(run, schema)
