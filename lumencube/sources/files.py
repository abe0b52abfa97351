"""Listings of folders and region text files, as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.metadata import file_type, parse_regions
from .store import locate
from .zarr import is_casa, is_zarr


FILES = "path string, bytes long, modified timestamp"


def _found(folder: str, recursive: bool) -> list[pafs.FileInfo]:
    fs, inside = locate(folder)
    try:
        return fs.get_file_info(pafs.FileSelector(inside, recursive=recursive))
    except OSError:
        return []


def is_accessible(folder: str) -> bool:
    """Whether a path is a folder that can be listed; False on any error of the store."""
    fs, inside = locate(folder)
    try:
        fs.get_file_info(pafs.FileSelector(inside))
        return True
    except OSError:
        return False


def folder_kinds(folders: DataFrame) -> DataFrame:
    """folders (file, ...) plus accessible, zarr, casa: whether each can be listed and which kind of image it is; asked by tasks."""
    import pyarrow as pa
    from pyspark.sql import types as T

    schema = T.StructType([*folders.schema.fields, *(T.StructField(c, T.BooleanType()) for c in ("accessible", "zarr", "casa"))])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = b.column("file").to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([f(p) for p in paths], pa.bool_()) for f in (is_accessible, is_zarr, is_casa))], names=schema.names)

    return folders.mapInArrow(ask, schema)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, bytes, modified of all files below a folder, empty ones too; contents are not read.

    Spark's own file sources pass over empty files, so the store is asked: the driver lists the folder itself, tasks what
    is below each of its sub-folders. A folder that can't be read gives no rows.
    """
    import pandas as pd

    top = _found(folder, False)
    here = spark.createDataFrame([(i.path, i.size, i.mtime) for i in top if i.type == pafs.FileType.File], FILES)
    prefix = folder.removesuffix(locate(folder)[1])  # of a store's paths
    below = [(prefix + i.path,) for i in top if i.type == pafs.FileType.Directory]
    if not below:
        return here

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["folder"]:
                rows = [(i.path, i.size, i.mtime) for i in _found(path, True) if i.type == pafs.FileType.File]
                yield pd.DataFrame(rows, columns=["path", "bytes", "modified"])

    folders = spark.createDataFrame(below, "folder string").repartition(min(len(below), 256))
    return here.unionByName(folders.mapInPandas(walk, FILES))


def entries(files: DataFrame) -> DataFrame:
    """path, name, type, bytes, modified of what a user may open: files that aren't hidden, and .zarr folders as one entry each."""
    cube = F.regexp_extract("path", r"^(.*?\.zarr)/", 1)
    df = files.withColumn("path", F.when(cube != "", cube).otherwise(F.col("path")))
    name = F.element_at(F.split("path", "/"), -1)
    df = df.groupBy("path").agg(F.sum("bytes").alias("bytes"), F.max("modified").alias("modified")).where(~name.startswith("."))
    return df.select("path", name.alias("name"), file_type(name).alias("type"), "bytes", "modified")


def folder_info(files: DataFrame) -> DataFrame:
    """folder, items, bytes, modified of every folder that directly holds files."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return files.groupBy(folder.alias("folder")).agg(F.count("*").alias("items"), F.sum("bytes").alias("bytes"), F.max("modified").alias("modified"))


def region_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, line of region text files; a file is read by one task, so that its lines keep their numbers."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return df.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))


def region_kinds(lines: DataFrame) -> DataFrame:
    """file, kind by the first line: CRTF, DS9_REG or UNKNOWN."""
    first = F.max(F.when(F.col("line_no") == 0, F.col("line")))
    kind = F.when(first.startswith("#CRTF"), "CRTF").when(first.startswith("# Region file format: DS9"), "DS9_REG").otherwise("UNKNOWN")
    return lines.groupBy("file").agg(kind.alias("kind"))


def import_regions(lines: DataFrame, highest: int = 0) -> DataFrame:
    """Regions of CRTF files with new ids above `highest`, in the order of file and line; other kinds of file give none."""
    crtf = region_kinds(lines).where("kind = 'CRTF'").select("file")
    found = parse_regions(lines.join(crtf, "file", "left_semi"))
    per_file = found.groupBy("file").agg(F.array_sort(F.collect_set("line_no")).alias("at"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    per_file = per_file.withColumn("earlier", F.coalesce(F.sum(F.size("at")).over(before), F.lit(0)))
    place = F.lit(highest) + F.col("earlier") + F.array_position("at", F.col("line_no"))
    return found.join(per_file, "file").withColumn("region_id", place.cast("long")).drop("at", "earlier")
