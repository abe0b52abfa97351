"""Folders and files: where intermediate tables go, and how tasks open a path of any store."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

_OWN_ROOT: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder named in spark.checkpoint.dir; in an own folder only where that is unset, as in tests.

    On a cluster that is an error: other machines would not see the files.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN_ROOT:
            _OWN_ROOT.append(tempfile.mkdtemp(prefix="spark-cubes-"))
        root = _OWN_ROOT[0]
    return f"{root}/{label}-{uuid.uuid4().hex}"


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def list_files(path: str, suffixes: tuple[str, ...]) -> list[str]:
    """The file itself, or the files of a folder that end in one of the suffixes and aren't hidden, by name."""
    fs, inside = locate(path)
    if fs.get_file_info(inside).type == pafs.FileType.File:
        return [path]
    found = [i.base_name for i in fs.get_file_info(pafs.FileSelector(inside)) if i.type == pafs.FileType.File]
    return [f"{path.rstrip('/')}/{n}" for n in sorted(found) if not n.startswith(".") and n.lower().endswith(suffixes)]


def read_file(path: str) -> bytes:
    fs, inside = locate(path)
    with fs.open_input_file(inside) as f:
        return f.read()


def write_file(path: str, content: bytes) -> None:
    """Writes under another name first, so that a task that is lost and run again leaves one whole file."""
    fs, inside = locate(path)
    folder, _, name = inside.rpartition("/")
    fs.create_dir(folder, recursive=True)
    hidden = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(hidden) as f:
        f.write(content)
    fs.move(hidden, inside)
