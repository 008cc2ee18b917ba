"""Arrow tables as files in the folder that all executors share, written and read inside tasks."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from tillwise.functions.lineage import ensure_checkpoint_dir


def file_system(folder: str):
    """The file system of a shared folder, and the path in it."""
    from pyarrow import fs

    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the written copies."""
    folder = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, path = file_system(folder)
    files.create_dir(path, recursive=True)
    return folder


def matrix_column(values: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(values).reshape(-1)), values.shape[1])


def column_matrix(table: pa.Table, name: str) -> np.ndarray:
    values = table.column(name).combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), values.type.list_size)


def save(folder: str, table: pa.Table) -> str:
    """Write a file with a name of its own, so a task that runs twice does no harm; returns its path."""
    path = f"{folder}/{uuid.uuid4().hex}.arrow"
    files, place = file_system(path)
    options = pa.ipc.IpcWriteOptions(compression="lz4")
    with files.open_output_stream(place) as out, pa.ipc.new_file(out, table.schema, options=options) as writer:
        writer.write_table(table.combine_chunks())
    return path


def load(path: str) -> pa.Table:
    files, place = file_system(path)
    with files.open_input_file(place) as source:
        return pa.ipc.open_file(source).read_all()
