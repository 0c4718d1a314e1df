"""Plain arrays in a folder that driver and executors share, memory-mapped by those who read them."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import numpy as np
from pyarrow import fs
from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder; a local one only for a local master without any."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        top = tempfile.mkdtemp(prefix="run-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def located(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def put(folder: str, name: str, array: np.ndarray) -> None:
    """Write an array under a name; a repeated task replaces what an earlier attempt wrote."""
    files, path = located(folder)
    files.create_dir(path)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(part) as out:
        out.write(np.ascontiguousarray(array).data)
    files.move(part, f"{path}/{name}")


def mapped(folder: str, name: str, dtype) -> np.ndarray:
    """The array under a name, memory-mapped; an empty one where there is none.

    From a store that is no mounted folder the file is fetched once into an unnamed local file, whose
    space is free again when the mapping goes.
    """
    files, path = located(folder)
    path = f"{path}/{name}"
    size = files.get_file_info(path).size
    if not size:
        return np.empty(0, dtype=dtype)
    if isinstance(files, fs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r")
    handle, local = tempfile.mkstemp()
    with os.fdopen(handle, "wb") as out, files.open_input_stream(path) as stream:
        while block := stream.read(1 << 24):
            out.write(block)
    array = np.memmap(local, dtype=dtype, mode="r")
    os.unlink(local)
    return array
