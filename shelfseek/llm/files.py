"""Binary files in the shared folder, written and read by tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

from shelfseek.session import shared_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path)


def fresh_name(folder: str, suffix: str) -> str:
    """A name for one task attempt's file; files of failed attempts are in no listing that counts."""
    return f"{folder}/{uuid.uuid4().hex}{suffix}"


def create(path: str) -> fs.FileSystem:
    system, inner = located(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(inner, compression=None)


def open_ranges(path: str):
    system, inner = located(path)
    return system.open_input_file(inner)


def read_range(handle, offset: int, length: int) -> bytes:
    handle.seek(offset)
    return handle.read(length)
