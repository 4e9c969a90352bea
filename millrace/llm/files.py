"""Binary files in the shared folder, written by tasks.

A name is unique to the attempt that wrote it and travels in the rows the task returns. A retried or
speculative attempt therefore writes another file, and only those named by the rows that Spark kept
are ever read.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def writer(folder: str, kind: str):
    """An open stream and its URI."""
    system, root = opened(folder)
    system.create_dir(root, recursive=True)
    name = f"{uuid.uuid4().hex}.{kind}"
    return system.open_output_stream(f"{root}/{name}", compression=None), f"{folder}/{name}"


def reader(uri: str):
    system, path = opened(uri)
    return system.open_input_file(path)


def stream(uri: str):
    system, path = opened(uri)
    return system.open_input_stream(path, compression=None, buffer_size=1 << 20)
