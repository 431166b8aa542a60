"""Binary files in the shared folder, opened from tasks through pyarrow's file
systems (file, hdfs, s3, gs), published under their final name only when whole."""

from __future__ import annotations

import uuid


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def put(folder: str, stem: str, data: bytes) -> str:
    """Write ``data`` as a new file of ``folder`` and return its address.

    The name is unique to this call, so a task that runs twice leaves a second
    file that no manifest lists, never a mixture of two.
    """
    address = f"{folder}/{stem}-{uuid.uuid4().hex}"
    files, path = _fs(address)
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with files.open_output_stream(path + ".part", compression=None) as out:
        out.write(data)
    files.move(path + ".part", path)
    return address


def put_at(address: str, data: bytes) -> None:
    """Write ``data`` under a name that says what it holds (a digest): where that file is, it stays."""
    files, path = _fs(address)
    if files.get_file_info(path).is_file:
        return
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}-{uuid.uuid4().hex}.part"
    with files.open_output_stream(part, compression=None) as out:
        out.write(data)
    files.move(part, path)


def remove(folder: str) -> None:
    """Delete a folder that no later job reads."""
    files, path = _fs(folder)
    if files.get_file_info(path).type.name == "Directory":
        files.delete_dir(path)


def get(address: str) -> bytes:
    files, path = _fs(address)
    with files.open_input_stream(path, compression=None) as f:
        return f.read()
