"""Binary files in the shared folder, written and read by tasks through the folder's own file system."""

from __future__ import annotations

import uuid

from pyarrow import fs


def create(folder: str, data: bytes, ending: str) -> str:
    """A new file of its own name (a repeated task leaves its first file unnamed and unread); its path."""
    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    name = f"{uuid.uuid4().hex}{ending}"
    with system.open_output_stream(f"{base}/{name}", compression=None) as out:
        out.write(data)
    return f"{folder}/{name}"


def load(path: str) -> bytes:
    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_stream(at, compression=None) as f:
        return f.read()
