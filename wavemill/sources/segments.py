"""Tensors by identifier on one machine: files of a folder, or POSIX shared memory that
other processes open by the identifier. Bytes are little-endian elements in row-major
order; type and shape travel apart. On a cluster, `TensorStore` takes their place."""

from __future__ import annotations

import os
import tempfile
from multiprocessing import shared_memory
from typing import Protocol

from ..functions.provenance import is_oid, oid


def require_oid(name: str) -> None:
    if not is_oid(name):
        raise ValueError(f"{name} is no identifier")


def _checked(name: str, b: bytes) -> bytes:
    if oid(b) != name:
        raise ValueError(f"the bytes of {name} are others, or of another length")
    return b


class Segments(Protocol):
    kind: str

    def read(self, name: str, length: int) -> bytes: ...
    def write(self, name: str, data: bytes) -> bool: ...
    def remove(self, name: str) -> None: ...
    def close(self) -> None: ...


class FolderSegments:
    """A file for each tensor, written beside its place and then moved there."""

    kind = "file"

    def __init__(self, folder: str | None = None):
        self.folder = folder or os.path.join(tempfile.gettempdir(), "wavemill-segments")
        os.makedirs(self.folder, exist_ok=True)

    def _path(self, name: str) -> str:
        require_oid(name)
        return os.path.join(self.folder, name)

    def read(self, name: str, length: int) -> bytes:
        with open(self._path(name), "rb") as f:
            return _checked(name, f.read(length))

    def write(self, name: str, data: bytes) -> bool:
        """Whether this call made the file."""
        path = self._path(name)
        _checked(name, data)
        try:
            self.read(name, len(data))
            return False
        except (OSError, ValueError):
            pass
        handle, beside = tempfile.mkstemp(dir=self.folder)
        with os.fdopen(handle, "wb") as f:
            f.write(data)
        os.replace(beside, path)
        return True

    def remove(self, name: str) -> None:
        os.remove(self._path(name))

    def close(self) -> None:
        """Files stay."""


class SharedSegments:
    """A shared memory object for each tensor, named by the identifier; what a store has
    made goes when it is closed."""

    kind = "posix_shm"

    def __init__(self):
        self._own: dict[str, shared_memory.SharedMemory] = {}

    def read(self, name: str, length: int) -> bytes:
        require_oid(name)
        m = self._own.get(name) or shared_memory.SharedMemory(name=name, track=False)
        try:
            return _checked(name, bytes(m.buf[:length]))
        finally:
            if name not in self._own:
                m.close()

    def write(self, name: str, data: bytes) -> bool:
        require_oid(name)
        _checked(name, data)
        try:
            m = shared_memory.SharedMemory(name=name, create=True, size=max(1, len(data)), track=False)
        except FileExistsError:
            self.read(name, len(data))
            return False
        m.buf[: len(data)] = data
        self._own[name] = m
        return True

    def remove(self, name: str) -> None:
        require_oid(name)
        m = self._own.pop(name, None) or shared_memory.SharedMemory(name=name, track=False)
        m.close()
        m.unlink()

    def close(self) -> None:
        for name in list(self._own):
            self.remove(name)
