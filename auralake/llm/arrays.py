"""Numpy arrays in the shared folder, memory-mapped by the workers.

Arrays are raw values of one type, written as a stream, so a task never holds one whole. Where the folder is a file system of the
machine, arrays are mapped in place. Elsewhere the first worker of a machine (or of an executor, if executors have temporary folders of their own) that needs an array
fetches it, under a lock, into a folder that all its workers map it from; the last of them to end removes the folder."""

from __future__ import annotations

import atexit
import fcntl
import hashlib
import os
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np


class Copies:
    """The machine's copies of one folder's arrays. Every worker that uses them holds a shared lock while it lives."""

    def __init__(self, uri: str):
        self.root = os.path.join(tempfile.gettempdir(), f"arrays-{os.getuid()}-{hashlib.sha256(uri.encode()).hexdigest()[:24]}")
        os.makedirs(self.root, exist_ok=True)
        self.pid, self.lock = os.getpid(), os.open(f"{self.root}.lock", os.O_CREAT | os.O_RDWR)
        fcntl.flock(self.lock, fcntl.LOCK_SH)
        os.makedirs(self.root, exist_ok=True)  # it may have gone before the lock was ours
        atexit.register(self.leave)

    def get(self, name: str, fetch) -> str:
        """The path of an array's copy, which fetch(path) makes if no worker of the machine has."""
        path = f"{self.root}/{name}"
        if not os.path.exists(path):
            own = os.open(f"{path}.lock", os.O_CREAT | os.O_RDWR)
            try:
                fcntl.flock(own, fcntl.LOCK_EX)
                if not os.path.exists(path):
                    part = f"{path}.{uuid.uuid4().hex}"
                    fetch(part)
                    os.replace(part, path)
            finally:
                os.close(own)
        return path

    def leave(self) -> None:
        if self.pid != os.getpid() or self.lock < 0:
            return
        try:
            fcntl.flock(self.lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
            shutil.rmtree(self.root, ignore_errors=True)
        except OSError:
            pass  # another worker maps them still
        os.close(self.lock)
        self.lock = -1


_copies: dict[tuple[str, int], Copies] = {}


class Writer:
    """Appends to an array that appears under its name when it is closed. A task that runs again writes the same anew."""

    def __init__(self, arrays: SharedArrays, name: str):
        self.arrays, self.name, self.part = arrays, name, f".{name}.{uuid.uuid4().hex}"
        if arrays.local is not None:
            os.makedirs(arrays.local, exist_ok=True)
            self.file = open(f"{arrays.local}/{self.part}", "wb")
        else:
            self.files, self.root = arrays._remote()
            self.files.create_dir(self.root, recursive=True)
            self.file = self.files.open_output_stream(f"{self.root}/{self.part}")

    def append(self, values: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(values).tobytes())

    def close(self) -> None:
        self.file.close()
        if self.arrays.local is not None:
            os.replace(f"{self.arrays.local}/{self.part}", f"{self.arrays.local}/{self.name}")
        else:
            self.files.move(f"{self.root}/{self.part}", f"{self.root}/{self.name}")


class SharedArrays:
    """Arrays by name under one folder."""

    def __init__(self, uri: str):
        self.uri, self.open = uri, {}
        parts = urlparse(uri)
        self.local = parts.path if parts.scheme in ("", "file") else None

    def __getstate__(self) -> dict:
        return {"uri": self.uri, "local": self.local, "open": {}}

    def _remote(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def _fetch(self, name: str, path: str) -> None:
        files, root = self._remote()
        with files.open_input_stream(f"{root}/{name}") as src, open(path, "wb") as dst:
            while block := src.read(1 << 22):
                dst.write(block)

    def load(self, name: str, kind: type) -> np.ndarray:
        if name not in self.open:
            path = f"{self.local}/{name}"
            if self.local is None:
                mine = (self.uri, os.getpid())
                if mine not in _copies:
                    _copies[mine] = Copies(self.uri)
                path = _copies[mine].get(name, lambda to: self._fetch(name, to))
            self.open[name] = np.memmap(path, dtype=kind, mode="r") if os.path.getsize(path) else np.zeros(0, dtype=kind)
        return self.open[name]
