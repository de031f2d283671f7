"""File systems behind paths, through pyarrow: local folders, S3-style stores, HDFS, Google storage."""

from __future__ import annotations

import os
import threading
from collections import OrderedDict

import pyarrow as pa
from pyarrow import fs

from tilespark.sources.ranges import RangeReader, s3_location, scheme_of

#: Files that a reader keeps open at most.
OPEN_FILES = 64
#: Schemes of S3-style stores.
S3_SCHEMES = ("s3", "s3a", "s3n")


def s3_arguments(o: dict[str, str]) -> dict[str, object]:
    """What the options access_key, secret_key, session_token, region, endpoint (with or without http(s)://), path_style
    (true unless said otherwise) and anonymous mean to the S3 file system. Without keys the usual places are searched:
    environment, profile files, the machine's role."""
    if bool(o.get("access_key")) != bool(o.get("secret_key")):
        raise ValueError("access_key and secret_key go together")
    if o.get("session_token") and not o.get("access_key"):
        raise ValueError("a session_token goes with access_key and secret_key")
    out: dict[str, object] = {k: o[k] for k in ("access_key", "secret_key", "session_token", "region") if o.get(k)}
    if o.get("endpoint"):
        kind, found, host = o["endpoint"].partition("://")
        out |= {"endpoint_override": host.rstrip("/"), "scheme": kind} if found else {"endpoint_override": o["endpoint"]}
    if str(o.get("path_style", "true")).lower() == "false":
        out["force_virtual_addressing"] = True
    if str(o.get("anonymous", "false")).lower() == "true":
        out["anonymous"] = True
    return out


def file_system(path: str, options: dict[str, str] | None = None) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path within it."""
    scheme = scheme_of(path)
    if scheme in S3_SCHEMES:
        return fs.S3FileSystem(**s3_arguments(options or {})), path.partition("://")[2].rstrip("/")
    if scheme in ("", "file"):
        plain = path.removeprefix("file://") if scheme else path.removeprefix("file:")
        return fs.LocalFileSystem(), os.path.abspath(plain)
    return fs.FileSystem.from_uri(path)


class FileSystemReader(RangeReader):
    """Range reads of files that stay open, the OPEN_FILES (`open_files`) used last. A local file that was changed or
    replaced is opened anew. Handles in use by other threads are never closed under them; close() lets all go."""

    def __init__(self, options: dict[str, str] | None = None, open_files: int = OPEN_FILES, concurrency: int = 1):
        self.options, self.open_files, self.concurrency = dict(options or {}), open_files, concurrency
        self._forget()

    def _forget(self) -> None:
        self.systems: dict[str, fs.FileSystem] = {}
        self.handles: OrderedDict[tuple, pa.NativeFile] = OrderedDict()
        self.used: dict[tuple, int] = {}
        self.lock = threading.Lock()

    def __getstate__(self) -> dict:  # handles and locks stay where they are
        return {"options": self.options, "open_files": self.open_files, "concurrency": self.concurrency}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def _place(self, path: str) -> tuple[fs.FileSystem, str]:
        scheme, (authority, _, rest) = scheme_of(path), path.partition("://")[2].partition("/")
        if scheme in ("", "file"):
            root, at = "", os.path.abspath(path.removeprefix("file://").removeprefix("file:"))
        elif scheme in S3_SCHEMES:
            root, at = f"{scheme}://{authority}", "/".join(s3_location(path))
        else:
            root, at = f"{scheme}://{authority}", f"/{rest}" if scheme in ("hdfs", "viewfs") else f"{authority}/{rest}"
        if root not in self.systems:
            self.systems[root] = file_system(path, self.options)[0]
        return self.systems[root], at

    def _take(self, path: str) -> tuple[tuple, pa.NativeFile]:
        with self.lock:
            system, at = self._place(path)
            key: tuple = (path,)
            if isinstance(system, fs.LocalFileSystem):
                s = os.stat(at)
                key = (path, s.st_ino, s.st_mtime_ns, s.st_size)
            handle = self.handles.get(key)
            if handle is None:
                self._drop([k for k in self.handles if k[0] == path])  # an earlier state of it
                handle = self.handles[key] = system.open_input_file(at)
            self.handles.move_to_end(key)
            self.used[key] = self.used.get(key, 0) + 1
            self._drop(list(self.handles)[: max(0, len(self.handles) - self.open_files)])
            return key, handle

    def _drop(self, keys: list[tuple]) -> None:
        for k in keys:
            if not self.used.get(k):
                self.handles.pop(k).close()
                self.used.pop(k, None)

    def read(self, path: str, offset: int, length: int) -> bytes:
        key, handle = self._take(path)
        try:
            size = handle.size()
            end = size if length < 0 else min(size, offset + length)
            return handle.read_at(end - offset, offset) if offset < end else b""
        finally:
            with self.lock:
                self.used[key] -= 1

    def close(self) -> None:
        with self.lock:
            self._drop(list(self.handles))
