"""Small objects of a versioned database: commit records, pointers, checkpoints. Table data goes through Spark."""

from __future__ import annotations

import os
import posixpath
import re
import uuid
from collections.abc import Iterable

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyarrow import fs as pafs


class StoreError(OSError):
    """The store failed; whether the operation took place may be unknown."""


class Unordered(ValueError):
    """The store cannot order commits of several writers."""


class Store:
    """What the commit log needs of a store. Keys are relative to the root."""

    root: str

    def get(self, key: str) -> bytes | None:
        raise NotImplementedError

    def get_range(self, key: str, start: int, size: int) -> bytes:
        return (self.get(key) or b"")[start : start + size]

    def put(self, key: str, data: bytes) -> None:
        raise NotImplementedError

    def put_stream(self, key: str, pieces: Iterable[bytes]) -> None:
        """Puts an object piece by piece; it is there as a whole or not at all."""
        self.put(key, b"".join(pieces))

    def create(self, key: str, data: bytes) -> bool:
        """Puts an object that is not there yet; false if one is. This is what commits are ordered by."""
        raise NotImplementedError

    def delete(self, key: str) -> None:
        raise NotImplementedError

    def list(self, prefix: str) -> list[str]:
        raise NotImplementedError

    def modified(self, prefix: str) -> list[tuple[str, float]]:
        """Keys and when they were written, in seconds; also of unfinished and side files."""
        raise NotImplementedError

    def uri(self, key: str) -> str:
        return f"{self.root}/{key}"

    def probe(self) -> dict[str, bool]:
        """What the store can do, found out by doing it."""
        key = f"probe/{uuid.uuid4().hex}"
        try:
            first, second = self.create(key, b"a"), self.create(key, b"b")
            return {"create_once": first and not second, "read_after_write": self.get(key) == b"a", "range": self.get_range(key, 0, 1) == b"a", "list": key in self.list("probe/")}
        finally:
            self.delete(key)


class LocalStore(Store):
    """A folder that this machine sees, also one that the executors share."""

    def __init__(self, path: str):
        self.path = os.path.abspath(re.sub(r"^file:(//)?", "", path))
        self.root = f"file://{self.path}"
        os.makedirs(self.path, exist_ok=True)

    def _at(self, key: str) -> str:
        return os.path.join(self.path, key)

    def get(self, key: str) -> bytes | None:
        try:
            with open(self._at(key), "rb") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def get_range(self, key: str, start: int, size: int) -> bytes:
        with open(self._at(key), "rb") as f:
            f.seek(start)
            return f.read(size)

    def put_stream(self, key: str, pieces: Iterable[bytes]) -> None:
        os.replace(self._written(key, pieces), self._at(key))

    def _written(self, key: str, pieces: bytes | Iterable[bytes]) -> str:
        os.makedirs(os.path.dirname(self._at(key)), exist_ok=True)
        private = f"{self._at(key)}.{uuid.uuid4().hex}.tmp"
        with open(private, "wb") as f:
            f.writelines([pieces] if isinstance(pieces, bytes) else pieces)
            f.flush()
            os.fsync(f.fileno())
        return private

    def put(self, key: str, data: bytes) -> None:
        os.replace(self._written(key, data), self._at(key))

    def create(self, key: str, data: bytes) -> bool:
        private = self._written(key, data)
        try:
            os.link(private, self._at(key))
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(private)

    def delete(self, key: str) -> None:
        try:
            os.unlink(self._at(key))
        except FileNotFoundError:
            pass

    def list(self, prefix: str) -> list[str]:
        top = self._at(prefix)
        out = []
        for folder, _, names in os.walk(top if os.path.isdir(top) else os.path.dirname(top)):
            out += [posixpath.join(os.path.relpath(folder, self.path), n) for n in names if not n.endswith((".tmp", ".crc"))]
        return sorted(k for k in out if k.startswith(prefix))

    def modified(self, prefix: str) -> list[tuple[str, float]]:
        found = [os.path.join(folder, n) for folder, _, names in os.walk(self._at(prefix)) for n in names]
        return [(os.path.relpath(f, self.path), os.path.getmtime(f)) for f in found]


class ArrowStore(Store):
    """Any file system that Arrow opens by its address. It has no exclusive create: to write, one writer at a time must be asserted."""

    def __init__(self, uri: str, single_writer: bool = False):
        self.files, self.path = pafs.FileSystem.from_uri(uri)
        self.root, self.single_writer = uri.rstrip("/"), single_writer

    def modified(self, prefix: str) -> list[tuple[str, float]]:
        found = self.files.get_file_info(pafs.FileSelector(f"{self.path}/{prefix}", recursive=True, allow_not_found=True))
        return [(f.path[len(self.path) :].lstrip("/"), f.mtime.timestamp() if f.mtime else 0.0) for f in found if f.is_file]

    def get(self, key: str) -> bytes | None:
        try:
            with self.files.open_input_stream(f"{self.path}/{key}") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def put(self, key: str, data: bytes) -> None:
        self.put_stream(key, [data])

    def put_stream(self, key: str, pieces: Iterable[bytes]) -> None:
        target = f"{self.path}/{key}"
        self.files.create_dir(posixpath.dirname(target), recursive=True)
        private = f"{target}.{uuid.uuid4().hex}.tmp"
        with self.files.open_output_stream(private) as f:
            for piece in pieces:
                f.write(piece)
        self.files.move(private, target)

    def create(self, key: str, data: bytes) -> bool:
        if not self.single_writer:
            raise Unordered("this store has no exclusive create; pass single_writer=True if nobody else writes")
        if self.files.get_file_info(f"{self.path}/{key}").type != pafs.FileType.NotFound:
            return False
        self.put(key, data)
        return True

    def delete(self, key: str) -> None:
        try:
            self.files.delete_file(f"{self.path}/{key}")
        except (FileNotFoundError, pa.ArrowException):
            pass

    def list(self, prefix: str) -> list[str]:
        folder = posixpath.dirname(f"{self.path}/{prefix}")
        found = self.files.get_file_info(pafs.FileSelector(folder, recursive=True, allow_not_found=True))
        keys = [f.path[len(self.path) :].lstrip("/") for f in found if f.is_file and not f.path.endswith((".tmp", ".crc"))]
        return sorted(k for k in keys if k.startswith(prefix))


class HadoopStore(Store):
    """Any file system that Spark opens (hdfs, s3a, abfss, gs, viewfs ...), through the same connectors as its tables.

    Where a file can be created only if it is not there (a file system with such a create of its own, or an object store
    whose connector offers the conditional put), commits of several writers are ordered by it. Else one writer at a time
    must be asserted.
    """

    #: Connectors whose create without overwriting is exclusive.
    EXCLUSIVE = ("hdfs", "viewfs", "file", "abfs", "abfss")
    CONDITIONAL = "fs.option.create.conditional.overwrite"

    def __init__(self, spark, uri: str, single_writer: bool = False):
        self.root, self.single_writer = uri.rstrip("/"), single_writer
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.top = self.fs.makeQualified(self._path("")).toString().rstrip("/")
        scheme = uri.partition("://")[0]
        self.conditional = scheme not in self.EXCLUSIVE and bool(self.fs.hasPathCapability(self._path(""), self.CONDITIONAL))
        self.ordered = scheme in self.EXCLUSIVE or self.conditional

    def _path(self, key: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}" if key else self.root)

    def _failed(self, e: Py4JJavaError) -> Exception:
        kind = e.java_exception.getClass().getName()
        if kind.endswith("FileNotFoundException"):
            return FileNotFoundError(str(e.java_exception.getMessage()))
        if kind.endswith("FileAlreadyExistsException"):
            return FileExistsError(str(e.java_exception.getMessage()))
        return StoreError(f"{kind}: {e.java_exception.getMessage()}")

    def get(self, key: str) -> bytes | None:
        try:
            stream = self.fs.open(self._path(key))
            try:
                return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
            finally:
                stream.close()
        except Py4JJavaError as e:
            failed = self._failed(e)
            if isinstance(failed, FileNotFoundError):
                return None
            raise failed from e

    def _write(self, stream, data: bytes) -> None:
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def put(self, key: str, data: bytes) -> None:
        try:
            self._write(self.fs.create(self._path(key), True), data)
        except Py4JJavaError as e:
            raise self._failed(e) from e

    def create(self, key: str, data: bytes) -> bool:
        if not self.ordered and not self.single_writer:
            raise Unordered("this store has no exclusive create; pass single_writer=True if nobody else writes")
        try:
            if self.conditional:
                made = self.fs.createFile(self._path(key)).recursive().must(self.CONDITIONAL, True)
                self._write(made.build(), data)
            else:
                self._write(self.fs.create(self._path(key), False), data)
            return True
        except Py4JJavaError as e:
            failed = self._failed(e)
            if isinstance(failed, FileExistsError) or self.conditional and "412" in str(failed):
                return False
            if isinstance(failed, StoreError) and self.fs.exists(self._path(key)) and not self.conditional:
                return False
            raise failed from e

    def delete(self, key: str) -> None:
        try:
            self.fs.delete(self._path(key), False)
        except Py4JJavaError as e:
            raise self._failed(e) from e

    def _listed(self, prefix: str):
        folder = prefix if prefix.endswith("/") or not prefix else posixpath.dirname(prefix)
        if not self.fs.exists(self._path(folder.rstrip("/"))):
            return
        found = self.fs.listFiles(self._path(folder.rstrip("/")), True)
        while found.hasNext():
            f = found.next()
            yield f.getPath().toString()[len(self.top) :].lstrip("/"), f.getModificationTime() / 1000

    def list(self, prefix: str) -> list[str]:
        return sorted(k for k, _ in self._listed(prefix) if k.startswith(prefix) and not k.endswith((".tmp", ".crc")))

    def modified(self, prefix: str) -> list[tuple[str, float]]:
        return [(k, at) for k, at in self._listed(prefix) if k.startswith(prefix)]


def open_store(root: str, single_writer: bool = False, spark=None) -> Store:
    """A local folder, else whatever Spark opens by this address, else (without Spark) whatever Arrow opens."""
    if root.startswith("file:") or "://" not in root:
        return LocalStore(root)
    return HadoopStore(spark, root, single_writer) if spark is not None else ArrowStore(root, single_writer)
