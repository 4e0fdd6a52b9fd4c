"""Captured responses in archives, and files on disk under their own paths: data sources for ``spark.read`` and ``df.write``.

An archive is a file of responses, one JSON object a line (URL, status, headers and a base64 body, as browsers' captures have
them), gzipped if its name ends in ``.gz``.  Both sources reach their folder by ``pyarrow.fs``, from tasks: a local path, or a URI of a store that
it knows.
"""

from __future__ import annotations

import base64
import gzip
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from silkmill import schemas

#: Columns whose filters a reader applies to a response before its body is decoded.
FILTERED = ("target_url", "url", "mode", "status")


def _at(path: str):
    """File system and path of a folder; a path without a scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class ArchiveFile(InputPartition):
    """One archive; ``number`` makes the order of arrival global."""

    path: str
    number: int


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder
        self.equal: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equalities on plain columns; what it takes leaves out responses before they are decoded."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and len(f.attribute) == 1 and f.attribute[0] in FILTERED:
                name = f.attribute[0]
                self.equal[name] = self.equal.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[ArchiveFile]:
        from pyarrow import fs

        system, root = _at(self.folder)
        files = sorted(x.path for x in system.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file and x.base_name.removesuffix(".gz").endswith((".jsonl", ".json")))
        return [ArchiveFile(path, n) for n, path in enumerate(files)]

    def read(self, partition: ArchiveFile | None) -> Iterator[tuple]:
        if partition is None:  # a folder without archives
            return
        system, _ = _at(self.folder)
        with system.open_input_stream(partition.path, compression=None) as raw:
            lines = gzip.GzipFile(fileobj=raw) if partition.path.endswith(".gz") else raw
            for n, line in enumerate(_lines(lines)):
                row = json.loads(line)
                if all(row.get(k) in v for k, v in self.equal.items()):
                    body = row.get("body_base64")
                    yield (
                        row.get("target_url"), row.get("url"), row.get("depth"), row.get("mode"), (partition.number << 32) + n, row.get("status"),
                        row.get("content_type"), row.get("content_encoding"), None if body is None else base64.b64decode(body),
                    )


def _lines(stream) -> Iterator[bytes]:
    """Lines that are not blank, read in pieces."""
    rest = b""
    while piece := stream.read(1 << 20):
        *whole, rest = (rest + piece).split(b"\n")
        yield from (x for x in whole if x.strip())
    if rest.strip():
        yield rest


@dataclass
class Written(WriterCommitMessage):
    files: int
    bytes: int


class FileWriter(DataSourceWriter):
    """Writes ``file_path, body`` rows to files under a folder.

    A file is written under a name of its own and moved to its path when it is whole, so no reader sees half of one, and a task that runs again, or
    twice at a time, puts the same bytes in the same place.
    """

    def __init__(self, folder: str, columns: list[str]):
        if not {"file_path", "body"} <= set(columns):
            raise ValueError("file_path and body are needed")
        self.folder, self.job = folder, f".silkmill-{uuid.uuid4().hex}"
        self.path_at, self.body_at = columns.index("file_path"), columns.index("body")

    def write(self, rows: Iterator) -> Written:
        system, root = _at(self.folder)
        drafts, files, size, made = posixpath.join(root, self.job), 0, 0, set()
        system.create_dir(drafts)
        for row in rows:
            path, body = row[self.path_at], row[self.body_at]
            parts = [] if path is None else path.split("/")
            if not parts or path.startswith("/") or any(x in ("", ".", "..") for x in parts):
                raise ValueError(f"no path within the folder: {path!r}")
            target, draft = posixpath.join(root, path), posixpath.join(drafts, uuid.uuid4().hex)
            with system.open_output_stream(draft) as out:
                out.write(bytes(body or b""))
            if (parent := posixpath.dirname(target)) not in made:
                system.create_dir(parent)
                made.add(parent)
            system.move(draft, target)
            files, size = files + 1, size + len(body or b"")
        return Written(files, size)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _at(self.folder)
        whole = [m for m in messages if m]
        self._clear(system, root)
        with system.open_output_stream(posixpath.join(root, "_SUCCESS")) as out:
            out.write(json.dumps({"files": sum(m.files for m in whole), "bytes": sum(m.bytes for m in whole)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_at(self.folder))

    def _clear(self, system, root: str) -> None:
        from pyarrow import fs

        drafts = posixpath.join(root, self.job)
        if system.get_file_info(drafts).type == fs.FileType.Directory:
            system.delete_dir(drafts)


class ArchiveSource(DataSource):
    """``spark.read.format("silkmill_archive").load(folder)``: rows of ``schemas.RESPONSES``, a partition for each archive."""

    @classmethod
    def name(cls) -> str:
        return "silkmill_archive"

    def schema(self) -> str:
        return schemas.RESPONSES

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"])


class FileSink(DataSource):
    """``df.write.format("silkmill_files").mode("append").save(folder)``: a file for each row of ``file_path, body``."""

    @classmethod
    def name(cls) -> str:
        return "silkmill_files"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if overwrite:
            raise ValueError("files are replaced one by one: use mode append")
        return FileWriter(self.options["path"], schema.names)


def register(spark: SparkSession) -> None:
    """Makes both sources known to a session; filters reach a reader only if the session lets Python sources have them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
    spark.dataSource.register(FileSink)
