"""A sink of whole files that writes only what changed: spark.write.format("changed_files") for rows (name, content).

Tasks put new contents into a staging folder of the run; what a file has already is told by its hash and left alone. Only
when all tasks have ended are staged files renamed into place, the manifest last, so that readers who start from the
manifest see a state that was whole. A run that fails removes its staging folder and has changed nothing.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

MANIFEST = "_manifest.json"
OPEN = "_open"  # stands in a staging folder while its run goes on
NAME = re.compile(r"(?!.*(?:^|/)\.\.?(?:/|$))[^/\x00]+(?:/[^/\x00]+)*")  # no empty part, no way out of the folder


@dataclass
class Written(WriterCommitMessage):
    """hashes: of all files of a task, by name; staged: those that are new or differ."""

    hashes: dict[str, str]
    staged: list[str]


def _open(url: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(url) if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]+:", url) else (fs.LocalFileSystem(), url)


def _read(files: fs.FileSystem, path: str) -> bytes | None:
    if files.get_file_info(path).type != fs.FileType.File:
        return None
    with files.open_input_stream(path) as f:
        return f.read()


def _write(files: fs.FileSystem, path: str, content: bytes) -> None:
    files.create_dir(posixpath.dirname(path), recursive=True)
    with files.open_output_stream(path) as f:
        f.write(content)


class ChangedFilesWriter(DataSourceWriter):
    def __init__(self, url: str, overwrite: bool):
        self.url, self.overwrite, self.run = url.rstrip("/"), overwrite, uuid.uuid4().hex
        files, root = _open(self.url)
        _write(files, f"{self._staging(root)}/{OPEN}", b"")

    def _staging(self, root: str) -> str:
        return f"{root}/_staging-{self.run}"

    def _still_open(self, files: fs.FileSystem, root: str) -> None:
        """A task that goes on after its run was given up takes away what it has staged since."""
        if files.get_file_info(f"{self._staging(root)}/{OPEN}").type != fs.FileType.File:
            self.abort([])
            raise RuntimeError("the run was given up")

    def write(self, iterator: Iterator[Row]) -> Written:
        files, root = _open(self.url)
        hashes, staged = {}, []
        for row in iterator:
            content = bytes(row.content) if isinstance(row.content, (bytes, bytearray)) else (row.content or "").encode()
            if row.name is None or not NAME.fullmatch(row.name) or row.name.startswith("_"):
                raise ValueError(f"{row.name!r} names no file of the folder")
            if hashes.setdefault(row.name, h := hashlib.sha256(content).hexdigest()) != h:
                raise ValueError(f"{row.name!r} has two contents")
            before = _read(files, f"{root}/{row.name}")
            if before is None or hashlib.sha256(before).hexdigest() != h:
                _write(files, f"{self._staging(root)}/{row.name}", content)
                staged.append(row.name)
                self._still_open(files, root)
        return Written(hashes, staged)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _open(self.url)
        told = [m for m in messages if m is not None]
        old = json.loads(_read(files, f"{root}/{MANIFEST}") or b"{}")
        hashes = {} if self.overwrite else dict(old)
        for m in told:
            for name, h in m.hashes.items():
                if name in hashes and any(name in o.hashes and o.hashes[name] != h for o in told):
                    self.abort(messages)
                    raise ValueError(f"{name!r} has two contents")
                hashes[name] = h
        for name in sorted({n for m in told for n in m.staged}):
            target = f"{root}/{name}"
            files.create_dir(posixpath.dirname(target), recursive=True)
            files.move(f"{self._staging(root)}/{name}", target)
        if hashes != old:
            _write(files, f"{root}/{MANIFEST}-{self.run}", json.dumps(hashes, indent=1, sort_keys=True).encode())
            files.move(f"{root}/{MANIFEST}-{self.run}", f"{root}/{MANIFEST}")
        for name in sorted(set(old) - set(hashes)):  # only what an earlier run wrote, after the manifest has let go of it
            if files.get_file_info(f"{root}/{name}").type == fs.FileType.File:
                files.delete_file(f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        files, root = _open(self.url)
        if files.get_file_info(self._staging(root)).type == fs.FileType.Directory:
            files.delete_dir(self._staging(root))


class ChangedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "changed_files"

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ChangedFilesWriter(self.options["path"], overwrite)


def write_changed(files: DataFrame, path: str, mode: str = "append") -> None:
    """Write rows (name, content) as files below path; `overwrite` also removes what earlier runs wrote and this one doesn't have.

    A name that leaves the folder, is hidden from readers (_...) or has two contents fails the run, which then changes nothing. A null
    content is an empty file; no rows leave all as it is, or empty with `overwrite`.
    """
    files.sparkSession.dataSource.register(ChangedFiles)
    files.select("name", "content").write.format("changed_files").mode(mode).save(path)
