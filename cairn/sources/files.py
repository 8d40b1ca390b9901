"""A sink of whole files, all of a write or none: tasks stage, the driver commits.

A task writes its rows' files under a hidden folder of its own attempt beside the
others; when all tasks are done, commit moves the files of the attempts that
count to their places, and abort deletes what was staged.  A failed, retried or
speculative task leaves nothing that a reader sees.  The names of the files pass
through the driver, their contents don't.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")


@dataclass
class Staged(WriterCommitMessage):
    """Files (relative paths) of a task's attempt, and the folder that it staged them in."""

    folder: str
    names: list[str]


class Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.root, self.suffix = options["root"], options.get("suffix", "")
        self.token = options.get("token") or uuid.uuid4().hex

    def _staging(self, base: str) -> str:
        return f"{base}/.staged-{self.token}"

    def write(self, iterator: Iterator[Row]) -> Staged:
        at, base = _opened(self.root)
        folder, names = f"{self._staging(base)}/{uuid.uuid4().hex}", []
        for path, content in iterator:
            if path is None:
                continue
            whole = f"{folder}/{path}{self.suffix}"
            at.create_dir(whole.rsplit("/", 1)[0], recursive=True)
            with at.open_output_stream(whole) as out:
                out.write(bytes(content or b""))
            names.append(f"{path}{self.suffix}")
        return Staged(folder, names)

    def commit(self, messages: list[Staged | None]) -> None:
        at, base = _opened(self.root)
        n = 0
        for m in messages:
            for name in dict.fromkeys(m.names if m else ()):
                place = f"{base}/{name}"
                at.create_dir(place.rsplit("/", 1)[0], recursive=True)
                if at.get_file_info(place).type != fs.FileType.NotFound:
                    at.delete_file(place)
                at.move(f"{m.folder}/{name}", place)
                n += 1
        self._forget(at, base)
        with at.open_output_stream(f"{self._staging(base)}.count") as out:
            out.write(str(n).encode())

    def abort(self, messages: list[Staged | None]) -> None:
        self._forget(*_opened(self.root))

    def _forget(self, at: fs.FileSystem, base: str) -> None:
        at.create_dir(base, recursive=True)
        if at.get_file_info(self._staging(base)).type != fs.FileType.NotFound:
            at.delete_dir(self._staging(base))


class Files(DataSource):
    """Rows (path, content) to files; options: root, a folder that all executors share, suffix, token."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer({k.lower(): v for k, v in self.options.items()})


def written(files: DataFrame, root: str, suffix: str = "") -> int:
    """Write `files` (path, content) under `root`; returns how many there are once all are in place.

    Null paths are left out, null contents are empty files; of equal paths one
    stays.  A file that was there is replaced.
    """
    token = uuid.uuid4().hex
    files.sparkSession.dataSource.register(Files)
    files.select("path", "content").write.format("files").mode("append").options(root=root, suffix=suffix, token=token).save()
    at, base = _opened(root)
    name = f"{base}/.staged-{token}.count"
    with at.open_input_stream(name) as f:
        n = int(f.read())
    at.delete_file(name)
    return n
