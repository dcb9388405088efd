"""Files kept under paths of their own content, as a Python data source that undoes a failed write.

``path`` is a folder that driver and executors share. A row (year, kind, name, sha256,
content) becomes the object ``year/kind/sha256/name``. An object that is there with the
same content stays as it is; what a failed job has made is removed, and nothing else.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "year int, kind string, name string, sha256 string, content binary"


class Artifacts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "artifacts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("objects are only added: use mode append")
        return _Writer(self.options["path"])


@dataclass
class _Made(WriterCommitMessage):
    """The objects that a task has staged: their place, and where they are to go."""

    staged: list[tuple[str, str]] = field(default_factory=list)


def _digest(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


class _Writer(DataSourceWriter):
    """Tasks stage objects in a folder of the job; the driver links them into their places once all tasks are done.

    A task that is lost or runs twice leaves staged files only, which go with the folder.
    The folder is made before the tasks begin, so that one that outlives its job finds none.
    """

    def __init__(self, path: str):
        self.root = path
        self.job = f".staged-{uuid.uuid4().hex}"
        Path(path, self.job).mkdir(parents=True)

    def write(self, iterator: Iterator[Row]) -> _Made:
        made = _Made()
        folder = Path(self.root, self.job, uuid.uuid4().hex)
        folder.mkdir()
        for n, row in enumerate(iterator):
            values = (row["year"], row["kind"], row["name"], row["sha256"], row["content"])
            if any(v is None for v in values):
                raise ValueError("an object needs a year, a kind, a name, a digest and content")
            year, kind, name, sha256, content = values
            if hashlib.sha256(content).hexdigest() != sha256:
                raise ValueError(f"{name} has changed since its digest was taken")
            if any(part in ("", ".", "..") or "/" in part or part.startswith(".staged-") for part in (kind, name)):
                raise ValueError(f"{kind!r}, {name!r} isn't a path")
            held = folder / str(n)
            held.write_bytes(content)
            made.staged.append((str(held), f"{year}/{kind}/{sha256}/{name}"))
        return made

    def commit(self, messages: list[_Made | None]) -> None:
        """Every object in its place, or none of this job's."""
        new: list[Path] = []
        try:
            for held, to in sorted(s for m in messages if m for s in m.staged):
                place = Path(self.root, to)
                place.parent.mkdir(parents=True, exist_ok=True)
                try:
                    # A link fails where the name is taken, so that no object is ever written over.
                    os.link(held, place)
                    new.append(place)
                except FileExistsError:
                    if _digest(place) != place.parent.name:
                        raise ValueError(f"{to} is there with other content") from None
        except BaseException:
            for place in new:
                place.unlink(missing_ok=True)
                self._prune(place.parent)
            raise
        finally:
            self._clear()

    def abort(self, messages: list[_Made | None]) -> None:
        self._clear()

    def _prune(self, folder: Path) -> None:
        """Removes folders that became empty, up to the root."""
        while folder != Path(self.root) and not any(folder.iterdir()):
            folder.rmdir()
            folder = folder.parent

    def _clear(self) -> None:
        top = Path(self.root, f"{self.job}-ended")
        if not Path(self.root, self.job).exists():
            return
        # Tasks that still write lose their folder at once, and then what they wrote goes.
        Path(self.root, self.job).rename(top)
        for folder, _, names in os.walk(top, topdown=False):
            for n in names:
                os.unlink(os.path.join(folder, n))
            os.rmdir(folder)


@dataclass
class _Object(InputPartition):
    paths: list[str]


class _Reader(DataSourceReader):
    """Objects with their digests as paths; a task checks what it reads."""

    def __init__(self, path: str, each: int = 64):
        self.root, self.each = path, each

    def partitions(self) -> list[_Object]:
        found = sorted(str(p.relative_to(self.root)) for p in Path(self.root).glob("[0-9]*/*/*/*"))
        return [_Object(found[i : i + self.each]) for i in range(0, len(found), self.each)] or [_Object([])]

    def read(self, partition: _Object) -> Iterator[tuple]:
        for p in partition.paths:
            year, kind, sha256, name = p.split("/")
            content = Path(self.root, p).read_bytes()
            if hashlib.sha256(content).hexdigest() != sha256:
                raise ValueError(f"{p} doesn't have the content of its digest")
            yield int(year), kind, name, sha256, content
