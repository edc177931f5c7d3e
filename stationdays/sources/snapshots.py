"""The list of what belongs to a dataset, replaced as a whole by every commit.

A dataset is a folder with a subfolder per partition, in which every write puts its files
into a folder of its own. Which of these folders count is said by the latest file under
`_snapshots`: one line of JSON per partition, with its rows, files, bytes and a checksum
of the files' names and sizes. A commit adds a file with the next number, which readers
find whole or not at all: it is written under another name and renamed, and a name is
given once. Of two commits at the same time one finds its number taken, reads what the
other has added and tries again; commits of different partitions don't lose one another.

Only this list reaches the driver: a line per partition. All files are reached through
Hadoop's filesystems, with the session's settings and credentials.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

SNAPSHOTS = "_snapshots"


@dataclass(frozen=True)
class Committed:
    """What one partition consists of; a partition without rows has no folder."""

    partition: str
    folder: str | None
    rows: int
    files: int
    bytes: int
    checksum: str


NO_FILES = f"{0:016x}"


class Folder:
    """A folder of any filesystem the session knows."""

    def __init__(self, spark: SparkSession, uri: str):
        self.uri = uri.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._spark = spark
        settings = spark._jsparkSession.sessionState().newHadoopConf()
        self._files = self._path("").getFileSystem(settings)
        self._settings = settings

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.uri}/{name}" if name else self.uri)

    def exists(self, name: str = "") -> bool:
        return self._files.exists(self._path(name))

    def listed(self, name: str = "") -> dict[str, float]:
        """Names in a folder, with the seconds since 1970 of their last change."""
        if not self.exists(name):
            return {}
        found = self._files.listStatus(self._path(name))
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in found}

    def text(self, name: str) -> str:
        stream = self._files.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """Makes a file appear whole under a name; False if the name is taken."""
        parent = name.rpartition("/")[0]
        self._files.mkdirs(self._path(parent))
        hidden = f"{parent}/.{uuid.uuid4().hex}"
        stream = self._files.create(self._path(hidden), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self._hadoop.FileContext.getFileContext(self._files.getUri(), self._settings)
        # without the option to overwrite, a name is given once
        options = self._spark._sc._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(self._path(hidden), self._path(name), options)
        except Py4JJavaError as problem:
            self._files.delete(self._path(hidden), False)
            if "FileAlreadyExists" in problem.java_exception.getClass().getName():
                return False
            raise
        return True

    def move(self, name: str, to: str) -> None:
        self._files.mkdirs(self._path(to.rpartition("/")[0]))
        if not self._files.rename(self._path(name), self._path(to)):
            raise OSError(f"could not move {self.uri}/{name} to {to}")

    def remove(self, name: str) -> None:
        self._files.delete(self._path(name), True)


def _numbers(folder: Folder) -> list[int]:
    names = (name.removesuffix(".json") for name in folder.listed(SNAPSHOTS))
    return sorted(int(name) for name in names if name.isdigit())


def _file(number: int) -> str:
    return f"{SNAPSHOTS}/{number:020d}.json"


def _read(folder: Folder, number: int) -> dict[str, Committed]:
    found = [Committed(**json.loads(line)) for line in folder.text(_file(number)).splitlines()]
    return {c.partition: c for c in found}


def latest(spark: SparkSession, uri: str) -> dict[str, Committed] | None:
    """What belongs to a dataset now, by partition; None if nothing was ever committed."""
    folder = Folder(spark, uri)
    numbers = _numbers(folder)
    return _read(folder, numbers[-1]) if numbers else None


def commit(spark: SparkSession, uri: str, changes: Iterable[Committed]) -> int:
    """Replaces the changed partitions and leaves the others; the commit's number."""
    folder, changes = Folder(spark, uri), list(changes)
    while True:
        numbers = _numbers(folder)
        state = _read(folder, numbers[-1]) if numbers else {}
        state |= {c.partition: c for c in changes}
        number = numbers[-1] + 1 if numbers else 1
        lines = [json.dumps(asdict(state[p]), sort_keys=True) for p in sorted(state)]
        if folder.put_new(_file(number), "".join(f"{line}\n" for line in lines)):
            return number


def referenced(spark: SparkSession, uri: str, last: int) -> set[str]:
    """Folders that any of the last so many commits names."""
    folder = Folder(spark, uri)
    states = [_read(folder, number) for number in _numbers(folder)[-last:]]
    return {c.folder for state in states for c in state.values() if c.folder}
