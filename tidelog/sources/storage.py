"""Where a store's blocks lie: the interface, and directories that Spark's file systems reach.

A directory's manifests say which block files count.  Manifest n is the file
`manifest-<n>.json`; the newest whole one holds, and a commit is the creation of the next one,
which fails if there is one already.  So a batch of several files, or the exchange of a
block for its compacted form, is there as a whole or not at all, wherever a crash falls.  Block
files that the engine did not name itself count too, unless a manifest has retired them.
"""

from __future__ import annotations

import json
import re
import tempfile
from functools import cached_property
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from tidelog.sources import blocks as files

OWN = re.compile(r"b\d{18}-.*")
MANIFEST = re.compile(r"manifest-(\d{20})\.json")


def shared_place(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only if they are one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or "file://" + tempfile.mkdtemp(prefix="tidelog-")).rstrip("/")


class Conflict(RuntimeError):
    """Another writer has committed meanwhile."""


class Writer(Protocol):
    name: str
    size: int

    def write(self, line: str) -> None: ...

    def close(self) -> None: ...


class Storage(Protocol):
    """What a store asks of its storage."""

    def ensure(self) -> None:
        """Makes the place if it is not there."""

    def blocks(self) -> list[str]:
        """The blocks that count, in order."""

    def stats(self) -> DataFrame:
        """bid and size of these."""

    def load(self, names: list[str], strict: bool = True) -> DataFrame:
        """LOG_SCHEMA of the lines of blocks; if not strict, with `error`."""

    def append(self, records: DataFrame, first: int, files: int, tag: str = "") -> list[str]:
        """Writes (_seq, record) as new blocks that do not count yet."""

    def writer(self, first: int) -> Writer:
        """A new block, which does not count yet, for lines one at a time."""

    def commit(self, add: list[str], retire: list[str] = ()) -> None:
        """From now on the first blocks count and the others don't, all at once."""

    def rename(self, old: str, new: str) -> None: ...

    def delete(self, bid: str) -> None: ...

    def lock(self, bid: str) -> bool:
        """Takes a block's lock; False if it is taken."""

    def unlock(self, bid: str) -> None: ...


class DirectoryStorage:
    """Block files of one directory, in any file system that Spark has."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def ensure(self) -> None:
        files.ensure_dir(self.spark, self.path)

    def _read(self, name: str) -> str:
        fs, _, make = files._fs(self.spark, self.path)
        stream = fs.open(make(f"{self.path}/{name}"))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _manifest(self) -> tuple[int, dict]:
        """Number and content of the newest whole manifest, and the highest number taken."""
        found = sorted((int(m[1]), m[0]) for n, _ in files.listed(self.spark, self.path) if (m := MANIFEST.fullmatch(n)))
        for _, name in reversed(found):
            try:
                return found[-1][0], json.loads(self._read(name))
            except ValueError:  # a crash has cut it off: it never held
                continue
        return (found[-1][0] if found else 0), {"blocks": [], "retired": []}

    def blocks(self) -> list[str]:
        return self._counted(self._manifest()[1])

    def _counted(self, manifest: dict) -> list[str]:
        there = files.list_files(self.spark, self.path)
        known, retired = set(manifest["blocks"]), set(manifest["retired"])
        return [n for n in there if n in known or not (n in retired or OWN.fullmatch(n))]

    def stats(self) -> DataFrame:
        return files.block_stats(self.spark, self.path, self.blocks())

    def load(self, names: list[str], strict: bool = True) -> DataFrame:
        return files.load(self.spark, self.path, names, strict)

    def append(self, records: DataFrame, first: int, files_: int, tag: str = "") -> list[str]:
        return files.append(records, self.path, first, files_, tag)

    def writer(self, first: int) -> files.LineWriter:
        return files.LineWriter(self.spark, self.path, files.block_name(first, "s"))

    def commit(self, add: list[str], retire: list[str] = ()) -> None:
        version, held = self._manifest()
        gone = set(retire)
        there = set(files.list_files(self.spark, self.path))
        content = {"blocks": sorted((set(held["blocks"]) | set(add)) - gone), "retired": sorted((set(held["retired"]) | gone) & there)}
        fs, _, make = files._fs(self.spark, self.path)
        try:
            out = fs.create(make(f"{self.path}/manifest-{version + 1:020d}.json"), False)
        except Exception as e:
            raise Conflict(f"{self.path} has a newer commit") from e
        out.write(bytearray(json.dumps(content, indent=0).encode()))
        out.close()
        if version:  # the one before stays, for readers that have just listed it
            fs.delete(make(f"{self.path}/manifest-{version - 1:020d}.json"), False)

    @cached_property
    def _place(self) -> tuple:
        """The file system and what makes its paths, found once."""
        fs, _, make = files._fs(self.spark, self.path)
        return fs, make

    def rename(self, old: str, new: str) -> None:
        fs, make = self._place
        if not fs.rename(make(f"{self.path}/{old}"), make(f"{self.path}/{new}")):
            raise OSError(f"{self.path}/{old} can't be renamed to {new}")

    def delete(self, bid: str) -> None:
        files.delete_block(self.spark, self.path, bid)

    def lock(self, bid: str) -> bool:
        fs, make = self._place
        return bool(fs.createNewFile(make(f"{self.path}/{bid}.lock")))

    def unlock(self, bid: str) -> None:
        fs, make = self._place
        fs.delete(make(f"{self.path}/{bid}.lock"), False)
