"""Repository trees as a Spark data source with push-down.

``spark.read.format("repo_tree").option("path", root).load()`` gives the rows of
:func:`.tree.list_tree`. Filters on host, repository and suffix reach the scan: hosts that
cannot match are not opened, nor are repositories, and files with another suffix are not
asked for their size. A host is read by ``slices`` tasks, each of which lists the names of the
host's repositories and walks those that fall to it by a checksum; so planning lists hosts
only. One repository is walked by one task; :func:`.tree.list_tree` spreads even that.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from forgeatlas.schemas import FILES
from forgeatlas.sources.tree import _raw, _shown, local_root

PUSH_DOWN = "spark.sql.python.filterPushdown.enabled"
SLICES = 8
ROWS_PER_BATCH = 8192


def _suffix(name: str) -> str:
    """Last suffix with its dot; a leading or a trailing dot starts none."""
    at = name.rfind(".")
    return name[at:] if 0 < at < len(name) - 1 else ""


@dataclass
class Slice(InputPartition):
    host: str
    number: int
    of: int


@dataclass
class TreeReader(DataSourceReader):
    """``wanted`` has the values that a pushed column may have."""

    root: str
    slices: int = SLICES
    wanted: dict[str, set[str]] = field(default_factory=dict)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for one in filters:
            column = one.attribute[0] if isinstance(one, (EqualTo, EqualNullSafe, In)) else None
            if column not in ("host", "repo", "suffix", "name"):
                yield one
                continue
            values = set(one.value) if isinstance(one, In) else {one.value}
            self.wanted[column] = self.wanted.get(column, values) & values

    def _may(self, column: str, value: str) -> bool:
        return column not in self.wanted or value in self.wanted[column]

    def _folders(self, path: str, column: str) -> Iterator[str]:
        """Names of the folders in one that match; no other folder is opened."""
        try:
            with os.scandir(_raw(path)) as entries:
                for entry in entries:
                    name = _shown(entry.name)
                    if self._may(column, name) and entry.is_dir():
                        yield name
        except OSError:
            return

    def partitions(self) -> list[Slice]:
        hosts = sorted(self._folders(self.root, "host"))
        return [Slice(host, k, self.slices) for host in hosts for k in range(self.slices)] or [Slice("", 0, 0)]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        if part.of:
            for repo in self._folders(os.path.join(self.root, part.host), "repo"):
                if zlib.crc32(repo.encode()) % part.of == part.number:
                    for row in self._walk(part.host, repo):
                        rows.append(row)
                        if len(rows) >= ROWS_PER_BATCH:
                            yield _batch(rows)
                            rows = []
        yield _batch(rows)

    def _walk(self, host: str, repo: str) -> Iterator[tuple]:
        base = os.path.join(self.root, host, repo)
        folders = [""]
        while folders:
            folder = folders.pop()
            try:
                with os.scandir(_raw(os.path.join(base, folder))) as entries:
                    for entry in entries:
                        name = _shown(entry.name)
                        path = f"{folder}/{name}" if folder else name
                        if entry.is_dir(follow_symlinks=False):
                            folders.append(path)
                        elif self._may("suffix", _suffix(name)) and self._may("name", name) and entry.is_file():
                            yield host, repo, path, folder, name, _suffix(name), entry.stat().st_size
            except OSError:
                continue  # the scan goes on beside what cannot be read


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(FILES)
    types = [pa.int64() if f.name == "size" else pa.string() for f in FILES]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=FILES.names)


class RepoTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repo_tree"

    def schema(self) -> StructType:
        return FILES

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(local_root(self.options["path"]), int(self.options.get("slices", SLICES)))


def scan_tree(spark: SparkSession, root: str, *, slices: int = SLICES) -> DataFrame:
    """The files below ``<root>/<host>/<repo>``; filter it on ``host``, ``repo``, ``suffix`` or
    ``name``, and what cannot match is not opened."""
    spark.conf.set(PUSH_DOWN, "true")
    spark.dataSource.register(RepoTree)
    return spark.read.format("repo_tree").option("path", root).option("slices", slices).load()
