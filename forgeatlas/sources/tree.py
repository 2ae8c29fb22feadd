"""Scan of checked-out repository trees ``<root>/<host>/<repo>/**``.

Spark's own file sources skip names starting with ``.`` or ``_`` and empty
files, all of which count here. The root must be on a file system that every
executor mounts.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeatlas.operators.files import with_path_parts
from forgeatlas.session import parallelism, scratch_path

# Directory entries one work item reads before it hands back unread folders.
ENTRY_BUDGET = 50_000
_ROWS_PER_BATCH = 5_000
_BYTES_PER_BATCH = 32 << 20
# Longest content that is read as one value.
MAX_CONTENT = 1 << 30
CHUNK_BYTES = 8 << 20
_WALKED = "kind string, host string, repo string, rel_path string, size long"


def local_root(root: str) -> str:
    """Folder of a tree as the executors mount it; other file systems are refused, because
    every executor would read or write a folder of its own."""
    root = re.sub(r"^file:(//)?(?=/)", "", root)
    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", root):
        raise ValueError(f"not a mounted folder: {root}")
    return root


def _shown(name: str) -> str:
    """Name as text; bytes that are no UTF-8 are written as escapes."""
    return os.fsencode(name).decode("utf-8", "backslashreplace")


def _raw(path: str) -> str:
    """Name of the file behind a shown path."""
    if os.path.lexists(path) or "\\x" not in path:
        return path
    raw = re.sub(rb"\\x([0-9a-f]{2})", lambda m: bytes([int(m[1], 16)]), os.fsencode(path))
    return os.fsdecode(raw)


def _walk_item(root: str, host: str, repo: str, rel: str, budget: int, skip_vcs: bool):
    """Yield ``(kind, host, repo, rel_path, size)``: files, folders left to read, and folders
    that cannot be read (kind ``error``)."""
    if not host or not repo:
        # Hosts and repositories always become work items of their own.
        try:
            for entry in os.scandir(_raw(os.path.join(root, host))):
                if entry.is_dir():
                    name = _shown(entry.name)
                    yield ("dir", host or name, name if host else "", "", 0)
        except OSError:
            yield ("error", host, repo, "", 0)
        return
    base = os.path.join(root, host, repo)
    folders, seen = [rel], 0
    while folders:
        if seen >= budget:
            yield from (("dir", host, repo, folder, 0) for folder in folders)
            return
        folder = folders.pop()
        try:
            with os.scandir(_raw(os.path.join(base, folder))) as entries:
                for entry in entries:
                    seen += 1
                    name = _shown(entry.name)
                    inner = f"{folder}/{name}" if folder else name
                    if entry.is_dir(follow_symlinks=False):
                        if not (skip_vcs and name == ".git"):
                            folders.append(inner)
                    elif entry.is_file():
                        yield ("file", host, repo, inner, entry.stat().st_size)
        except OSError:
            yield ("error", host, repo, folder, 0)


def _walker(root: str, budget: int, skip_vcs: bool):
    columns = ["kind", "host", "repo", "rel_path", "size"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for batch in batches:
            for host, repo, rel in zip(batch["host"], batch["repo"], batch["rel_path"]):
                for row in _walk_item(root, host, repo, rel, budget, skip_vcs):
                    rows.append(row)
                    if len(rows) >= _ROWS_PER_BATCH:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
        yield pd.DataFrame(rows, columns=columns)

    return walk


def list_tree(
    spark: SparkSession,
    root: str,
    *,
    budget: int = ENTRY_BUDGET,
    skip_vcs: bool = False,
    kind: str = "file",
    only: DataFrame | None = None,
) -> DataFrame:
    """One row per regular file, without its content; with ``kind="error"`` one row per
    folder that could not be read. The scan goes on beside such a folder. Bytes of a name
    that are no UTF-8 are shown as escapes. ``only`` (``host, repo``) names the repositories
    to open; no other folder of a repository is read.

    The walk runs on the executors in rounds. A round reads every open folder
    and, below it, up to ``budget`` entries; folders it did not get to are the
    next round. A repository of any size is therefore spread over many tasks.
    Each round is stored in the shared folder, so a lost executor repeats one
    round at most.
    """
    walk = _walker(local_root(root), budget, skip_vcs)
    open_dirs = spark.createDataFrame([("", "", "")], "host string, repo string, rel_path string")
    folder, rounds, tasks = scratch_path(spark, "tree"), [], 1
    if only is not None:
        hosts = only.select("host", F.lit("").alias("repo"))
        only.select("host", "repo").union(hosts).distinct().write.parquet(f"{folder}/only")
        only = spark.read.parquet(f"{folder}/only")
    while True:
        target = f"{folder}/round={len(rounds)}"
        spread = open_dirs.repartition(tasks, "host", "repo", "rel_path")
        spread.mapInPandas(walk, _WALKED).write.parquet(target)
        rounds.append(target)
        stored = spark.read.parquet(target).filter(F.col("kind") == "dir")
        if only is not None:
            stored = stored.join(only, ["host", "repo"], "left_semi")
        waiting = stored.count()
        if not waiting:
            break
        open_dirs = stored.select("host", "repo", "rel_path")
        tasks = min(waiting, 4 * parallelism(spark))
    listed = spark.read.parquet(*rounds).filter(F.col("kind") == kind)
    return with_path_parts(listed).select(
        "host", "repo", "rel_path", "dir", "name", "suffix", "size"
    )


def _reader(root: str, max_bytes: int):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for host, repo, rel in zip(batch["host"], batch["repo"], batch["rel_path"]):
                text = error = None
                try:
                    with open(_raw(os.path.join(root, host, repo, rel)), "rb") as file:
                        data = file.read(max_bytes + 1)
                    if len(data) > max_bytes:
                        raise OverflowError(f"more than {max_bytes} bytes; see read_chunks")
                    held += len(data)
                    text = data.decode("utf-8")
                except (OSError, UnicodeDecodeError, OverflowError) as problem:
                    error = f"{type(problem).__name__}: {problem}"
                rows.append((host, repo, rel, text, error))
                if held >= _BYTES_PER_BATCH:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)

    columns = ["host", "repo", "rel_path", "content", "read_error"]
    return read


def read_contents(
    files: DataFrame, root: str, bytes_per_task: int = 512 << 20, *, max_bytes: int = MAX_CONTENT
) -> DataFrame:
    """A10: whole text of the listed files; a file that is unreadable, not UTF-8 or longer
    than one value may be has no content and says why (:func:`read_chunks` reads the last).

    Filter the listing first. The paths are spread by hash before any content is
    read, so the files of one large repository do not share a task, and only
    paths move in that shuffle.
    """
    spark = files.sparkSession
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = max(parallelism(spark), -(-total // bytes_per_task))
    paths = files.select("host", "repo", "rel_path").repartition(tasks, "host", "repo", "rel_path")
    read = paths.mapInPandas(
        _reader(local_root(root), max_bytes),
        "host string, repo string, rel_path string, content string, read_error string",
    )
    # Columns of the listing are rebuilt from the path instead of joined back.
    return with_path_parts(read).withColumn(
        "file_path", F.concat_ws("/", "host", "repo", "rel_path")
    )


def _chunker(root: str, chunk_bytes: int):
    columns = ["host", "repo", "rel_path", "offset", "data", "read_error"]

    def chunks(file) -> Iterator[bytes]:
        held = b""
        while data := file.read(chunk_bytes - len(held)):
            held += data
            if len(held) == chunk_bytes:
                stop = held.rfind(b"\n") + 1 or chunk_bytes
                yield held[:stop]
                held = held[stop:]
        if held:
            yield held

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for host, repo, rel in zip(batch["host"], batch["repo"], batch["rel_path"], strict=True):
                offset = 0
                try:
                    with open(_raw(os.path.join(root, host, repo, rel)), "rb") as file:
                        for data in chunks(file):
                            rows.append((host, repo, rel, offset, data, None))
                            offset += len(data)
                            size += len(data)
                            if size >= _BYTES_PER_BATCH:
                                yield pd.DataFrame(rows, columns=columns)
                                rows, size = [], 0
                except OSError as problem:
                    rows.append((host, repo, rel, offset, None, f"{type(problem).__name__}: {problem}"))
            yield pd.DataFrame(rows, columns=columns)

    return read


def read_chunks(
    files: DataFrame, root: str, bytes_per_task: int = 512 << 20, *, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """A10 for files of any size: ``host, repo, rel_path, offset, data, read_error, file_path``.

    A chunk ends behind its last line feed; only a line that is longer than a chunk is cut
    inside. The chunks of a file, in the order of ``offset``, are its bytes. An empty file has
    no chunk; one that cannot be read (to its end) has a row that says why."""
    spark = files.sparkSession
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = max(parallelism(spark), -(-total // bytes_per_task))
    paths = files.select("host", "repo", "rel_path").repartition(tasks, "host", "repo", "rel_path")
    found = paths.mapInPandas(
        _chunker(local_root(root), chunk_bytes),
        "host string, repo string, rel_path string, offset long, data binary, read_error string",
    )
    return found.withColumn("file_path", F.concat_ws("/", "host", "repo", "rel_path"))


def chunk_facts(chunks: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """Per file ``file_path, size, lines``, and for every named pattern whether a line matches
    it, folded over the chunks: no content is put together again. A file with a chunk that
    could not be read is left out."""
    text = F.col("data").cast("string")
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    found = [F.bool_or(text.rlike(f"(?m){p}")).alias(name) for name, p in (patterns or {}).items()]
    open_end = F.max_by((F.expr("right(cast(data as string), 1)") != "\n").cast("long"), "offset")
    return chunks.groupBy("file_path").agg(
        F.sum(F.octet_length("data")).cast("long").alias("size"),
        (F.sum(feeds) + open_end).cast("long").alias("lines"),
        *found, F.count("read_error").alias("_bad"),
    ).filter("_bad = 0").drop("_bad")


def _digester(root: str, chunk_bytes: int):
    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, repo, rel in zip(batch["host"], batch["repo"], batch["rel_path"], strict=True):
                state = error = None
                try:
                    with open(_raw(os.path.join(root, host, repo, rel)), "rb") as file:
                        state = hashlib.sha256()
                        while data := file.read(chunk_bytes):
                            state.update(data)
                except OSError as problem:
                    state, error = None, f"{type(problem).__name__}: {problem}"
                rows.append((host, repo, rel, state and state.hexdigest(), error))
            yield pd.DataFrame(rows, columns=["host", "repo", "rel_path", "content_digest", "read_error"])

    return digest


def digest_files(files: DataFrame, root: str, *, bytes_per_task: int = 512 << 20, chunk_bytes: int = 1 << 20) -> DataFrame:
    """``host, repo, rel_path, content_digest, read_error, file_path`` of the listed files: the
    SHA-256 of their bytes, taken where they lie. A file of any size is read in chunks; no
    content leaves its task. An unreadable file has no digest and says why."""
    spark = files.sparkSession
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = max(parallelism(spark), -(-total // bytes_per_task))
    paths = files.select("host", "repo", "rel_path").repartition(tasks, "host", "repo", "rel_path")
    found = paths.mapInPandas(
        _digester(local_root(root), chunk_bytes),
        "host string, repo string, rel_path string, content_digest string, read_error string",
    )
    return found.withColumn("file_path", F.concat_ws("/", "host", "repo", "rel_path"))


def write_tree(files: DataFrame, root: str) -> int:
    """Write ``(host, repo, rel_path, content)`` as a tree; returns the number of files."""
    root = local_root(root)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for host, repo, rel, text in batch.itertuples(index=False):
                target = os.path.join(root, host, repo, rel)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target, "wb") as file:
                    file.write((text or "").encode("utf-8"))
            yield pd.DataFrame({"written": [len(batch)]})

    done = files.select("host", "repo", "rel_path", "content").mapInPandas(write, "written long")
    return done.agg(F.coalesce(F.sum("written"), F.lit(0))).first()[0]
