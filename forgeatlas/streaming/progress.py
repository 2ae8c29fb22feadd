"""Resumable metrics as a stream over a folder of file manifests (K1)."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from forgeatlas.operators.content_metrics import DIGEST, Reader, contents_of, listing, measure_listed
from forgeatlas.schemas import CODE_METRICS, MEASURED_CONTENT
from forgeatlas.session import parallelism, scratch_path
from forgeatlas.sources.tables import read_table

MANIFEST = "file_path string, content string"
PATHS_ONLY = f"file_path string, {DIGEST} string"
_PARTITIONS = "spark.sql.shuffle.partitions"
_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
KEEP_SECONDS = 90 * 24 * 3600
# Groups of paths in the state; a checkpoint is bound to the number. A batch reads and writes
# the entries of the buckets that its paths fall into.
STATE_BUCKETS = 1024
# Every partition of the state is loaded and stored by every batch: a few per core are enough.
STATE_PARTS = 2
_STORED = T.StructType([*MEASURED_CONTENT.fields, T.StructField("batch_id", T.LongType())])
_CHANGED = f"file_path string, {DIGEST} string, manifest string"


def _changes(keep_ms: int):
    """Passes a file when it is new, when its digest is not the last one, or when it was not
    listed for the time that state is kept.

    The paths of a bucket share a state, ``{path: [digest, seen]}``: a group costs much more
    than an entry. Every entry has its own time and leaves when that is over."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        kept = json.loads(state.get[0]) if state.exists else {}
        newest: dict[str, tuple] = {}
        if not state.hasTimedOut:
            for frame in frames:
                for path, *row in zip(frame["file_path"], frame["listed"], frame["manifest"], frame[DIGEST], strict=True):
                    row = (row[0], row[1], row[2] or "")
                    if path not in newest or row > newest[path]:
                        newest[path] = row
        passed = []
        kept = {path: entry for path, entry in kept.items() if now - entry[1] <= keep_ms}
        for path, (_, manifest, digest) in newest.items():
            if path not in kept or kept[path][0] != digest:
                passed.append((path, digest or None, manifest))
            kept[path] = [digest, now]
        if passed:
            yield pd.DataFrame(passed, columns=["file_path", DIGEST, "manifest"])
        if not kept:
            state.remove()
            return
        state.update((json.dumps(kept, ensure_ascii=False),))
        oldest = min(seen for _, seen in kept.values())
        state.setTimeoutDuration(max(1, oldest + keep_ms - now))

    return step


def measure_stream(
    spark: SparkSession,
    manifests: str,
    target: str,
    checkpoint: str,
    *,
    files_per_batch: int = 100,
    done: DataFrame | None = None,
    read: Reader | None = None,
    keep_seconds: float = KEEP_SECONDS,
) -> StreamingQuery:
    """Measure the files of new manifests whose content is not the one measured last.

    State holds the last digest of every path and nothing else; it leaves the store when a path
    was not listed for ``keep_seconds``, after which it passes like a new one. Contents are not
    shuffled: the digest is taken where a manifest is scanned, and a batch reads the contents
    of what has passed. Manifests carry contents (``MANIFEST``); with ``read``, which gives the
    contents of paths, they carry digests (``PATHS_ONLY``). Of several listings of a path in
    one batch the one of the newest manifest counts. ``done`` names files measured elsewhere,
    by path, or by path and digest if it has digests.

    The unit of progress is the micro-batch: it writes only its own folder and replaces it when
    it is replayed after a failure, so every change is in the result once. The sizes of a batch
    are bounded by ``files_per_batch`` manifests.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # One evaluation: the state of a batch is locked by the job that updates it. What follows
        # runs in the caller's session; that of a stream has no adaptive execution, so that a
        # batch of any size would take all shuffle partitions at every step.
        folder = scratch_path(spark, "changed")
        batch.write.parquet(folder)
        changed = spark.read.schema(_CHANGED).parquet(folder)
        reader = read
        if reader is None:
            names = [unquote(r["manifest"]) for r in changed.select("manifest").distinct().collect()]
            rows = spark.read.schema(MANIFEST).parquet(*names) if names else spark.createDataFrame([], MANIFEST)
            reader = contents_of(rows)
        measured_ = measure_listed(changed, reader)
        measured_.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    rows = (
        spark.readStream.schema(MANIFEST if read is None else PATHS_ONLY)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(manifests)
        .withColumns({
            "manifest": F.col("_metadata.file_path"),
            "listed": F.unix_millis(F.col("_metadata.file_modification_time")),
        })
    )
    digest = F.sha2(F.col("content").cast("binary"), 256) if read is None else F.col(DIGEST)
    listed = rows.filter("file_path IS NOT NULL").select("file_path", digest.alias(DIGEST), "manifest", "listed")
    if done is not None:
        keys = ["file_path", *([DIGEST] if DIGEST in done.columns else [])]
        listed = listed.join(done.select(keys).distinct(), keys, "left_anti")
    bucket = F.pmod(F.xxhash64("file_path"), F.lit(STATE_BUCKETS)).alias("bucket")
    passed = listed.select(bucket, *listed.columns).groupBy("bucket").applyInPandasWithState(
        _changes(int(keep_seconds * 1000)), _CHANGED, "entries string", "update",
        GroupStateTimeout.ProcessingTimeTimeout,
    )
    writer = (
        passed.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    # A stream takes over the settings at its start; a checkpoint keeps its partitions. State that
    # can time out would otherwise ask for one empty batch after the other, and a run would not end.
    parts = min(int(spark.conf.get(_PARTITIONS)), STATE_PARTS * parallelism(spark))
    wanted = {_EMPTY_BATCHES: "false", _PARTITIONS: str(parts)}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        return writer.start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def measured(spark: SparkSession, target: str, *, history: bool = False) -> DataFrame:
    """The metrics so far: of every file those of its last content, or with ``history`` of all
    contents, with digest and batch."""
    rows = read_table(spark, target, _STORED)
    if history:
        return rows
    last = rows.groupBy("file_path").agg(F.max_by(F.struct(*rows.columns), "batch_id").alias("last"))
    return last.select("last.*").select(CODE_METRICS.names)


__all__ = ["MANIFEST", "PATHS_ONLY", "listing", "measure_stream", "measured"]
