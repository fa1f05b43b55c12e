"""The quality gate over a folder of incoming files."""

import datetime as dt
from collections.abc import Callable
from itertools import batched

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tillmart.operators.intake import FILES_PER_COMMIT, Submission, commit_key_of, empty_files, ingest_files, submissions
from tillmart.sources.store import StarStore


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def watch_folder(
    store: StarStore,
    inbox: str,
    checkpoint: str,
    on_review: str = "hold",
    files_per_trigger: int = FILES_PER_COMMIT,
    clock: Callable[[], dt.datetime] = _now,
    name_filter: str = "*.csv",
    multi_line: bool = False,
) -> StreamingQuery:
    """Gate every file that is in the folder, then stop; start again for later files.

    The stream carries file names only: a CSV stream would map columns by position and
    mix files whose headers differ. Each file is one batch, known by path and change
    time. Commits carry the stream's name and the epoch: a replayed epoch skips the files
    that are logged and first removes whatever else its earlier tries left, even if it now
    groups the files otherwise. Files must appear whole, by a move into the folder.
    Files without a byte are logged first: the stream has no row for them.
    """
    names = (
        store.spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", name_filter)
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(inbox)
        .select("path", "modificationTime", "_metadata")
    )

    stream = commit_key_of([checkpoint.rstrip("/")])[:16]

    def take(found: list[Submission], epoch: str) -> None:
        ingest_files(store, found, clock(), on_review, multi_line, attempt=f"stream-{stream}-{epoch}")

    def gate(files: DataFrame, epoch: int) -> None:
        found = submissions(files)
        if found:
            take(found, str(epoch))

    for files in batched(empty_files(store.spark, f"{inbox}/{name_filter}"), FILES_PER_COMMIT):
        take(list(files), "empty")
    return names.writeStream.foreachBatch(gate).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
