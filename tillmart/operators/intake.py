"""Taking files in: read, clean, score, then merge, hold or refuse, and log."""

import datetime as dt
import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillmart.functions.numbers import fits
from tillmart.operators import merge, normalise, quality
from tillmart.operators.batch_log import log_entries
from tillmart.operators.cleaning import CleanBatch, UnknownLayout, clean_batch, clean_bulk
from tillmart.operators.numbering import number_file_rows
from tillmart.operators.staging import staging_scope
from tillmart.schemas import AMOUNT, CANONICAL_COLUMNS, ISSUE, NUMERIC_DEFAULTS
from tillmart.sources.flat_file import files_left_open, first_line, list_files, parts_differ, read_flat_parts, read_header
from tillmart.sources.store import BULK, StarStore


# Files taken in one pass. Bounds what the driver holds and the tables of one row per file,
# which are broadcast: a join by shuffle would send a large file to one task.
FILES_PER_COMMIT = 500


# A line with more fields than the header has columns: nobody can tell which field is which.
BEYOND = "_beyond IS NOT NULL"
TOO_WIDE = "a line has more fields than the header has columns"

OPEN_QUOTE = "a quote is open at the end of a line"
UNCLOSED = "a quote is still open at the end of the file"

OTHER_HEADER = "the parts of the folder begin with different header lines"

# Refuses a batch, whatever its score: an amount would be lost in the store.
AMOUNT_RANGE = quality.Rule(
    "Amount Range", "error", "Rows with an amount that the store cannot hold",
    lambda day: reduce(Column.__or__, [~fits(F.col(name)) for name in NUMERIC_DEFAULTS]),
)


@dataclass(frozen=True)
class Submission:
    """One uploaded file. ``file_id`` is its path as Spark reports it for a row."""

    batch_key: str
    path: str
    filename: str
    file_id: str | None = None


def submissions(files: DataFrame) -> list[Submission]:
    """Files listed by the binaryFile source, in path order. A file is known by its path and change time.

    The caller bounds the number of files; their contents are not read.
    """
    key = F.sha2(F.concat_ws("|", "path", F.col("modificationTime").cast("string")), 256).alias("batch_key")
    name = F.element_at(F.split("path", "/"), -1).alias("filename")
    listed = files.select(key, "path", name, F.col("_metadata.file_path").alias("file_id")).orderBy("path")
    return [Submission(**row.asDict()) for row in listed.collect()]


def empty_files(spark: SparkSession, pattern: str) -> Iterator[Submission]:
    """Zero-byte files, which the binaryFile source does not list."""
    for path, changed, length in list_files(spark, pattern):
        if length == 0:
            key = hashlib.sha256(f"{path}|{changed}|empty".encode()).hexdigest()
            yield Submission(key, path, path.rsplit("/", 1)[-1], path)


def commit_key_of(batch_keys: list[str]) -> str:
    """The same files always give the same key, so a replay meets its own earlier attempt."""
    return hashlib.sha256("\n".join(sorted(batch_keys)).encode()).hexdigest()[:32]


def _read_rows(store: StarStore, path: str, multi_line: bool) -> DataFrame:
    """Numbered rows of a file or folder, if its columns can be told apart."""
    if parts_differ(store.spark, path):
        raise UnknownLayout(OTHER_HEADER)
    if not multi_line and not files_left_open(store.spark, path).isEmpty():
        raise UnknownLayout(OPEN_QUOTE)
    rows, unclosed = read_flat_parts(store.spark, path, multi_line=multi_line)
    if unclosed:
        raise UnknownLayout(UNCLOSED)
    raw = number_file_rows(rows)
    if not raw.where(BEYOND).isEmpty():
        raise UnknownLayout(TOO_WIDE)
    return raw


def read_submission(store: StarStore, submission: Submission, as_of: dt.datetime, multi_line: bool = False) -> CleanBatch:
    """Cleaned rows of one file, or of one folder of parts with a common header."""
    raw = _read_rows(store, submission.path, multi_line)
    return clean_batch(raw.withColumn("batch_key", F.lit(submission.batch_key)), as_of, exact=True)


def read_submissions(
    store: StarStore, submissions: list[Submission], as_of: dt.datetime, multi_line: bool = False
) -> tuple[DataFrame | None, dict[str, str], dict[str, CleanBatch]]:
    """(cleaned rows of all files, reasons of files that cannot be mapped, mapping and warnings of the others).

    Files with the same header line are read by one scan. Only header lines and the file
    list, whose length the caller bounds, pass through the driver.
    """
    spark = store.spark
    by_line = defaultdict(list)
    refused = {}
    if not multi_line:
        open_files = {row._file for row in files_left_open(spark, [s.path for s in submissions]).collect()}  # some of the submissions
        refused = {s.batch_key: OPEN_QUOTE for s in submissions if s.file_id in open_files}
    for submission in submissions:
        if submission.batch_key in refused:
            continue
        line = [first_line(spark, submission.path)]
        if multi_line and '"' in (line[0] or ""):  # a line break may lie in the header: Spark reads it whole
            line = [None, *read_header(spark, submission.path, multi_line)]
        by_line[tuple(line)].append(submission)
    parts, unreadable, cleaned = [], refused, {}
    for members in by_line.values():
        header = read_header(spark, members[0].path, multi_line)
        rows, unclosed = read_flat_parts(spark, [m.path for m in members], header, multi_line)
        unreadable.update({m.batch_key: UNCLOSED for m in members if m.file_id in unclosed})
        members = [m for m in members if m.file_id not in unclosed]
        if not members:
            continue
        raw = number_file_rows(rows, per_file=True)
        keys = spark.createDataFrame([(m.file_id, m.batch_key) for m in members], "_file string, batch_key string")
        # A file id that matches no submission is a mistake of the caller: fail, do not lose the rows.
        known = F.coalesce("batch_key", F.raise_error(F.concat(F.lit("no submission for "), "_file")))
        raw = raw.join(F.broadcast(keys), "_file", "left").withColumn("batch_key", known)
        wide = [row.batch_key for row in raw.where(BEYOND).select("batch_key").distinct().collect()]  # some of the members
        unreadable.update({key: TOO_WIDE for key in wide})
        try:
            batch = clean_batch(raw.where(~F.col("batch_key").isin(wide)) if wide else raw, as_of, exact=True)
            parts.append(batch.rows)
            cleaned.update({m.batch_key: batch for m in members if m.batch_key not in wide})
        except UnknownLayout as error:
            unreadable.update({m.batch_key: str(error) for m in members})
    return (reduce(DataFrame.unionByName, parts) if parts else None), unreadable, cleaned


def _ranged(score: Row) -> Row:
    """The batch is refused when an amount is out of range; otherwise that check is not listed."""
    *issues, beyond = score.issues
    changed = {"issues": issues} if beyond.passed else {"status": quality.REJECTED}
    return Row(**score.asDict() | changed)


def _scores(rows: DataFrame | None, store: StarStore, keys: list[str], unreadable: dict[str, str], as_of: dt.date) -> DataFrame:
    """Scores of every submission: files without rows or without a known column are scored as empty."""
    rules = (*quality.RULES, AMOUNT_RANGE)
    scored = [] if rows is None else [_ranged(row) for row in quality.score_batches(rows, as_of, ["batch_key"], rules).collect()]
    seen = {row.batch_key for row in scored}
    empty_frame = store.spark.createDataFrame([], "quantity double, sales double, discount double, order_date date, ship_date date, customer_name string, product_name string")
    empty = quality.score_batches(empty_frame, as_of).first() if len(seen) < len(keys) else None
    for key in keys:
        if key in unreadable:
            problem = Row(name="Column Mapping", severity="error", count=0, desc=unreadable[key], passed=False)
            scored.append(Row(batch_key=key, row_count=0, issues=[problem], health_score=0.0, status=quality.REJECTED, checks_ran=False))
        elif key not in seen:
            scored.append(Row(batch_key=key, **empty.asDict()))
    schema = f"batch_key string, row_count bigint, issues array<{ISSUE.simpleString()}>, health_score double, status string, checks_ran boolean"
    columns = ("batch_key", "row_count", "issues", "health_score", "status", "checks_ran")
    return store.spark.createDataFrame([tuple(row[name] for name in columns) for row in scored], schema)


def _only(rows: DataFrame, decisions: DataFrame, action: str) -> DataFrame:
    """Rows of the batches with this action."""
    keys = decisions.where(F.col("action") == action).select("batch_key")
    return rows.join(F.broadcast(keys), "batch_key", "left_semi")


def settle(
    store: StarStore,
    rows: DataFrame | None,
    submissions: list[Submission],
    unreadable: dict[str, str],
    as_of: dt.datetime,
    on_review: str,
    cleaned: dict[str, CleanBatch],
    prefix: str = "",
) -> list[Row]:
    """Score all batches in one job, merge the accepted ones in one pass, log every one under a key with the prefix.

    A decision carries the batch's ``columns`` (canonical name to header name) and ``warnings``.
    """
    spark = store.spark
    keys = [submission.batch_key for submission in submissions]
    decisions = quality.disposition(_scores(rows, store, keys, unreadable, as_of.date()), on_review).collect()
    names = {submission.batch_key: submission.filename for submission in submissions}
    place = {key: number for number, key in enumerate(keys)}
    decisions.sort(key=lambda row: place[row.batch_key])
    first, table = 0, []
    for row in decisions:
        table.append((*row, names[row.batch_key], place[row.batch_key], first))
        first += row.accepted_rows
    columns = [*decisions[0].__fields__, "filename", "place", "rows_before"]
    schema = (
        f"batch_key string, row_count bigint, issues array<{ISSUE.simpleString()}>, health_score double, status string, "
        "checks_ran boolean, action string, accepted_rows bigint, rejected_rows bigint, filename string, place int, rows_before bigint"
    )
    decided = spark.createDataFrame(table, schema).select(*columns)
    commit_key = prefix + commit_key_of(keys)
    store.discard(commit_key)
    log = store.log()
    entries = log_entries(decided, as_of, merge.highest(log, "batch_id"), order="place", filename="filename")
    actions = {row.action for row in decisions}
    new = None
    if "merge" in actions:
        taken = decided.where("action = 'merge'").select("batch_key", "rows_before")
        accepted = rows.join(F.broadcast(taken), "batch_key").withColumn("row_id", F.col("rows_before") + F.col("row_no"))
        new = merge.plan_merge(accepted, store.star(), batch_rows=first)
    if rows is not None and "reject" in actions:
        # Rounded as the store would, but for an amount that it cannot hold.
        shown = {name: F.coalesce(F.col(name).try_cast(AMOUNT).cast("string"), F.col(name).cast("string")) for name in NUMERIC_DEFAULTS}
        refused = _only(rows, decided, "reject").select("batch_key", *CANONICAL_COLUMNS).withColumns(shown)
        store.quarantine(refused, commit_key)
    store.commit(new, entries, commit_key)
    return [Row(**row.asDict(), **_notes(cleaned.get(row.batch_key))) for row in decisions]


def _notes(batch: CleanBatch | None) -> dict:
    """What a caller should know of how the file was understood."""
    return {"columns": batch.mapping.source_names() if batch else {}, "warnings": batch.warnings if batch else []}


def ingest_file(
    store: StarStore, path: str, as_of: dt.datetime, on_review: str = "hold", batch_key: str | None = None, multi_line: bool = False
) -> Row | None:
    """Gate one file. ``on_review`` says whether a batch that needs review is held or merged.

    A file that cannot be read is logged as rejected. ``multi_line`` allows line breaks inside quotes.

    Returns the decision, or None when ``batch_key`` is already logged. Without a key the
    path and submission time make one, so the same file sent twice counts twice.
    """
    filename = path.rstrip("/").rsplit("/", 1)[-1]
    key = batch_key or commit_key_of([path, as_of.isoformat()])
    if _logged(store, [key]):
        return None
    submission = Submission(key, path, filename)
    with staging_scope(store.spark):
        try:
            batch = read_submission(store, submission, as_of, multi_line)
            rows, unreadable, cleaned = batch.rows, {}, {key: batch}
        except UnknownLayout as error:
            rows, unreadable, cleaned = None, {key: str(error)}, {}
        return settle(store, rows, [submission], unreadable, as_of, on_review, cleaned)[0]


def ingest_files(
    store: StarStore, submissions: list[Submission], as_of: dt.datetime, on_review: str = "hold", multi_line: bool = False, attempt: str = ""
) -> list[Row]:
    """Gate many files, up to ``FILES_PER_COMMIT`` in one pass; files already logged are skipped.

    Earlier files win over later ones. ``attempt`` names a unit of work that is repeated when it fails: all that
    earlier tries left under it without a log row is removed first, so a repeat may group the files otherwise.
    """
    prefix = f"{attempt}-" if attempt else ""
    if prefix:
        store.discard_unlogged(prefix)
    decisions = []
    for start in range(0, len(submissions), FILES_PER_COMMIT):
        part = submissions[start : start + FILES_PER_COMMIT]
        logged = _logged(store, [submission.batch_key for submission in part])
        fresh = [submission for submission in part if submission.batch_key not in logged]
        if fresh:
            with staging_scope(store.spark):
                rows, unreadable, cleaned = read_submissions(store, fresh, as_of, multi_line)
                decisions += settle(store, rows, fresh, unreadable, as_of, on_review, cleaned, prefix)
    return decisions


def _logged(store: StarStore, keys: list[str]) -> set[str]:
    found = store.log().where(F.col("batch_key").isin(keys)).select("batch_key").distinct()
    return {row.batch_key for row in found.collect()}


def bulk_load(store: StarStore, path: str, as_of: dt.datetime, export_folder: str | None = None, multi_line: bool = False) -> None:
    """Load a store from a flat file: clean, normalise, replace the five tables. It is not gated.

    The file is parsed once, into the staged table; the five tables each read their
    columns of it. What was stored before stays readable until the load's log row is
    written, and is deleted afterwards.
    """
    key = BULK + uuid.uuid4().hex
    with staging_scope(store.spark):
        raw = _read_rows(store, path, multi_line)
        flat = clean_bulk(raw).withColumnRenamed("row_no", "row_id")
        entry = flat.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(key).alias("batch_key"),
            "row_count",
            F.lit([]).cast(T.ArrayType(ISSUE)).alias("issues"),
            F.lit(None).cast("double").alias("health_score"),
            F.lit(quality.ACCEPTED).alias("status"),
            F.col("row_count").alias("accepted_rows"),
            F.lit(0).alias("rejected_rows"),
        )
        filename = F.lit(path.rstrip("/").rsplit("/", 1)[-1])
        last = merge.highest(store.log(), "batch_id")
        store.commit(normalise.normalise(flat), log_entries(entry, as_of, last, filename=filename), key)
        store.remove_replaced()
    if export_folder:
        store.export_csv(export_folder)
