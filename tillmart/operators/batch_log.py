"""The log of submitted batches. One row per batch; it is small beside the data."""

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillmart.operators.quality import NEEDS_REVIEW, issues_json, parse_issues
from tillmart.schemas import INGESTION_LOG

HISTORY_LIMIT = 50


def log_entries(
    disposed: DataFrame,
    submitted_at: dt.datetime | Column,
    last_batch_id: int = 0,
    order: str = "batch_key",
    filename: str | Column = "batch_key",
) -> DataFrame:
    """Log rows for scored and disposed batches, numbered after ``last_batch_id``.

    The number is a label given by the single writer; ``batch_key`` identifies the batch.
    """
    number = F.row_number().over(Window.orderBy(order)) + F.lit(last_batch_id)
    when = submitted_at if isinstance(submitted_at, Column) else F.lit(_in_utc(submitted_at))
    values = {
        "batch_id": number,
        "submitted_at": when,
        "filename": F.col(filename) if isinstance(filename, str) else filename,
        "issues_json": issues_json(F.col("issues")),
    }
    return disposed.select(*[
        values.get(entry.name, F.col(entry.name)).cast(entry.dataType).alias(entry.name) for entry in INGESTION_LOG
    ])


def _in_utc(moment: dt.datetime) -> dt.datetime:
    """A time without zone means UTC; as a literal it would be read in the driver's zone."""
    return moment if moment.tzinfo else moment.replace(tzinfo=dt.timezone.utc)


def history(log: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """Newest submissions first."""
    return log.orderBy(F.desc("batch_id")).limit(limit)


def pending(log: DataFrame) -> DataFrame:
    """Submissions that need review, newest first. One merged by force stays here: there is no resolve step."""
    return log.where(F.col("status") == NEEDS_REVIEW).orderBy(F.desc("batch_id"))


def pending_count(log: DataFrame) -> DataFrame:
    return log.agg(F.count_if(F.col("status") == NEEDS_REVIEW).alias("pending"))


def failed_issues(log: DataFrame) -> DataFrame:
    """Failed checks of the pending batches. Absent ``passed`` counts as passed, unreadable text as no issue."""
    failed = F.filter(parse_issues(F.col("issues_json")), lambda issue: ~F.coalesce(issue["passed"], F.lit(True)))
    waiting = log.where(F.col("status") == NEEDS_REVIEW)
    return waiting.select("batch_id", F.inline(failed)).select("batch_id", "name", "count", "desc")


# Headings of the history table.
HISTORY_HEADINGS = {
    "batch_id": "ID",
    "submitted_at": "Submitted",
    "filename": "File",
    "row_count": "Rows",
    "status": "Status",
    "health_score": "Health %",
    "accepted_rows": "Accepted",
    "rejected_rows": "Rejected",
}


def history_table(log: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    return history(log, limit).select(*[F.col(name).alias(heading) for name, heading in HISTORY_HEADINGS.items()])
