"""The quality gate: rules as data, one pass over any number of batches."""

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmart.functions.numbers import round_tenth
from tillmart.schemas import ISSUE, TEXT_DEFAULTS


@dataclass(frozen=True)
class Rule:
    """Counts the rows that meet ``condition``; a function of the submission day."""

    name: str
    severity: str
    desc: str
    condition: Callable[[dt.date], Column]


# Names, severities and descriptions of the checks.
RULES = (
    Rule("Negative Quantities", "warning", "Rows with zero or negative quantity", lambda day: F.col("quantity") <= 0),
    Rule("Null or Zero Sales", "warning", "Rows with no sales value", lambda day: F.col("sales").isNull() | (F.col("sales") == 0)),
    Rule("Extreme Discounts", "warning", "Discount exceeding 100%", lambda day: F.col("discount") > 1),
    Rule("Future Order Dates", "warning", "Orders dated in the future", lambda day: F.col("order_date") > F.lit(day)),
    Rule("Ship Before Order", "warning", "Ship date is earlier than order date", lambda day: F.col("ship_date") < F.col("order_date")),
    Rule(
        "Missing Customer Names", "info", "Rows with placeholder customer names",
        lambda day: F.col("customer_name") == TEXT_DEFAULTS["customer_name"],
    ),
    Rule(
        "Missing Product Names", "info", "Rows with placeholder product names",
        lambda day: F.col("product_name") == TEXT_DEFAULTS["product_name"],
    ),
)

# Lowest health score of each verdict, and the severities that lower the score.
ACCEPTED, NEEDS_REVIEW, REJECTED = "Accepted", "Needs Review", "Rejected"
ACCEPT_FROM, REVIEW_FROM = 80, 50
SCORED_SEVERITIES = ("warning", "critical")


def _failure(rows: DataFrame, rule: Rule, day: dt.date) -> str | None:
    """Why a rule cannot run on these columns; found by the analyser, no job is run."""
    try:
        rows.select(rule.condition(day))
    except AnalysisException as error:
        return f"Check failed to run: {error.getCondition() or 'analysis error'}"
    return None


def health(flagged: Column, row_count: Column) -> Column:
    """Percentage of rows not flagged, at least 0, to one decimal. A row that fails two checks counts twice."""
    share = F.greatest(F.lit(0.0), 1 - F.try_divide(flagged.cast("double"), row_count.cast("double")))
    return F.when(row_count > 0, round_tenth(share * 100)).otherwise(F.lit(0.0))


def verdict(score: Column) -> Column:
    return F.when(score >= ACCEPT_FROM, ACCEPTED).when(score >= REVIEW_FROM, NEEDS_REVIEW).otherwise(REJECTED)


def score_batches(
    rows: DataFrame, as_of: dt.date, by: Sequence[str] = (), rules: Sequence[Rule] = RULES
) -> DataFrame:
    """One row per batch: row_count, issues, health_score, status and ``checks_ran``.

    All rules are counted in one aggregate. Counts combine map-side, so the largest
    batch costs no more per task than any other. ``checks_ran`` is false when a rule
    could not run; its issue then has severity error and does not lower the score.
    """
    failures = {rule.name: _failure(rows, rule, as_of) for rule in rules}
    working = [(n, rule) for n, rule in enumerate(rules) if failures[rule.name] is None]
    counts = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count_if(rule.condition(as_of)).alias(f"_r{n}") for n, rule in working],
    )

    def issue(n: int, rule: Rule) -> Column:
        failure = failures[rule.name]
        count = F.col(f"_r{n}") if failure is None else F.lit(0).cast("bigint")
        return F.struct(
            F.lit(rule.name).alias("name"),
            F.lit("error" if failure else rule.severity).alias("severity"),
            count.alias("count"),
            F.lit(failure or rule.desc).alias("desc"),
            (F.lit(False) if failure else count == 0).alias("passed"),
        )

    flagged = F.lit(0)
    for n, rule in working:
        if rule.severity in SCORED_SEVERITIES:
            flagged = flagged + F.col(f"_r{n}")
    return (
        counts.withColumn("issues", F.array(*[issue(n, rule) for n, rule in enumerate(rules)]))
        .withColumn("health_score", health(flagged, F.col("row_count")))
        .withColumn("status", verdict(F.col("health_score")))
        .withColumn("checks_ran", F.lit(not any(failures.values())))
        .select(*by, "row_count", "issues", "health_score", "status", "checks_ran")
    )


def issues(scores: DataFrame, *keep: str) -> DataFrame:
    """One row per batch and check."""
    return scores.select(*keep, F.inline("issues"))


def display_class(passed: Column, severity: Column) -> Column:
    return F.when(passed | (severity == "info"), "pass").when(severity == "warning", "warn").otherwise("fail")


def classified_issues(scores: DataFrame, *keep: str) -> DataFrame:
    """Issues with their display class and the batch's number of passed checks."""
    passed = F.size(F.filter("issues", lambda issue: issue["passed"])).alias("checks_passed")
    rows = scores.select(*keep, passed, F.inline("issues"))
    return rows.withColumn("issue_class", display_class(F.col("passed"), F.col("severity")))


def disposition(scores: DataFrame, on_review: str = "hold") -> DataFrame:
    """What happens to each batch: merge, hold or reject, with the rows taken and refused.

    A batch whose checks did not all run is never merged unasked: it is held like one
    that needs review.
    """
    if on_review not in ("hold", "merge"):
        raise ValueError("on_review is 'hold' or 'merge'")
    sound = (F.col("status") == ACCEPTED) & F.col("checks_ran")
    action = F.when(F.col("status") == REJECTED, "reject").when(sound, "merge").otherwise(on_review)
    merged = F.col("action") == "merge"
    return (
        scores.withColumn("action", action)
        .withColumn("status", F.when((F.col("status") == ACCEPTED) & ~F.col("checks_ran"), NEEDS_REVIEW).otherwise(F.col("status")))
        .withColumn("accepted_rows", F.when(merged, F.col("row_count")).otherwise(0))
        .withColumn("rejected_rows", F.when(merged, 0).otherwise(F.col("row_count")))
    )


def issues_json(issues_column: Column) -> Column:
    return F.to_json(issues_column)


def parse_issues(text: Column) -> Column:
    """Issues from JSON text; null when it cannot be read."""
    return F.from_json(text, f"array<{ISSUE.simpleString()}>")
