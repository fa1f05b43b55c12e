"""Conversion funnels: estimated from orders, and observed on an event log."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillmart.functions.numbers import percent, ratio, round2
from tillmart.plans.overview import customer_place_totals
from tillmart.plans.star import EVERYTHING, Slice, Star

# Stage, visits per order, value per unit of revenue.
FUNNEL_STAGES = (
    ("1. Session Started", "18.5", "22.0"),
    ("2. Product Viewed", "7.4", "8.5"),
    ("3. Added to Cart", "3.2", "3.8"),
    ("4. Checkout Initiated", "1.7", "2.0"),
    ("5. Completed Purchase", "1.0", "1.0"),
)
FIRST_STAGE, LAST_STAGE = FUNNEL_STAGES[0], FUNNEL_STAGES[-1]


def estimated_funnel(star: Star, scope: Slice = EVERYTHING) -> DataFrame:
    """Five stages scaled from order count and revenue. One aggregate row is exploded, the sales are read once."""
    base = customer_place_totals(star, scope).agg(
        F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"), F.sum("sales").alias("revenue")
    )
    stages = F.array(*[
        F.struct(
            F.lit(stage).alias("stage"),
            F.lit(visits).cast("decimal(4,1)").alias("visits"),
            F.lit(value).cast("decimal(4,1)").alias("value"),
        )
        for stage, visits, value in FUNNEL_STAGES
    ])
    return base.select("*", F.inline(stages)).select(
        "stage",
        (F.col("orders") * F.col("visits")).cast("bigint").alias("visitor_count"),
        round2(F.col("revenue") * F.col("value")).alias("estimated_val"),
        percent(F.col("visits"), F.lit(FIRST_STAGE[1])).alias("conversion_rate"),
    )


def funnel_summary(star: Star, scope: Slice = EVERYTHING) -> DataFrame:
    """Sessions, orders, sales and conversion; no row when there are no sessions."""

    def at(stage: tuple, name: str):
        return F.max(F.when(F.col("stage") == stage[0], F.col(name)))

    row = estimated_funnel(star, scope).agg(
        at(FIRST_STAGE, "visitor_count").alias("sessions"),
        at(LAST_STAGE, "visitor_count").alias("orders"),
        at(LAST_STAGE, "estimated_val").alias("sales"),
    )
    rate = (ratio(F.col("orders"), F.col("sessions")) * 100).alias("conversion_pct")
    return row.where("sessions > 0").select("*", rate)


def funnel_steps(star: Star, scope: Slice = EVERYTHING) -> DataFrame:
    """Each stage against the first and against the one before; the window holds five rows."""
    by_stage = Window.orderBy("stage")
    visitors = F.col("visitor_count")
    return estimated_funnel(star, scope).select(
        "stage",
        "visitor_count",
        percent(visitors, F.first("visitor_count").over(by_stage)).alias("pct_initial"),
        percent(visitors, F.lag("visitor_count").over(by_stage)).alias("step_rate"),
    )


def _transfer(events: Column, stages: tuple[str, ...]) -> Column:
    """For each stage reached before (0: none) the stage reached behind the events, which are (ts, event_type) in order of time."""
    wanted = F.array(*map(F.lit, stages))

    def behind(start: int) -> Column:
        state = F.struct(F.lit(start).alias("stage"), F.lit(None).cast("timestamp").alias("at"))

        def step(state: Column, event: Column) -> Column:
            # An event at the very time at which the stage before was reached does not count.
            moves = (F.get(wanted, state["stage"]) == event["event_type"]) & (state["at"].isNull() | (event["ts"] > state["at"]))
            moved = F.struct((state["stage"] + 1).alias("stage"), event["ts"].alias("at"))
            return F.when(F.coalesce(moves, F.lit(False)), moved).otherwise(state)

        return F.aggregate(events, state, step)["stage"]

    return F.array(*(behind(start) for start in range(len(stages))))


def observed_funnel(
    events: DataFrame,
    stages: tuple[str, ...] = ("view", "click", "signup", "purchase"),
    slice_seconds: int = 3600,
) -> DataFrame:
    """Users reaching each event type in order, each by its earliest event after the stage before.

    The events are read and shuffled once, by user and slice of time. What a slice does to a user is
    a map from the stage reached before it to the stage reached behind it; such maps are composed in
    order of time, so a user's events are never gathered, only one short map for each slice in which
    the user was seen. A user with a third of all events is spread over all slices.
    Rows without user, time or one of the stages play no part.
    """
    ts = F.col("ts").cast("timestamp")
    seen = events.where(F.col("event_type").isin(*stages) & F.col("user_id").isNotNull()).select("user_id", "event_type", ts.alias("ts")).where("ts IS NOT NULL")
    sliced = seen.groupBy("user_id", F.floor(F.unix_micros("ts") / (slice_seconds * 1_000_000)).alias("slice"))
    sliced = sliced.agg(F.array_sort(F.collect_list(F.struct("ts", "event_type"))).alias("events"))
    maps = sliced.select("user_id", "slice", F.get(F.transform(F.array("events"), lambda some: _transfer(some, stages)), F.lit(0)).alias("map"))
    users = maps.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("slice", "map"))).alias("maps"))
    reached = F.aggregate("maps", F.lit(0), lambda stage, one: F.coalesce(F.get(one["map"], stage), stage))  # beyond the last stage no map changes it
    counts = users.select(reached.alias("reached")).agg(*(F.count_if(F.col("reached") >= number).alias(f"n{number}") for number in range(1, len(stages) + 1)))
    rows = [F.struct(F.lit(number).alias("step"), F.lit(stage).alias("stage"), F.col(f"n{number}").alias("users")) for number, stage in enumerate(stages, start=1)]
    return counts.select(F.inline(F.array(*rows)))
