"""Consecutive row numbers without sorting everything in one task.

Rows are numbered inside the pieces they already lie in (file splits, or ranges of an
order key). Only the row count of each piece is summed up in order, and that table has
one short row per piece. The positions are staged first, so both uses see the same ones.

Rows that are brought together by a key anyhow, and whose order begins with that key, need no
ranges: only the row count of each key is summed up in order.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillmart.operators.staging import stage

_POSITION_BITS = 33  # monotonically_increasing_id keeps the row's place in its partition here


# Pieces are file splits or ranges: a few hundred thousand even for 100 TB. Up to this many
# their offsets (a path and two numbers each) are broadcast; beyond it Spark joins by shuffle.
BROADCAST_PIECES = 1_000_000


def _add_offsets(staged: DataFrame, keys: list[str], order: Window, name: str, start: int) -> DataFrame:
    pieces = staged.groupBy(*keys).agg(F.min("_seq").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    rows_before = F.sum("_rows").over(order) - F.col("_rows")
    offsets = stage(pieces.select(*keys, (rows_before - F.col("_first") + F.lit(start)).alias("_offset")), "offsets")
    if offsets.count() <= BROADCAST_PIECES:
        offsets = F.broadcast(offsets)
    numbered = staged.join(offsets, keys).withColumn(name, F.col("_seq") + F.col("_offset"))
    return numbered.drop("_seq", "_offset")


def number_rows(rows: DataFrame, *order: str | Column, name: str = "row_id", start: int = 1, keep: Sequence[str] = ()) -> DataFrame:
    """Number rows ``start``.. in the given order.

    The order should end in a unique column: rows that tie on all of it lie in one range.
    Once the rows are sorted only the columns ``keep`` are stored, all of them by default.
    """
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    staged = stage(spread.select(*(keep or rows.columns), F.monotonically_increasing_id().alias("_seq")), "numbered")
    staged = staged.withColumn("_piece", F.shiftright("_seq", _POSITION_BITS))
    return _add_offsets(staged, ["_piece"], Window.orderBy("_piece"), name, start).drop("_piece")


# Rows of one key are numbered by one task. A key with more of them is spread over ranges.
ROWS_OF_A_KEY = 1_000_000


def _key_offsets(rows: DataFrame, key: str, start: int) -> tuple[DataFrame, DataFrame]:
    """(rows per key, key with the number before that of its first row), in the order of the key.

    Keys are summed up within ranges, and one short row per range in order.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    spread = counts.repartitionByRange(key).sortWithinPartitions(key)
    staged = stage(spread.select(key, "_rows", F.monotonically_increasing_id().alias("_place")), "keys")
    placed = staged.withColumn("_piece", F.shiftright("_place", _POSITION_BITS))
    before = F.sum("_rows").over(Window.orderBy("_piece")) - F.col("_rows") + F.lit(start - 1)
    pieces = placed.groupBy("_piece").agg(F.sum("_rows").alias("_rows"))
    offsets = stage(pieces.select("_piece", before.alias("_offset")), "offsets")
    if offsets.count() <= BROADCAST_PIECES:
        offsets = F.broadcast(offsets)
    inside = F.sum("_rows").over(Window.partitionBy("_piece").orderBy("_place")) - F.col("_rows")
    summed = placed.select(key, "_piece", inside.alias("_inside")).join(offsets, "_piece")
    return staged.select(key, "_rows"), summed.select(key, (F.col("_offset") + F.col("_inside")).alias("_before"))


def number_keyed_rows(rows: DataFrame, key: str, *order: str | Column, name: str = "row_id", start: int = 1, keep: Sequence[str] = ()) -> DataFrame:
    """As ``number_rows`` in the order of the key and then ``order``, for rows without a null key.

    Rows joined by the key before are not shuffled again, but twice computed: their keys alone, to be
    counted, and whole. So ``order`` has to tell apart rows that differ in what is kept.
    """
    keep = keep or rows.columns
    counts, offsets = _key_offsets(rows, key, start)
    large = counts.where(F.col("_rows") > ROWS_OF_A_KEY)
    parts = []
    if not large.isEmpty():
        # At most one key for each ROWS_OF_A_KEY rows.
        earlier = F.sum("_rows").over(Window.orderBy(key)) - F.col("_rows")
        shift = stage(large.select(key, earlier.alias("_earlier")).join(offsets, key).select(key, (F.col("_before") - F.col("_earlier")).alias("_shift")), "large-keys")
        spread = rows.join(F.broadcast(shift.select(key)), key, "left_semi").withColumn("_place", F.monotonically_increasing_id())
        numbered = number_rows(spread, key, *order, "_place", name="_number", keep=list(dict.fromkeys((key, *keep))))
        parts.append(numbered.join(F.broadcast(shift), key).select(*keep, (F.col("_number") + F.col("_shift")).alias(name)))
        rows = rows.join(F.broadcast(shift.select(key)), key, "left_anti")
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    staged = stage(ranked.join(offsets, key).select(*keep, (F.col("_before") + F.col("_rank")).alias("_seq")), "numbered")
    parts.append(staged.select(*keep, F.col("_seq").alias(name)))
    return reduce(DataFrame.unionByName, parts)


def number_file_rows(rows: DataFrame, per_file: bool = False, name: str = "row_no") -> DataFrame:
    """Number the rows of a file read by ``read_flat_csv`` in file order, without any sort.

    ``per_file`` starts again at 1 in each file; otherwise files follow each other by path.
    """
    staged = stage(rows, "file")
    keys = ["_file", "_block"]
    order = Window.partitionBy("_file").orderBy("_block") if per_file else Window.orderBy(*keys)
    return _add_offsets(staged, keys, order, name, 1).drop("_block")
