"""CSV records whose quoted values hold line breaks, read by as many tasks as the file has blocks.

Whether a line begins inside quotes depends on all lines before it. Each line is therefore a function
of two states, outside and inside, to the state behind it: unchanged, changed, or one of them
whatever it was. Functions of a block compose, and so do those of blocks, so the only thing that
is summed up in order over a file is one short row per block. Then every line knows whether it begins
a record and which one it belongs to, and only lines of records with several lines are brought together.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillmart.operators.staging import stage

# A quote opens at the start of a field, two quotes inside are one, and what follows a closing quote belongs to the field.
_INSIDE = r'[^"]*+(?:""[^"]*+)*+'
_FIELDS = rf'(?:(?:"{_INSIDE}"[^,]*+|[^",][^,]*+|),)*+'
_LEAVES_OPEN = rf'^{_FIELDS}"{_INSIDE}\z'
_STAYS_OPEN = rf'^{_INSIDE}(?:\z|"[^,]*+,{_FIELDS}"{_INSIDE}\z)'


class Records(NamedTuple):
    """Records of some files with their place, and the files left out because a quote is still open at their end."""

    rows: DataFrame
    unclosed: list[str]


def read_lines(spark: SparkSession, paths: str | list[str], encoding: str) -> DataFrame:
    """Every line with its place. Line breaks are those of the text source: \\n, \\r\\n and \\r."""
    rows = spark.read.text(paths)
    return rows.select(
        F.decode(F.col("value").cast("binary"), encoding).alias("line"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_seq"),
    )


def files_with_open_quotes(spark: SparkSession, paths: str | list[str], encoding: str) -> DataFrame:
    """_file of each file in which a line leaves a quote open, so that read line by line its record would be cut."""
    lines = read_lines(spark, paths, encoding)
    return lines.where(F.col("line").contains('"') & F.col("line").rlike(_LEAVES_OPEN)).select("_file").distinct()


def _composed(changes: Column, fixed: Column, value: Column, order) -> tuple[Column, Column]:
    """Of the functions up to each row in turn: the fixed state reached before later changes (null if none), and whether changes are odd."""
    odd = (F.sum(changes.cast("int")).over(order) % 2) == 1
    return F.last(F.when(fixed, value != odd), ignorenulls=True).over(order), odd


def _behind(reached: Column, odd: Column, start: Column) -> Column:
    return F.coalesce(reached, start) != odd


def _lines_with_records(lines: DataFrame) -> DataFrame:
    """Lines with, for a block that begins outside (0) and inside (1) quotes: before, the state before the line; and record, how many begin up to it."""
    quoted = F.col("line").contains('"')
    lines = lines.withColumns({"opens": quoted & F.col("line").rlike(_LEAVES_OPEN), "stays": ~quoted | F.col("line").rlike(_STAYS_OPEN)})
    order = Window.partitionBy("_file", "_block").orderBy("_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached, odd = _composed(F.col("opens") & ~F.col("stays"), F.col("opens") == F.col("stays"), F.col("opens"), order)
    lines = lines.withColumns({"reached": reached, "odd": odd})
    beside = Window.partitionBy("_file", "_block").orderBy("_seq")
    for start in (0, 1):
        behind = _behind(F.col("reached"), F.col("odd"), F.lit(bool(start)))
        lines = lines.withColumn(f"behind{start}", behind)
        lines = lines.withColumn(f"before{start}", F.coalesce(F.lag(f"behind{start}").over(beside), F.lit(bool(start))))
        begins = ~F.col(f"before{start}") & (F.trim("line") != "")
        lines = lines.withColumn(f"record{start}", F.sum(begins.cast("int")).over(order))
    return lines.select("line", "_file", "_block", "_seq", *(f"{name}{start}" for start in (0, 1) for name in ("before", "behind", "record")))


def _blocks(lines: DataFrame) -> DataFrame:
    """One row per block: the state before it, the records that begin before it in its file, and the state at the end of the file."""
    last = F.max(F.struct("_seq", *(f"{name}{start}" for start in (0, 1) for name in ("behind", "record")))).alias("last")
    blocks = lines.groupBy("_file", "_block").agg(last).select("_file", "_block", "last.*")
    order = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = F.col("behind0") == F.col("behind1")
    reached, odd = _composed(F.col("behind0") & ~F.col("behind1"), same, F.col("behind0"), order)
    blocks = blocks.withColumns({"reached": reached, "odd": odd})
    blocks = blocks.withColumn("end", _behind(F.col("reached"), F.col("odd"), F.lit(False)))
    blocks = blocks.withColumn("inside", F.coalesce(F.lag("end").over(Window.partitionBy("_file").orderBy("_block")), F.lit(False)))
    begun = F.when(F.col("inside"), F.col("record1")).otherwise(F.col("record0"))
    whole = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return blocks.select("_file", "_block", "inside", (F.sum(begun).over(order) - begun).alias("earlier"), F.last("end").over(whole).alias("unclosed"))


def read_records(spark: SparkSession, paths: str | list[str], encoding: str) -> Records:
    """Records as written, without line breaks at their ends, blank lines outside quotes and the first record of each file, its header.

    Rows: record, _file, _block (that in which it begins), _seq (consecutive in its block). A line
    break inside quotes is \\n. A file that ends inside quotes is left out and named.
    """
    lines = stage(_lines_with_records(read_lines(spark, paths, encoding)), "lines")
    blocks = stage(_blocks(lines), "blocks")
    unclosed = [row._file for row in blocks.where("unclosed").select("_file").distinct().collect()]  # files of one submission
    rows = lines.join(blocks.where("NOT unclosed").drop("unclosed"), ["_file", "_block"])
    inside = F.col("inside")
    rows = rows.select(
        "line", "_file", "_block", "_seq", F.when(inside, F.col("before1")).otherwise(F.col("before0")).alias("continues"),
        F.when(inside, F.col("behind1")).otherwise(F.col("behind0")).alias("goes_on"),
        (F.col("earlier") + F.when(inside, F.col("record1")).otherwise(F.col("record0"))).alias("number"),
    ).where("(continues OR trim(line) <> '') AND number > 1")
    alone = ~F.col("continues") & ~F.col("goes_on")
    parts = F.array_sort(F.collect_list(F.struct("_block", "_seq", "line")))
    several = rows.where(~alone).groupBy("_file", "number").agg(parts.alias("parts"), F.min("_block").alias("_block"))
    several = several.select(F.array_join(F.transform("parts", lambda part: part["line"]), "\n").alias("record"), "_file", "_block", F.col("number").alias("_seq"))
    return Records(rows.where(alone).select(F.col("line").alias("record"), "_file", "_block", F.col("number").alias("_seq")).unionByName(several), unclosed)
