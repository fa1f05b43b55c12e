"""Flat sales files."""

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillmart.functions.text import null_if_token
from tillmart.operators.staging import releasing_shuffles
from tillmart.sources.quoted import files_with_open_quotes, read_records

ENCODING = "ISO-8859-1"


def _options(multi_line: bool = False) -> dict:
    # With multiLine Spark reads a file in one task, so only header lines are read so; see quoted.py for the rest.
    return {"encoding": ENCODING, "escape": '"', "multiLine": str(multi_line).lower()}


def read_header(spark: SparkSession, paths: str | list[str], multi_line: bool = False) -> list[str]:
    """Column names as written; only the first line is read."""
    first = spark.read.options(header="false", **_options(multi_line)).csv(paths).first()
    return [] if first is None else [name or "" for name in first]


def first_line(spark: SparkSession, path: str) -> str | None:
    """The file's first line as written; a few bytes are read, without a job."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(conf).open(place)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(place)
        content = stream if codec is None else codec.createInputStream(stream)
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(content, ENCODING)).readLine()
    finally:
        stream.close()


def list_files(spark: SparkSession, pattern: str) -> Iterator[tuple[str, int, int]]:
    """(path, change time, length) of the data files that match, one level deep; the listing is read by the driver piece by piece."""
    place = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.globStatus(place) or ():
        folder = system.listStatusIterator(status.getPath()) if status.isDirectory() else None
        while folder is None or folder.hasNext():
            file = status if folder is None else folder.next()
            if not file.isDirectory() and not file.getPath().getName().startswith(("_", ".")):
                yield file.getPath().toString(), file.getModificationTime(), file.getLen()
            if folder is None:
                break


def parts_differ(spark: SparkSession, path: str) -> bool:
    """Whether parts of a folder begin with different lines. Columns are taken by position, so they must not."""
    lines = (first_line(spark, part) for part, _, length in list_files(spark, path) if length)
    first = next(lines, None)
    return any(line != first for line in lines)


def files_left_open(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """_file of each file that must not be read line by line: a quote is open at the end of a line."""
    return files_with_open_quotes(spark, paths, ENCODING)


class OpenQuotes(ValueError):
    """Files that end inside quotes."""

    def __init__(self, files: list[str]):
        super().__init__(f"a quote is still open at the end of {', '.join(sorted(files))}")
        self.files = files


def read_flat_csv(
    spark: SparkSession, paths: str | list[str], header: list[str] | None = None, multi_line: bool = False
) -> DataFrame:
    """Every column as text, trimmed header names, missing-value spellings as null.

    Nothing is inferred, so ids keep their zeros and the data is read once. Columns are
    taken by position, which leaves the header free to repeat a name in another case.
    ``_beyond`` holds what a line has behind its last column: such a line cannot be told apart.
    ``_file``, ``_block`` and ``_seq`` tell each row's place for ``number_file_rows``.

    With ``multi_line`` values in quotes may hold line breaks (read as \\n); the lines are staged once,
    and files that end inside quotes raise ``OpenQuotes``. Without it a line is a record, see ``files_left_open``.
    """
    rows, unclosed = read_flat_parts(spark, paths, header, multi_line)
    if unclosed:
        raise OpenQuotes(unclosed)
    return rows


def read_flat_parts(
    spark: SparkSession, paths: str | list[str], header: list[str] | None = None, multi_line: bool = False
) -> tuple[DataFrame, list[str]]:
    """As read_flat_csv, but files that end inside quotes are left out and returned by name."""
    header = header if header is not None else read_header(spark, paths, multi_line)
    names = [f"c{n}" for n in range(len(header) + 1)]
    schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    unclosed: list[str] = []
    if multi_line:
        records, unclosed = read_records(spark, paths, ENCODING)
        parsed = F.from_csv("record", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"escape": '"'})
        rows = records.select(parsed.alias("row"), "_file", "_block", "_seq").select("row.*", "_file", "_block", "_seq")
    else:
        rows = spark.read.schema(schema).options(header="true", enforceSchema="true", **_options()).csv(paths)
        place = (F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
        rows = rows.select(*names, *place, F.monotonically_increasing_id().alias("_seq"))
    placed = rows.select(*[null_if_token(F.col(name)).alias(name) for name in names[:-1]], F.col(names[-1]).alias("_beyond"), "_file", "_block", "_seq")
    return placed.toDF(*[name.strip() for name in header], "_beyond", "_file", "_block", "_seq"), unclosed


def preview(rows: DataFrame, limit: int = 10) -> DataFrame:
    return rows.drop("_beyond", "_file", "_block", "_seq").limit(limit)


def write_csv(rows: DataFrame, path: str, compression: str = "none") -> None:
    """A folder of CSV part files with header. Spaces around values are kept. A part compressed as gzip is read by one task."""
    keep_space = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    with releasing_shuffles(rows.sparkSession):
        rows.write.mode("overwrite").options(header="true", escape='"', compression=compression, **keep_space).csv(path)
