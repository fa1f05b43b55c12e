"""Line deduplication over a corpus, in DataFrame functions only.

Lines are exploded, normalised and hashed, the documents of each hash are counted, and lines
whose key is found in enough documents are dropped everywhere. The lines that stay are put
together again by position.

The count is one shuffle of 16-byte hashes with a map-side combine: a document gives each hash
once, so documents need no distinct count. Which positions of a text go depends on the text
alone, so they are found once per distinct text and joined back by its digest. A line or a text
that holds a third of all rows is one row per map task in the counts, and lies in a join that
Spark can split elsewhere.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmart.llm.common import WHITE, lower_ascii
from tillmart.operators.staging import stage

MIN_DOCUMENTS = 10
MIN_CHARS = 1


def _lines(text: Column) -> Column:
    """Null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hex_digest(text: Column) -> Column:
    """128 bits: at 10^12 distinct lines a shared digest is still out of reach."""
    return F.md5(F.encode(text, "UTF-8"))


def _digest(text: Column) -> Column:
    return F.unhex(_hex_digest(text))


def _line_hashes(text: Column, min_chars: int) -> Column:
    """A digest per line as hex, null for a line whose key is too short to count."""
    keys = F.transform(_lines(lower_ascii(F.coalesce(text, F.lit("")))), lambda line: F.btrim(line, F.lit(WHITE)))
    return F.transform(keys, lambda key: F.when(F.char_length(key) >= min_chars, _hex_digest(key)))


def frequent_lines(docs: DataFrame, text_col: str = "text", min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The digests of line keys found in at least min_documents rows, with that number."""
    # Distinct as hex: Spark finds distinct strings of an array by hashing, distinct byte arrays by comparing all with all.
    hashes = docs.select(F.explode(F.array_distinct(_line_hashes(F.col(text_col), min_chars))).alias("h")).where("h IS NOT NULL").select(F.unhex("h").alias("h"))
    return hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_documents)


def drop_frequent_lines(docs: DataFrame, text_col: str = "text", min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Every row of docs under `doc`, with kept_text, n_lines, n_dropped.

    Each row counts as a document of its own, repeated rows too. A null or empty text has one
    empty line and kept_text ''; so has a text that loses all lines. An empty table gives an
    empty result. The columns of docs stay inside `doc`, so no name can clash.
    """
    frequent = stage(frequent_lines(docs, text_col, min_documents, min_chars), "frequent-lines")
    text = F.coalesce(F.col(text_col), F.lit(""))
    # The digest is a column before lines are exploded: beside the explosion it would be formed anew for each line.
    hashes = docs.select(_digest(text).alias("text_key"), _line_hashes(F.col(text_col), min_chars).alias("hashes"))
    places = hashes.select("text_key", F.posexplode("hashes").alias("pos", "h"))
    # Only rare lines differ between rows; the semi join keeps the places that go.
    gone = stage(places.where("h IS NOT NULL").withColumn("h", F.unhex("h")).join(frequent, "h", "left_semi").select("text_key", "pos"), "dropped-places")
    # Written before the join, so that the join's own shuffle of a text with very many copies can be split.
    gone = stage(gone.groupBy("text_key").agg(F.collect_set("pos").alias("gone")), "dropped-by-text")

    rows = docs.select(F.struct("*").alias("doc"), _digest(text).alias("text_key"))
    rows = rows.join(gone, "text_key", "left").select("doc", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    left = F.array_except(F.sequence(F.lit(0), F.size(_lines(F.col("doc")[text_col])) - 1), F.col("gone"))
    return rows.select(
        "doc",
        F.when(F.size("gone") == 0, F.coalesce(F.col("doc")[text_col], F.lit("")))
        .otherwise(_lines_at(_lines(F.col("doc")[text_col]), left)).alias("kept_text"),
        F.size(_lines(F.col("doc")[text_col])).cast("bigint").alias("n_lines"),
        F.size("gone").cast("bigint").alias("n_dropped"),
    )


def _lines_at(lines: Column, positions: Column) -> Column:
    """The lines at the positions, joined. The lines are named once, as the argument of a lambda: a long text is split once, not for each line."""
    joined = F.transform(F.array(lines), lambda named: F.array_join(F.transform(positions, lambda pos: F.get(named, pos)), "\n"))
    return F.get(joined, F.lit(0))
