"""A training-data pipeline: reject poor documents, drop frequent lines, keep one of each group of near copies, drop benchmark leaks, check the tokens.

Every stage works on all rows its predecessor kept. All but the last return the columns of
documents; the last returns the token digests. Rows may repeat and any column may be null.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillmart.llm import bpe, decontamination, line_dedup, quality, queries, simhash
from tillmart.llm.common import table
from tillmart.operators.staging import stage

#: No SQL: the classifier is learned, fingerprints need XXH64, and tokens a vocabulary. Tests hold run() against a plain version.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labelled ones among them, does not reject."""
    rows = quality.scores(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return rows.where("score >= 0.5").select("doc.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents go; n_chars follows the text. A document that loses no line keeps its text, null included."""
    rows = line_dedup.drop_frequent_lines(docs)
    rows = rows.select("doc", F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("doc.text")).alias("kept"))
    fresh = {"text": F.col("kept"), "n_chars": F.when(F.col("doc.n_chars").isNotNull(), F.char_length("kept").cast("bigint"))}
    return rows.select(*(fresh.get(name, F.col(f"doc.{name}")).alias(name) for name in docs.columns))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: of the least id, a null id last; of its rows with that id and text the least by its columns."""
    first = stage(simhash.representatives(docs), "representatives")
    rows = docs.select(F.struct("*").alias("doc"))  # so that no column name can clash
    key = simhash.text_key(F.col("doc.text"))
    same = F.col("doc.doc_id").eqNullSafe(F.col("first_id")) & (key == F.col("first_key"))
    kept = rows.join(first.where("n = 1"), same, "left_semi")
    repeated = first.where("n > 1")
    if repeated.isEmpty():
        return kept.select("doc.*")
    order = F.struct(*(F.struct(F.col(f"doc.{name}").isNull().alias("none"), F.col(f"doc.{name}").alias("value")) for name in docs.columns))
    one = rows.join(repeated, same, "left_semi").groupBy(F.col("doc.doc_id").alias("id"), key.alias("key")).agg(F.min_by("doc", order).alias("doc"))
    return kept.unionByName(one.select("doc")).select("doc.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a window of any benchmark item. The text alone decides, so rows are told apart by it and not by their ids."""
    texts = docs.select(simhash.text_key(F.col("text")).alias("key"), "text")
    rows = decontamination.contaminated_spans(texts, table(spark, sf_dir, "benchmark"), id_col="key")
    leaks = stage(rows.where(F.size("spans") > 0).select(F.col("key").alias("leak")).distinct(), "leaks")
    rows = docs.select(F.struct("*").alias("doc"))
    return rows.join(leaks, simhash.text_key(F.col("doc.text")) == F.col("leak"), "left_anti").select("doc.*")


def count_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode_digests(docs, queries.vocabulary_path())


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("simhash near-dedup", keep_one_of_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("bpe encoding and decoding", count_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
