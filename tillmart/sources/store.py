"""The stored star: five Parquet tables and the batch log.

Parquet has no transaction over several tables, so each append is written under its own
``commit_key`` partition, and the log row, written last, is the commit mark. Readers
keep the partitions named in the log, so a half-written append is never seen. The log row
of a bulk load also hides every commit logged before it, so a load replaces all tables in
that one write. One writer at a time is assumed.

Many small commits are merged now and then into one generation: the visible rows and the log are
written again under one key, a row in ``generations`` makes readers use that key in the place of
all commits up to a batch id, and only then are the commits' folders deleted.
"""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tillmart.operators.staging import releasing_shuffles, remove_path
from tillmart.plans.star import Star
from tillmart.schemas import INGESTION_LOG, STAR_SCHEMAS
from tillmart.sources.flat_file import write_csv

COMMIT = "commit_key"
LOG = "ingestion_log"
GENERATIONS = "generations"
QUARANTINE = "quarantine"
#: Keys of generations begin with this.
COMPACTED = "compacted-"
#: Batch keys of bulk loads begin with this.
BULK = "bulk-load-"

# Up to this many commits their keys (about 50 bytes each) are broadcast; beyond it Spark
# chooses the join and AQE splits its oversized partitions.
BROADCAST_COMMITS = 500_000


class StarStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _read(self, table: str, schema) -> DataFrame:
        """The table with its commit_key; empty when nothing was written yet."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _generation(self) -> Row | None:
        """The generation that readers use: the newest one with a row of its own."""
        return self._read(GENERATIONS, f"number bigint, upto bigint, {COMMIT} string").orderBy(F.desc("number")).first()

    def _written_log(self) -> DataFrame:
        """All log rows there are, those that a generation has copied twice."""
        return self._read(LOG, _with_commit(INGESTION_LOG))

    def log(self) -> DataFrame:
        """The log rows; those of a generation carry its key."""
        key, generation = F.col(COMMIT), self._generation()
        own = ~key.startswith(COMPACTED)
        if generation is None:
            return self._written_log().where(own)
        return self._written_log().where((key == generation[COMMIT]) | (own & (F.col("batch_id") > generation.upto)))

    def _current_log(self) -> DataFrame:
        """The log from the last bulk load on."""
        log = self.log()
        load = log.where(F.col("batch_key").startswith(BULK)).agg(F.max("batch_id")).first()[0]
        return log if load is None else log.where(F.col("batch_id") >= load)

    def remove_replaced(self) -> None:
        """Delete the rows of commits that a bulk load has hidden; their log rows stay."""
        hidden = self.log().select(COMMIT).distinct().join(self._current_log().select(COMMIT).distinct(), COMMIT, "left_anti")
        for row in hidden.toLocalIterator():
            for name in STAR_SCHEMAS:
                remove_path(self.spark, f"{self.path}/{name}/{COMMIT}={row[COMMIT]}")

    def committed_batches(self) -> DataFrame:
        return self.log().select("batch_key").distinct()

    def _committed_keys(self) -> DataFrame:
        """One short key per commit. A plain join would send the rows of a large commit to one task."""
        keys = self.commit_keys()
        return F.broadcast(keys) if keys.count() <= BROADCAST_COMMITS else keys

    def commit_keys(self) -> DataFrame:
        """The commits whose rows are visible."""
        return self._current_log().select(COMMIT).distinct()

    def written(self, name: str, keys: DataFrame) -> DataFrame:
        """Rows of the commits, with their key. The keys also prune the partitions that are read.

        Spark prunes by a broadcast table only where a comparison stands on it, so staged keys get one that all of them pass.
        """
        return self._read(name, _with_commit(STAR_SCHEMAS[name])).join(keys.where(F.col(COMMIT) >= ""), COMMIT, "left_semi")

    def _committed(self, name: str, keys: DataFrame) -> DataFrame:
        return self.written(name, keys).drop(COMMIT)

    def table(self, name: str) -> DataFrame:
        return self._committed(name, self._committed_keys())

    def star(self) -> Star:
        keys = self._committed_keys()
        return Star(**{name: self._committed(name, keys) for name in STAR_SCHEMAS})

    def register(self, prefix: str = "") -> None:
        for name, rows in self.star().tables().items():
            rows.createOrReplaceTempView(prefix + name)

    def _append(self, rows: DataFrame, table: str, schema, commit_key: str) -> None:
        typed = rows.select(*[F.col(column.name).cast(column.dataType).alias(column.name) for column in schema])
        writer = typed.withColumn(COMMIT, F.lit(commit_key)).write.mode("overwrite")
        with releasing_shuffles(self.spark):
            writer.option("partitionOverwriteMode", "dynamic").partitionBy(COMMIT).parquet(f"{self.path}/{table}")

    def discard(self, commit_key: str) -> None:
        """Remove what an earlier, unfinished attempt left under the key.

        To be called before the stored tables are read for a new attempt: that one may
        have no rows for a table, and an empty write replaces nothing.
        """
        if not self.log().where(F.col(COMMIT) == commit_key).isEmpty():
            raise ValueError(f"commit {commit_key} is logged and cannot be discarded")
        for name in (*STAR_SCHEMAS, LOG):
            remove_path(self.spark, f"{self.path}/{name}/{COMMIT}={commit_key}")

    def discard_unlogged(self, prefix: str) -> None:
        """Remove what unfinished attempts left under any key with the prefix, however they grouped their batches.

        The caller bounds the commits under one prefix. Quarantined rows stay when their batch is logged:
        after a compaction its log row no longer has the key.
        """
        logged = {row[COMMIT] for row in self.log().where(F.col(COMMIT).startswith(prefix)).select(COMMIT).distinct().collect()}
        for table, key in self._partitions(prefix):
            if key in logged:
                continue
            if table == QUARANTINE:
                # The first column; an attempt may have died before it wrote any file.
                batches = self.spark.read.schema("batch_key string").option("header", "true").csv(f"{self.path}/{table}/{COMMIT}={key}")
                if not batches.join(self.committed_batches(), "batch_key", "left_semi").isEmpty():
                    continue
            remove_path(self.spark, f"{self.path}/{table}/{COMMIT}={key}")

    def commit(self, new: Star | None, log_entries: DataFrame, commit_key: str) -> None:
        """Append the new rows, then the log rows that make them visible."""
        if new is not None:
            for name, rows in new.tables().items():
                self._append(rows, name, STAR_SCHEMAS[name], commit_key)
        self._append(log_entries, LOG, INGESTION_LOG, commit_key)

    def compact(self) -> str | None:
        """Write all visible rows and the whole log as one generation; returns its key, or None when there are not two commits to merge.

        A failure before the generation's own row leaves the commits as they are; one after it leaves
        folders that no reader uses. Both are cleaned up by the next call. A query that began
        before a call may find its folders gone and has to be run again.
        """
        self._remove_unused()
        log = self.log()
        state = log.agg(F.max("batch_id").alias("upto"), F.count_distinct(COMMIT).alias("commits")).first()
        if state.commits < 2:
            return None
        key, last = COMPACTED + uuid.uuid4().hex, self._generation()
        for name, rows in self.star().tables().items():
            self._append(rows, name, STAR_SCHEMAS[name], key)
        self._append(log, LOG, INGESTION_LOG, key)
        mark = self.spark.createDataFrame([(last.number + 1 if last else 1, state.upto)], "number bigint, upto bigint")
        self._append(mark, GENERATIONS, mark.schema, key)
        self._remove_unused()
        return key

    def _remove_unused(self) -> None:
        """Delete commits that the generation covers and generations that were replaced or never finished."""
        generation = self._generation()
        if generation is not None:
            own = self._written_log().where(~F.col(COMMIT).startswith(COMPACTED) & (F.col("batch_id") <= generation.upto))
            for row in own.select(COMMIT).distinct().collect():  # before the files it is read from go
                self._remove(row[COMMIT])
        for key in sorted({key for _, key in self._partitions(COMPACTED)}):
            if generation is None or key != generation[COMMIT]:
                self._remove(key)

    def _partitions(self, prefix: str) -> list[tuple[str, str]]:
        """(table, commit key) of every folder whose key has the prefix."""
        paths = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/*/{COMMIT}={prefix}*")
        found = paths.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(paths) or ()
        return [(status.getPath().getParent().getName(), status.getPath().getName().partition("=")[2]) for status in found]

    def _remove(self, key: str) -> None:
        """Delete a commit's folders, the log's last: while it is there, the others can be found again."""
        for name in (*STAR_SCHEMAS, GENERATIONS, LOG):
            remove_path(self.spark, f"{self.path}/{name}/{COMMIT}={key}")

    def export_csv(self, folder: str) -> None:
        """Each table as a folder of CSV files, for tools that import them."""
        for name, rows in self.star().tables().items():
            write_csv(rows, f"{folder}/cleaned_{name}")

    def quarantine(self, rows: DataFrame, commit_key: str) -> str:
        """Cleaned rows of refused batches as CSV, for inspection."""
        path = f"{self.path}/{QUARANTINE}/{COMMIT}={commit_key}"
        write_csv(rows, path)
        return path


def _with_commit(schema):
    return type(schema)([*schema.fields]).add(COMMIT, "string")
