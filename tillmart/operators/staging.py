"""Intermediate tables in the cluster's shared folder.

A staged frame fixes values that would not survive a recomputation (row positions) and
cuts lineage, so a lost executor costs a re-read and nothing upstream. It is Parquet
rather than an RDD checkpoint because its readers need different columns.
"""

import contextlib
import contextvars
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the session; a temporary one only without the setting and with executors inside the driver."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[^,\]]*(,[^,\]]*)?\])?", spark.sparkContext.master):
        raise ValueError(f"set {_SETTING} to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="tillmart-")
    spark.conf.set(_SETTING, folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tillmart-{name}-{uuid.uuid4().hex}"


_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def releasing_shuffles(spark: SparkSession):
    """What a write inside the block shuffles is deleted when the write ends, not when the driver next collects its garbage.

    The rows that were written are read back from where they lie, so nobody needs the shuffled ones
    again. A frame run twice shuffles anew.
    """
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.unset(_RELEASE) if before is None else spark.conf.set(_RELEASE, before)


def stage(rows: DataFrame, name: str, outlive: bool = False) -> DataFrame:
    """Write the rows once and read them back. A table that outlives the innermost scope belongs to the scope around it."""
    path = scratch_path(rows.sparkSession, name)
    with releasing_shuffles(rows.sparkSession):
        rows.write.mode("error").parquet(path)
    _created(path, outlive)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


#: The paths of each open scope, the innermost last.
_scopes: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("staging_scopes", default=())


def _created(path: str, outlive: bool) -> None:
    scopes = _scopes.get()
    scopes = scopes[:-1] if outlive else scopes
    if scopes:
        scopes[-1].append(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system holds it; nothing happens when it is absent."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def staging_scope(spark: SparkSession):
    """Delete the tables staged inside the block when it ends; their readers must be done by then."""
    paths: list[str] = []
    token = _scopes.set((*_scopes.get(), paths))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in paths:
            remove_path(spark, path)
