"""Session defaults for jobs and tests that do not bring their own session."""

from pyspark.sql import SparkSession


def build_session(app_name: str = "tillmart", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators were tuned for.

    AQE coalesces small shuffle partitions and splits skewed join partitions at run
    time. The shuffle partition count is therefore only an upper start value; on a
    cluster set it to two or three times the cores.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": "false",
        # Recording the call site of every column expression doubles the time to build a plan.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
