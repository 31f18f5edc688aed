"""Session, shared-folder and table helpers used by every operator."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build(master: str = "local[*]", app: str = "boskage", partitions: int = 8) -> SparkSession:
    """A session with the settings the engine expects: UTC, adaptive execution, Arrow."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BOSKAGE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


#: The greatest size estimate that is kept (a petabyte).
MOST_BYTES = 1 << 50


def stable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that ``spark.checkpoint.dir`` names.

    A folder of this machine is set only in local mode and only where none is set.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="boskage-")
        sc.setCheckpointDir(shared)
    done = df.checkpoint(eager=True)
    plan = done._jdf.queryExecution()
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) > MOST_BYTES:
        # a checkpoint keeps the size estimated for its plan; in loops with joins estimates multiply round by round until
        # planning takes for ever, so the rows are taken up anew without one
        return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.toRdd(), done._jdf.schema(), False), spark)
    return done


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """Rows of a table that may be sent to the driver; more than ``most`` is an error, never a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows")
    return rows
