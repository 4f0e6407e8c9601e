"""Session defaults and reliable checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def spark_session(master: str | None = None, app: str = "tidemark", **conf: str) -> SparkSession:
    """Session with the settings the operators expect; `conf` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def require_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder in `spark.checkpoint.dir`; fall back to a temp folder in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder, so what it holds no longer depends on a re-run."""
    require_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def gathered(written: DataFrame, rows: int = 1 << 17) -> DataFrame:
    """A written table of narrow rows, read by as few tasks as its counted rows ask for, since the driver keeps account of every task."""
    return written.coalesce(max(1, -(-written.count() // rows)))


def step_ended(spark: SparkSession) -> None:
    """Let the driver collect its garbage: shuffle files and checkpoints of finished steps go only then, and its heap shrinks again."""
    spark.sparkContext._jvm.System.gc()
