"""Session construction and small session-scoped helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "quarry", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with adaptive execution on; clusters bring their own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the testdata tables (a file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The session's spark.checkpoint.dir; only where none is set, in a local session, a folder of our own."""
    import tempfile

    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="quarry-"))
