"""Session settings and the shared folder for written intermediates."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8, memory: str = "16g") -> SparkSession:
    """Session for tests and benchmarks on one machine.

    On a cluster the session comes from the cluster, with adaptive execution on (the
    default) and ``spark.checkpoint.dir`` set to a folder that all executors share.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("panelfold")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def _base_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster a machine-local folder would be lost with its machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    base = tempfile.mkdtemp(prefix="panelfold-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{_base_folder(spark)}/panelfold/{name}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable, keeping a folder already set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_base_folder(spark))


def materialize(frame: DataFrame, name: str) -> DataFrame:
    """Write a result that several later steps read, and read it back.

    Cuts the lineage: later plans start from columnar files in the shared
    folder, which outlive any executor, and read only the columns they need.
    """
    folder = shared_folder(frame.sparkSession, name)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)
