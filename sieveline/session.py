"""Session builder and the shared scratch folder.

On a cluster the scratch folder is the one that ``spark.checkpoint.dir`` names; it must be visible to the driver and
to all executors; without it a cluster session is refused.  In local mode (tests, a laptop) a folder of this process is used
where the setting is missing.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sieveline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the engine's plans assume; ``conf`` keys use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **{k.replace("_", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that all executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sieveline-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stable(df: DataFrame) -> DataFrame:
    """``df`` computed once into reliable checkpoint files: later reads see the same rows in the same partitions."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back."""
    path = table_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(df: DataFrame, task_bytes: int = 64 << 20) -> int:
    """A partition count that follows the size of what ``df`` reads: one for each ``task_bytes``, and not fewer than
    ``spark.sql.shuffle.partitions``.  Sources of unknown size count for nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(x for x in sizes if x < 1 << 60)
    least = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return max(least, -(-known // task_bytes))


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a table in the shared folder, whatever store it lies in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Intermediate tables of one operator call: ``with Scratch(spark) as kept`` deletes them at the end.

    Only for tables whose readers have been written or checkpointed by then; what a result still reads belongs in
    ``staged``.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for path in self.paths:
            delete_path(self.spark, path)
        self.paths = []

    def table(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = table_path(self.spark, name)
        self.paths.append(path)
        df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
