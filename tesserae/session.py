"""Shared folders and small helpers around the session."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``. Where that is unset and Spark runs on this
    machine alone (tests), a folder of this machine, which is then set as the checkpoint folder too; on a cluster it must be set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if context.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tesserae-"))
        current = context._jsc.sc().getCheckpointDir()
    return str(current.get()).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tesserae-{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark's readers take it, with its file system: one without a scheme belongs to the default file system."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(there).toString()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` written as Parquet to the shared folder and read from there: later steps restart from the
    files when an executor is lost, and nothing is computed twice. The files stay until ``discard`` or until the
    owner of the folder clears it, as checkpoints do."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession, limit: int = 4 << 20) -> None:
    """Lets no more than about ``limit`` bytes at a time go to Python workers in this session: texts may be long, and a batch is
    held whole on both sides. A smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if now <= 0 or now > limit:
        spark.conf.set(name, str(limit))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bundled(rows: DataFrame, names: list[str]) -> Column:
    """Columns of any names as one struct, in which they can go through a worker; ``unbundled`` has them back."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in names)) if names else F.lit(None).cast("int")


def unbundled(struct: str, names: list[str]) -> list[Column]:
    return [F.col(struct)[c].alias(c) for c in names]


def discard(spark: SparkSession, *frames: DataFrame, sweep: bool = True) -> None:
    """Deletes the files behind frames returned by ``stored``. Only for frames that nothing reads any more. Spark deletes the
    shuffle files of finished steps when the driver's memory is cleared of their plans, which ``sweep`` asks for."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for frame in frames:
        for folder in {f.rpartition("/")[0] for f in frame.inputFiles()}:
            if "/tesserae-" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)
    if sweep:
        gc.collect()
        jvm.System.gc()
