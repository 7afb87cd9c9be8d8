"""Session helpers: a tuned local session and lineage cutting."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", app: str = "sightline", memory: str = "16g") -> SparkSession:
    """A session for one machine (tests and the benchmark).

    On a cluster the session comes from spark-submit; nothing in the library
    depends on the settings made here.
    """
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship_package(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own: on a cluster a
    machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = context.getConf().get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
        return
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its plan."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def renamed(df: DataFrame) -> DataFrame:
    """The same rows under new column identities, so that a table can be
    co-grouped with one derived from it.
    """
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers (once per Spark context).

    Same effect as ``spark-submit --py-files``; harmless where that was used.
    """
    context = spark.sparkContext
    if getattr(context, "_sightline_shipped", False):
        return spark
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="spark-package-")
    archive = shutil.make_archive(
        os.path.join(folder, "sightline"), "zip", os.path.dirname(root), os.path.basename(root)
    )
    context.addPyFile(archive)
    context._sightline_shipped = True
    return spark


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder every executor can reach, beside the checkpoints."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df`` written once, compressed and by column, to the shared scratch folder: for wide plans over many rows."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._stored_in = path
    return made


def forget(df: DataFrame) -> None:
    """Delete the files of a table as made by ``stored``, once nothing is read from it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_in)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
