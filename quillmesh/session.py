"""Session factory and table loading shared by queries, tests and the bench."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "quillmesh", cpus: str | int | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution. What spark-submit or a running session has set is kept; master, partitions and memory suit one machine where nothing is set."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    defaults = {
        "spark.app.name": app,
        "spark.master": f"local[{cpus}]",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    known = submitted()
    if known.get("spark.master", "local").startswith("local"):
        defaults |= {"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": "8g"}
    builder = SparkSession.builder
    for key, value in {**{k: v for k, v in defaults.items() if k not in known}, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def submitted() -> dict[str, str]:
    """The settings that spark-submit or a running context came with; none where Python itself starts Spark."""
    if SparkContext._active_spark_context is None and "PYSPARK_GATEWAY_PORT" not in os.environ:
        return {}
    SparkContext._ensure_initialized()  # the JVM is there; this only connects to it
    active = SparkContext._active_spark_context
    return dict((active.getConf() if active else SparkConf()).getAll())


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one in the warehouse, or a temporary one if all tasks run in the driver (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        alone = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master)
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder, without its lineage; it survives lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which the application deletes when it ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path
