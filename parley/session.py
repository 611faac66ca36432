"""Session settings that every query relies on, and shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def build(master: str = "local[*]", app: str = "parley", **conf: str) -> SparkSession:
    """A session with UTC time, AQE and skew handling on; ``conf`` overrides."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="parley-"), "parley_src.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(_ROOT.rglob("*.py")):
            archive.write(path, path.relative_to(_ROOT.parent))
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a local session (as in tests) gets a
    temporary one; a cluster is refused, as its machines would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="parley-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, which outlives lost executors."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def written(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again."""
    out = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(out)
    return df.sparkSession.read.parquet(out)


def discard(spark: SparkSession, folder: str) -> None:
    """Removes a folder of intermediate data that nothing reads any more, in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
