"""Session helpers: table loading, lineage cutting and size checks.

Nothing here changes the configuration of a session it is given; the only thing
it may set is a checkpoint folder, and only where none is configured.
"""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "biblioforge", cores: int | str = "*", shuffle: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BIBLIOFORGE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application; they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        folder = tempfile.mkdtemp(prefix="biblioforge-ship-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        package = Path(__file__).resolve().parent
        sc.addPyFile(shutil.make_archive(f"{folder}/biblioforge", "zip", package.parent, package.name))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names; a temporary one only in a local session that names none (tests)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        named = tempfile.mkdtemp(prefix="biblioforge-ckpt-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder, so that lost executors do not lose the work before it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """Like ``cut``, but as a compressed table by columns, for wide frames that are read several times in part."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Free the shuffle files and checkpoints of frames that nothing holds any more; else they stay until the driver happens to collect its garbage."""
    for _ in range(2):  # what the first round frees holds others
        gc.collect()
        spark.sparkContext._jvm.System.gc()
