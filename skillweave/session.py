"""Session defaults and the shared folder in which intermediate tables are kept."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that every session of this engine relies on; sizes are left to the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}

_folders: dict[str, str] = {}
_shipped: set[str] = set()
_written: dict[int, tuple] = {}


def build_session(app: str = "skillweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults. `conf` keys have two underscores for each dot."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="skillweave-ship-")  # the driver serves the file from here while it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder, "skillweave.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(here.rglob("*.py")):
            out.write(path, path.relative_to(here.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The run's own folder below spark.checkpoint.dir, emptied when the driver ends.

    On a cluster the setting names storage that all executors share. Only a session without the setting (a local
    test) gets a temporary folder of this machine.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="skillweave-")
        _folders[app] = f"{base.rstrip('/')}/skillweave-{app}"
        atexit.register(_forget, spark, app)
    return _folders[app]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation, and values that depend on how the
    rows happened to be partitioned stay what they were.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    _written[id(written)] = (weakref.ref(written), path)
    return written


def discard(table: DataFrame) -> None:
    """Delete a table that `materialise` returned and nothing reads any more."""
    held, path = _written.pop(id(table), (lambda: None, None))
    if held() is table:
        _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _forget(spark: SparkSession, app: str) -> None:
    path = _folders.pop(app, None)
    try:
        _delete(spark, path)
    except Exception:  # noqa: BLE001 - the session may be gone already; the folder then stays for its owner
        pass
