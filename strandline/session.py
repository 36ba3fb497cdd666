"""Session helpers: building a local session, shipping the package, shared folders."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def local_session(cpus: int | str = 8, memory: str = "6g", **conf: str) -> SparkSession:
    """A local session with the settings that the queries assume."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("strandline")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.unionOutputPartitioning", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def guard(spark: SparkSession) -> None:
    """Spark 4.1 lets a union keep the hash partitioning of its inputs, while adaptive execution may coalesce the partitions of
    each input in its own way: an aggregate over such a union then gives keys twice. The setting is turned off for the session
    before any plan of ours is made; elsewhere it is unknown, and setting it does nothing."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor, once per application."""
    guard(spark)
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():
        target = Path(tempfile.mkdtemp(prefix="strandline-")) / "strandline.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, Path(root.name) / p.relative_to(root))
        sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir, or, in a local session only, one of our own that
    goes when the process ends. A cluster without the setting is an error: no machine's own folder would do."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None) if hasattr(spark, "sparkContext") else None
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="strandline-shared-")
        atexit.register(shutil.rmtree, own, True)
        d = "file://" + own
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(d)
    return d


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has yet; :func:`clean` removes what was written there."""
    path = os.path.join(shared_dir(spark), f"strandline-{label}-{uuid.uuid4().hex}")
    _WRITTEN.append(path)
    return path


_KEPT: dict[tuple[str, ...], str] = {}
_KEEPING = threading.RLock()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def kept(spark: SparkSession, label: str, source: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table derived from a source, written once for an application and read by all plans that use it.

    For inputs that are costly to derive and that one plan reads several times: each reading would derive them anew.
    """
    guard(spark)
    key = (spark.sparkContext.applicationId, label, source)
    with _KEEPING:
        if key not in _KEPT or not _exists(spark, _KEPT[key]):
            path = new_path(spark, label)
            build().write.parquet(path)
            _KEPT[key] = path
        return spark.read.parquet(_KEPT[key])


def clean(spark: SparkSession) -> int:
    """Removes what this process has written in the shared folder, once the results that read it are done with; how many."""
    jvm, n = spark.sparkContext._jvm, 0
    for path in _WRITTEN:
        p = jvm.org.apache.hadoop.fs.Path(path)
        n += bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True))
    _WRITTEN.clear()
    _KEPT.clear()
    return n


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back; survives the loss of executors."""
    spark = df.sparkSession
    guard(spark)
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    guard(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
