"""Session settings for local runs, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}
_WITHIN: ContextVar[str] = ContextVar("scratch_within", default="")


def local_session(app: str, cores: int | str = "*", shuffle_partitions: int = 8, **settings: str) -> SparkSession:
    """A single-JVM session for tests and the benchmark. Clusters bring their own session."""
    fixed = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.driver.memory": "8g",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.bindAddress": "127.0.0.1",
        "spark.driver.host": "127.0.0.1",
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for name, value in (fixed | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``.

    Executors read what others wrote there, so a machine-local folder is accepted
    only when the whole session is one machine and the setting is absent.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = "file://" + tempfile.mkdtemp(prefix="hostvane-")
    return _LOCAL_SCRATCH[app]


def scratch_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/hostvane-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_folder(spark)}/{_WITHIN.get()}{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch_within(spark: SparkSession, label: str) -> Iterator[None]:
    """Intermediate tables of the calling thread go into one folder, deleted at the end: for steps that repeat without end."""
    before = _WITHIN.set(f"{_WITHIN.get()}{label}-{uuid.uuid4().hex}/")
    folder = f"{scratch_folder(spark)}/{_WITHIN.get()}"
    try:
        yield
    finally:
        _WITHIN.reset(before)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> bool:
    """Delete this application's intermediate tables. Results that still read them must be written first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and go on from the written table, cutting its lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
