"""Session helpers: the shared folder for staged tables and small checks of size."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_STAGED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master without that setting gets a temporary folder of its own; on a cluster a missing
    setting is an error, for a machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(sc, "_metrikon_dir", None)
    if own is None:
        own = sc._metrikon_dir = "file://" + tempfile.mkdtemp(prefix="metrikon-")
    return own


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def staged_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted by ``release_staged``."""
    path = f"{shared_dir(spark)}/metrikon/{label}-{uuid.uuid4().hex}"
    if not _STAGED:
        atexit.register(release_staged)
    _STAGED.append(path)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage is cut and nothing is computed twice."""
    spark = df.sparkSession
    path = staged_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_staged(paths: list[str] | None = None) -> None:
    """Delete what ``staged`` wrote, all of it or these paths. Call it when the results that read it have been consumed."""
    spark = SparkSession.getActiveSession()
    for path in list(_STAGED) if paths is None else paths:
        if path in _STAGED:
            _STAGED.remove(path)
        try:
            if spark is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass


@contextmanager
def staging() -> Iterator[None]:
    """What is staged inside is deleted at the end, and nothing else: other results that are still read keep their tables."""
    before = set(_STAGED)
    try:
        yield
    finally:
        release_staged([p for p in _STAGED if p not in before])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of the test data; the parquet scan stays open to pruning and pushdown."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once per context, as a zip: they need no copy of the repository."""
    import os
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_metrikon_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="metrikon-"), "metrikon-src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("metrikon", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._metrikon_shipped = True
