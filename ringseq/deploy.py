"""What a job needs on a cluster: the package in executors' Python workers, and a folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the application's Python files, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="ringseq-")) / "ringseq.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(to))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI: spark.checkpoint.dir.

    Where it is unset, one of our own if all runs in this process, as in tests; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="ringseq-")
        spark.conf.set("spark.checkpoint.dir", base)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    uri = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")
    return f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/ringseq-{name}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_at_end(spark: SparkSession, path: str) -> None:
    """What is there goes when the application ends."""
    p, store = _at(spark, path)
    store.deleteOnExit(p)


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it from there. Lost executors cost no recomputation of what came before."""
    path = new_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    drop_at_end(df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def drop(*saved: DataFrame) -> None:
    """Tables made by save() that nothing reads any more go now."""
    for df in saved:
        p, store = _at(df.sparkSession, df.saved_at)
        store.delete(p, True)
