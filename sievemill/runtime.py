"""Session helpers: reading tables, cutting lineage in the shared folder."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: spark.checkpoint.dir, else the context's checkpoint folder.

    A temporary one of this machine stands in only in local mode; on a cluster without either it is an error.
    """
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if conf:
        return conf
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rsplit("/", 1)[0]
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    held = getattr(shared_dir, "own", None)
    if held is None:
        held = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="sievemill-")
    return held


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))


def cut(df: DataFrame) -> DataFrame:
    """Small intermediate results: reliable checkpoint, read back from the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str = "t") -> DataFrame:
    """Larger intermediate results: a compressed columnar table in the shared folder, removed at exit."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sievemill/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _drop_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    def drop() -> None:
        if path.startswith("file:"):
            import shutil

            shutil.rmtree(path[len("file:"):].replace("//", "/", 1), ignore_errors=True)
            return
        try:
            jvm = spark.sparkContext._jvm
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session may be gone
            pass

    atexit.register(drop)


def ship(spark: SparkSession) -> None:
    """Gives the package to the Python workers, wherever they run; once a context."""
    sc = spark.sparkContext
    if getattr(ship, "done", None) == sc.applicationId:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for at, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.join("sievemill", os.path.relpath(full, root)))
    # into the shared folder, whatever file system it is on; Spark hands it on to the executors
    target = f"{shared_dir(spark)}/sievemill/code-{sc.applicationId}/sievemill.zip"
    path = sc._jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(target)
    ship.done = sc.applicationId
