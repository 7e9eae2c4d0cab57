"""Session defaults and shared-folder handling."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "talkmill") -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def is_local(spark: SparkSession) -> bool:
    """Whether all executors are on this machine and so share its folders."""
    return spark.sparkContext.master.startswith(("local[", "local-cluster[")) or spark.sparkContext.master == "local"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one in a local session and an error on a cluster."""
    sc = spark.sparkContext
    set_dir = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", "")
    if not set_dir:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        set_dir = tempfile.mkdtemp(prefix="talkmill-ckpt-", dir=os.environ.get("TMPDIR"))
        sc.setCheckpointDir(set_dir)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(set_dir)
    return set_dir


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage, so that later reads survive a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """``df``, a scan, dealt out to all cores where it would be read by fewer tasks than there are.

    Costly row functions over a small table would else run in the one or two tasks of its few files. A table of as
    many splits as cores stays as it is, so nothing of that size shuffles here. Not for plans with joins or aggregates.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers of a session that doesn't have it on their path, once a session."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    on_path = any(p and os.path.abspath(p) == root for p in os.environ.get("PYTHONPATH", "").split(os.pathsep))
    if on_path or getattr(sc, "_talkmill_shipped", False):
        return
    # The driver serves this file to the executors as long as it runs.
    d = tempfile.mkdtemp(prefix="talkmill-ship-")
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    path = os.path.join(d, "talkmill.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "talkmill")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._talkmill_shipped = True
