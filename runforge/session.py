"""Spark session settings used by every job and test.

UTC time zone (the oracle compares timestamps naively), AQE on (runtime
coalescing, skew-join splitting, broadcast demotion), ANSI mode left at the
Spark 4 default, UI off.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "runforge",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    ``master`` is only applied when given; on a cluster the launcher sets it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for k in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled"):
        spark.conf.set(k, conf[k])
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def _scratch_for(master: str) -> str:
    """A local folder, when driver and executors are one machine; else an error."""
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="runforge-ckpt-")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session. Where it is unset, a local
    master gets a scratch folder and any other one an error. Sessions without a
    SparkContext (Spark Connect) use the configured value only.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            configured = _scratch_for(spark.conf.get("spark.master", ""))
            spark.conf.set("spark.checkpoint.dir", configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir", None) or _scratch_for(sc.master))
    return sc.getCheckpointDir()


def stream_checkpoint(spark: SparkSession, name: str) -> str:
    """Checkpoint location for a streaming query, under the shared folder."""
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, "streams", name)


def materialize(df, name: str = "stage"):
    """Cut lineage at a stage boundary: write ``df`` once as a Parquet table in
    the shared folder named by ``spark.checkpoint.dir`` and read it back.

    One computation (an RDD checkpoint computes the plan, then recomputes it
    to write unless persisted), columnar storage with column pruning for the
    later readers (measured faster downstream than a checkpoint), and the data
    survives executor loss. Never a machine-local checkpoint.
    """
    spark = df.sparkSession
    path = os.path.join(_stages(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _stages(spark: SparkSession) -> str:
    """This application's folder of stage tables."""
    return os.path.join(ensure_checkpoint_dir(spark), "tables", spark.sparkContext.applicationId)


def remove_stages(spark: SparkSession) -> None:
    """Delete the stage tables that this application has written.

    For the end of a job, when no DataFrame that reads them is needed any more:
    operators cannot know when their result has been consumed.
    """
    from runforge.sources import fixtures
    jvm, folder = spark.sparkContext._jvm, _stages(spark)
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    fixtures._STORED.clear()


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``runforge`` importable in Python workers (once per application).

    UDFs that use module-level helpers are pickled by reference, so workers
    must import the package; the package is zipped on the driver and shipped
    with ``SparkContext.addPyFile`` (Spark distributes it to every executor).
    """
    import zipfile

    try:
        sc = spark.sparkContext
        key = sc.applicationId
    except Exception:  # noqa: BLE001 - Spark Connect: ship as a session artifact
        sc, key = None, id(spark)
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    path = os.path.join(tempfile.mkdtemp(prefix="runforge-pyfiles-"), "runforge.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    if sc is not None:
        sc.addPyFile(path)
    else:
        spark.addArtifacts(path, pyfile=True)
    _SHIPPED.add(key)
