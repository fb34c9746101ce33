"""Session construction and shared-storage helpers.

Every operator in the library is lazy; the settings below are the ones that matter
for the plans it builds: AQE (runtime coalescing, broadcast conversion, skew-join
splitting), a UTC session clock, and Arrow for the few pandas-backed steps.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # long-running drivers: keep little per-query history in driver memory
    "spark.sql.ui.retainedExecutions": "50",
    "spark.ui.retainedJobs": "100",
    "spark.ui.retainedStages": "100",
    "spark.ui.retainedTasks": "10000",
}


#: Settings for the ~100 TB target (applied with ``profile="cluster"``). The
#: initial shuffle width is generous and AQE coalesces it to ~256 MB partitions;
#: skewed join partitions above 1 GB (and 5x the median) are split; executors
#: being decommissioned hand their shuffle and cached blocks to peers so a lost
#: node does not force stage recomputation; tasks retry before a job fails.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1g",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.decommission.enabled": "true",
    "spark.storage.decommission.enabled": "true",
    "spark.storage.decommission.shuffleBlocks.enabled": "true",
    "spark.storage.decommission.rddBlocks.enabled": "true",
    "spark.task.maxFailures": "8",
    "spark.stage.maxConsecutiveAttempts": "8",
}


def get_session(master: str | None = None, app: str = "cirrus",
                shuffle_partitions: int | None = None, extra: dict | None = None,
                profile: str = "local") -> SparkSession:
    """Build (or reuse) a session with the library's defaults.

    On a cluster ``master`` stays None (spark-submit decides), ``profile="cluster"``
    adds :data:`CLUSTER_CONF`, and ``spark.checkpoint.dir`` must name a shared
    folder. In tests the shuffle width is the core count.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if profile == "cluster":
        conf.update(CLUSTER_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint root.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS/S3/...) and
    is used as is; a cluster session without it is an error, because a
    machine-local folder is not visible to other executors or a restarted
    driver. Only a local-mode session (tests, a laptop) with nothing configured
    gets a fresh local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS, S3, ...) for this cluster")
        conf_dir = tempfile.mkdtemp(prefix="cirrus-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared checkpoint root, for written intermediate
    tables, stream checkpoints and queue folders, in storage that every executor (and
    a restarted driver) can see. Writers create it; :func:`remove_dir` deletes it."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/cirrus/{name}/{uuid.uuid4().hex}"


def filesystem(spark: SparkSession, path: str):
    """(Hadoop file system, path): whatever store the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def dir_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, by Spark's own file system."""
    fs, target = filesystem(spark, path)
    return fs.exists(target)


def make_dir(spark: SparkSession, path: str) -> str:
    """Create a folder (a stream source must exist before its first file)."""
    fs, target = filesystem(spark, path)
    fs.mkdirs(target)
    return path


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder once nothing reads it any more."""
    fs, target = filesystem(spark, path)
    fs.delete(target, True)


def ensure_utc(spark: SparkSession) -> None:
    """All time semantics in the library are defined in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
