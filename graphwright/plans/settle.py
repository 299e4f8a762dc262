"""Cutting lineage in the folder that the cluster shares, so that a lost executor loses nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where the setting is unset, a temporary folder is made and set on the
    context if all runs on one machine; on a cluster, whose executors don't share it, that is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the cluster shares")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="graphwright-"))
    return sc.getCheckpointDir()


#: Shuffled bytes of a task: terms are texts that are packed to a fraction, and a task of Spark's 64 MB holds some GB of them.
TASK_BYTES = "8m"
_ADVISED, _SPARKS = "spark.sql.adaptive.advisoryPartitionSizeInBytes", 64 << 20


def small_tasks(spark: SparkSession) -> None:
    """A session that has Spark's own size of a task after a shuffle gets ``TASK_BYTES``; another size stays."""
    if spark.conf.get(_ADVISED).lower() in (f"{_SPARKS}b", str(_SPARKS), "64m", "64mb"):
        spark.conf.set(_ADVISED, TASK_BYTES)


def settle(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: a plan of one scan."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_settled(df: DataFrame) -> None:
    """Deletes the files behind a settled frame that no later step reads."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for parent in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)
