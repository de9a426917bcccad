"""Tables that cut lineage, written in the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where that is unset, a temporary folder of this run if Spark is local, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomwright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has been written to; what is put there counts as a settled table."""
    path = f"{shared_dir(spark)}/loomwright/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """How many tables there are so far; clear() can spare these."""
    return len(_written)


def clear(spark: SparkSession, since: int = 0, last: bool = True) -> None:
    """Delete the settled tables of this process, those before `since` and (without last) the newest one spared. Only once nothing
    that reads them is to run any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    end = len(_written) if last else len(_written) - 1
    for _, path in _written[since:end]:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    del _written[since:end]


@atexit.register
def _clear_at_exit() -> None:
    try:
        if _written and _written[0][0].sparkContext._jsc is not None:
            clear(_written[0][0])
    except Exception:  # the session may be gone; the folder is then the cluster's to clean
        pass
