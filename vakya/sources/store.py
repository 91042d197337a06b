"""Tables written on the way, in a folder that all executors share: what they hold is computed once and survives the loss of executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it. Where it names none, a folder of our own serves on one machine only;
    on several, executors would write to their own disks, so there it's an error."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own and (set_ := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        own = set_.get()
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="vakya-")
        spark.conf.set("spark.checkpoint.dir", own)
        atexit.register(shutil.rmtree, own, True)
    return own


_homes: set[str] = set()
_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _sweep(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        _delete(spark, path)  # else the session is gone; the folder bears the application's id


def new_folder(spark: SparkSession) -> str:
    """A path of our own in the shared folder, removed when the driver ends."""
    home = f"{shared_dir(spark)}/vakya-{spark.sparkContext.applicationId}"
    if home not in _homes:
        _homes.add(home)
        atexit.register(_sweep, spark, home)
    return f"{home}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder. Removed when the driver ends, or by `release`."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove written tables that nothing still to be computed reads: what was made of them is written itself."""
    for df in tables:
        _delete(df.sparkSession, _paths.pop(df))
