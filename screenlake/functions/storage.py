"""Tables that outlive the executors which made them.

``stored`` cuts a plan's lineage by writing it as Parquet below ``spark.checkpoint.dir``, the folder
that driver and executors share; later reads survive the loss of any executor.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_PLACES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the session names; in tests, where it names none, one is made for the process."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not _LOCAL:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _LOCAL.append(tempfile.mkdtemp(prefix="screenlake-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/screenlake/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PLACES[table] = path
    return table


def removed(*tables: DataFrame) -> None:
    """Delete stored tables. What was made of them must be stored by now: no later plan may read them."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(_PLACES.pop(table))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
