"""Row sources, and rows written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def _base(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="sparkloom-")
            atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
        base = f"file://{_local[app]}"
    elif "://" not in base and not base.startswith("file:"):
        base = f"file://{base}"
    return f"{base.rstrip('/')}/sparkloom-{app}"


def workspace(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent and Spark runs inside one process is a local folder made, which goes when the
    process ends; a cluster without the setting is an error.
    """
    return f"{_base(spark)}/{uuid.uuid4().hex}"


def remove_workspaces(spark: SparkSession) -> None:
    """Delete all that workspace() gave this application; no DataFrame that came from it can be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_base(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder and read again.

    This cuts the lineage without tying any block to one executor, keeps row numbers and the results of functions such
    as now() as they are, and gives the planner true sizes.
    """
    path = f"{workspace(df.sparkSession)}/part"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Sources:
    """Ordered providers of tables: functions from a name to a DataFrame or None. The first that answers wins."""

    def __init__(self, providers: Iterable[Callable[[str], DataFrame | None]] = ()) -> None:
        self.providers = list(providers)

    def find(self, name: str) -> DataFrame | None:
        return next((df for p in self.providers if (df := p(name)) is not None), None)


def parquet_folder(spark: SparkSession, folder: str, names: Iterable[str]) -> Callable[[str], DataFrame | None]:
    """A provider of the Parquet tables of a folder, by case-insensitive name."""
    known = {n.lower(): n for n in names}
    return lambda name: spark.read.parquet(f"{folder}/{known[name.lower()]}.parquet") if name.lower() in known else None


def appended(df: DataFrame, rows: DataFrame) -> DataFrame:
    """df and rows, after a check that the columns agree in number, name and type."""
    if [(f.name.lower(), f.dataType) for f in df.schema] != [(f.name.lower(), f.dataType) for f in rows.schema]:
        raise ValueError(f"columns differ: {df.schema.simpleString()} and {rows.schema.simpleString()}")
    return df.unionAll(rows)
