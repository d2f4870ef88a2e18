"""Where intermediate tables go: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Folders given out, of all sessions of this driver, in order.
_folders: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, where the session names one.

    Without it a local session gets a temporary folder, and a cluster the warehouse, unless that is on
    the driver's own disk: then the setting is asked for.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    app = spark.sparkContext.applicationId
    if app not in _own:
        if spark.sparkContext.master.split("[")[0] == "local":
            _own[app] = tempfile.mkdtemp(prefix="cohortia-")
        else:
            warehouse = spark.conf.get("spark.sql.warehouse.dir")
            if warehouse.startswith("file:"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            _own[app] = f"{warehouse}/_scratch"
    return _own[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path not used before, under `scratch_root`."""
    _folders.append(f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}")
    return _folders[-1]


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a scratch folder with all that is in it; nothing if it is not there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stash(df: DataFrame, name: str = "table") -> DataFrame:
    """Write `df` as Parquet in a new shared folder and read it again: lineage ends here."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], name: str = "table") -> DataFrame:
    """What `make` gives, written and read again; the scratch tables made on the way are removed then.

    For the steps of a long job, whose intermediate tables would else stay until the folder is cleared. One
    job of a driver at a time, as all folders given out in between are taken to be the step's.
    """
    before = len(_folders)
    out = stash(make(), name)
    kept = _folders[-1]
    for folder in _folders[before:-1]:
        remove(out.sparkSession, folder)
    _folders[before:] = [kept]
    return out
