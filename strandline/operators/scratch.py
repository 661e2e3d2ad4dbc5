"""Intermediate tables in the shared folder that the cluster names in spark.checkpoint.dir.

A written table cuts the lineage and outlives any executor.  Only where the
setting is missing, as in local tests, a temporary folder of the driver is used.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[str] = []


@atexit.register
def _leave() -> None:
    for path in _own.values():
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def mark() -> int:
    """A place in the list of scratch folders, for `drop_since`."""
    return len(_made)


def drop_since(spark: SparkSession, place: int) -> None:
    """Deletes the scratch folders made since `place`; nothing may read them any more."""
    for root in _made[place:]:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    del _made[place:]


def shared_dir(spark: SparkSession) -> str:
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="strandline-"))


class Scratch:
    """Tables of one run of an operator, each under its own name."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.serial = 0
        _made.append(self.root)

    def save(self, frame: DataFrame, name: str) -> DataFrame:
        self.serial += 1
        path = f"{self.root}/{self.serial:03d}-{name}"
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def keep(self, *names: str) -> None:
        """Deletes all tables but those of these names; nothing may read the others any more."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(root):
            for status in fs.listStatus(root):
                if status.getPath().getName().split("-", 1)[1] not in names:
                    fs.delete(status.getPath(), True)
