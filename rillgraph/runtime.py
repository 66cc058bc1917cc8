"""Session helpers: the shared scratch folder and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_LEFT: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="rillgraph-"))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no more than the stage it was in.

    ``keep`` writes a DataFrame as Parquet and returns the written table; ``drop`` removes tables that nothing
    reads any more. What is left goes when the driver's process ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.base = f"{shared_dir(spark)}/rillgraph/{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        _LEFT.add(self.base)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{len(self.paths)}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _delete(self.spark, t._scratch)


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    for base in _LEFT:
        try:
            _delete(spark, base)
        except Exception:  # the session may be gone already
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
