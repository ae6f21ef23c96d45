"""Written intermediate tables: they cut lineage and outlive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only where that is unset, as in tests, one is made."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    made = sc._jsc.sc().getCheckpointDir()
    if made.isDefined():
        return made.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="morphspark-"))
    return sc._jsc.sc().getCheckpointDir().get()


class Scratch:
    """Tables of one operator's run, in a folder of their own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}

    def table(self, df: DataFrame) -> DataFrame:
        """Writes the rows and returns the written table."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._scratch = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Removes tables that nothing reads any more."""
        jvm = self.spark._jvm
        for t in tables:
            if t is not None and (path := getattr(t, "_scratch", None)):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
