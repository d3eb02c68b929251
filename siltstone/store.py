"""Versioned tables: a snapshot directory for each write and a pointer to the current one."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints, which all machines share; a temporary one only where all runs on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="siltstone-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder, so that later plans start from it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Table:
    """Readers see the snapshot that the pointer names; a write becomes visible when the pointer is replaced."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _pointer(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/CURRENT")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def current(self) -> str | None:
        fs, path = self._pointer()
        return self.spark.read.text(path.toString()).first()[0] if fs.exists(path) else None

    def read(self) -> DataFrame:
        name = self.current()
        return self.spark.createDataFrame([], self.schema) if name is None else self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}")

    def write(self, df: DataFrame) -> str:
        """A new snapshot; readers of the old one are not disturbed."""
        name = f"v-{uuid.uuid4().hex}"
        df.select(*[df[f.name].cast(f.dataType) for f in self.schema]).write.parquet(f"{self.path}/{name}")
        fs, path = self._pointer()
        draft = path.suffix("." + name)
        out = fs.create(draft)
        out.write(bytearray(name.encode()))
        out.close()
        # one rename over the old pointer: readers find the old snapshot or the new one
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(draft, path, how)
        return name
