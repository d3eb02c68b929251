"""Several tables that change together: a manifest names the snapshot of each, and commits replace it by compare-and-swap.

``path/tables/<name>/<snapshot>`` holds Parquet; ``path/manifests/<version>``
maps table names to snapshots.  A commit writes the changed tables as new
snapshots and then renames its manifest to the next version, which fails if
another commit has that version: then the change is made again on what the other
one left.  Readers take one version and see all its tables; a run that ends
before its manifest is there has changed nothing.  The folder's file system must
refuse a rename onto a name that exists, as HDFS and local disks do.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(Exception):
    """Other commits came first, more often than was tried."""


class Snapshot:
    """The tables of one version."""

    def __init__(self, database: Database, version: int, files: dict[str, str]):
        self.database, self.version, self.files = database, version, files

    def read(self, table: str) -> DataFrame:
        """A table's rows; none before its first write."""
        db, schema = self.database, self.database.schemas[table]
        if table not in self.files:
            return db.spark.createDataFrame([], schema)
        return db.spark.read.schema(schema).parquet(f"{db.path}/tables/{table}/{self.files[table]}")

    def __getitem__(self, table: str) -> DataFrame:
        return self.read(table)


class Database:
    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, StructType | str]):
        self.spark, self.path = spark, path.rstrip("/")
        self.schemas = {t: StructType.fromDDL(s) if isinstance(s, str) else s for t, s in schemas.items()}

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def versions(self) -> list[int]:
        """The numbers of all manifests there are, the current one last."""
        fs, folder = self._fs(f"{self.path}/manifests")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The tables as of a version, else of the current one; version 0 has no rows."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return Snapshot(self, 0, {})
        fs, path = self._fs(f"{self.path}/manifests/{version:020d}")
        stream = fs.open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Snapshot(self, version, json.loads(text))

    def _published(self, version: int, files: dict[str, str]) -> bool:
        """Whether the manifest became that version: no other commit has it."""
        fs, path = self._fs(f"{self.path}/manifests/{version:020d}")
        text, draft = json.dumps(files, sort_keys=True).encode(), path.suffix(f".{uuid.uuid4().hex}")
        if fs.getScheme() == "file":
            # Hadoop's local rename looks first and then moves; a link is made by one of two only
            target = path.toUri().getPath()
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(draft.toUri().getPath(), "wb") as f:
                f.write(text)
            try:
                os.link(f.name, target)
            except FileExistsError:
                return False
            finally:
                os.remove(f.name)
            return True
        out = fs.create(draft)
        out.write(bytearray(text))
        out.close()
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        how = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # never onto another
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(draft, path, how)
        except Py4JJavaError:
            fs.delete(draft, False)
            if fs.exists(path):
                return False
            raise
        return True

    def commit(self, change: Callable[[Snapshot], dict[str, DataFrame]], attempts: int = 5) -> Snapshot:
        """Applies ``change`` to the current tables; all tables that it returns are replaced, or none.

        ``change`` gets the snapshot and can run again on a newer one.  A change
        of no table leaves the version as it is.
        """
        for _ in range(attempts):
            base = self.snapshot()
            new = change(base)
            if not new:
                return base
            files = dict(base.files)
            for table, df in new.items():
                schema, name = self.schemas[table], f"v-{uuid.uuid4().hex}"
                df.select(*[df[f.name].cast(f.dataType) for f in schema]).write.parquet(f"{self.path}/tables/{table}/{name}")
                files[table] = name
            if self._published(base.version + 1, files):
                return Snapshot(self, base.version + 1, files)
        raise Conflict(f"{attempts} commits of others came first")

    def vacuum(self, keep: int = 10) -> int:
        """Deletes all but the last ``keep`` manifests and the snapshots that only those had; how many snapshots went.

        Snapshots that no manifest names are left: a commit may be about to publish them.
        """
        known = self.versions()
        old, kept = known[:-keep], known[-keep:]
        used = {item for v in kept for item in self.snapshot(v).files.items()}
        gone = {item for v in old for item in self.snapshot(v).files.items()} - used
        for v in old:
            fs, path = self._fs(f"{self.path}/manifests/{v:020d}")
            fs.delete(path, False)
        for table, name in gone:
            fs, path = self._fs(f"{self.path}/tables/{table}/{name}")
            fs.delete(path, True)
        return len(gone)
