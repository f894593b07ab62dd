"""Files in the folder that driver and executors share: intermediate tables, and small files that appear whole."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def working_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where none is set and the master is local."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='shared-')}")
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """The table written as Parquet and reread, which cuts its lineage: a lost executor then costs a read."""
    path = f"{working_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """A folder's files through the file system that Spark itself uses."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.conf, self.folder = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), folder
        self.system = self.path().getFileSystem(self.conf)

    def path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def exists(self, name: str = "") -> bool:
        return self.system.exists(self.path(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.system.listStatus(self.path(name))) if self.exists(name) else []

    def remove(self, name: str = "") -> None:
        self.system.delete(self.path(name), True)

    def read(self, name: str) -> str:
        stream = self.system.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def claim(self, name: str, text: str) -> bool:
        """Makes a file that is there whole or not at all; False if another writer's is there already."""
        draft = self.path(f"_drafts/{uuid.uuid4().hex}")
        stream = self.system.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.system.mkdirs(self.path(name).getParent())
        won = not self.system.exists(self.path(name)) and self.system.rename(draft, self.path(name))
        if not won:
            self.system.delete(draft, False)
        return won


def spread(rows: DataFrame) -> DataFrame:
    """Rows of fewer files than cores dealt to all cores, for work that costs more than their shuffle; others stay."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows
