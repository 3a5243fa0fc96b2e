"""Tables that cut lineage, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and Spark runs in one process, a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "folder" not in _own:
        _own["folder"] = tempfile.mkdtemp(prefix="spanloom-")
        atexit.register(shutil.rmtree, _own["folder"], ignore_errors=True)
    return _own["folder"]


#: Rows of an Arrow batch at most, since rows hold whole texts.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows: they are read when a result runs, after its operator has returned."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


#: Bytes of text for each partition, and partitions at most.
TASK_BYTES = 64 << 20
MOST_PARTS = 1 << 16


def partitions(spark: SparkSession, size: int, task_bytes: int = TASK_BYTES) -> int:
    """Partitions for size bytes: the session's shuffle partitions at least, and no more than task_bytes each up to MOST_PARTS."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, -(-size // task_bytes)))


#: With it an execution deletes its exchanges' files when it has ended; else they stay until the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """Parquet tables of one run; they go when they are dropped, or with the JVM."""

    def __init__(self, spark: SparkSession):
        bounded_batches(spark)
        self.spark = spark
        self.path = f"{shared_folder(spark).rstrip('/')}/spanloom-{uuid.uuid4().hex}"
        self.count = 0
        where = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(where)

    def keep(self, df: DataFrame, batch_rows: int | None = None) -> DataFrame:
        """df, written and read again; batch_rows: of each Arrow batch, where rows are large."""
        self.count += 1
        to = f"{self.path}/{self.count}"
        settings = {CLEANUP: "true"} | ({"spark.sql.execution.arrow.maxRecordsPerBatch": batch_rows} if batch_rows else {})
        before = {name: self.spark.conf.get(name, None) for name in settings}
        try:
            for name, value in settings.items():
                self.spark.conf.set(name, value)
            df.write.parquet(to)  # what is written needs its exchanges no more
        finally:
            for name, value in before.items():
                if value is None:
                    self.spark.conf.unset(name)
                else:
                    self.spark.conf.set(name, value)
        return self.spark.read.schema(df.schema).parquet(to)

    def size(self, kept: DataFrame) -> int:
        """Bytes of a kept table's files."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return sum(self._fs.getContentSummary(path(folder)).getLength() for folder in {f.rpartition("/")[0] for f in kept.inputFiles()})

    def drop(self, *kept: DataFrame) -> None:
        """Delete the files of tables that nothing will read again."""
        for df in kept:
            for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
                if "/spanloom-" in folder:
                    self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(folder), True)
