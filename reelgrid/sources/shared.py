"""Tables written between steps of an iteration, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; on a local master without one, our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="reelgrid-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows written once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


class Watch:
    """How far a job's parts are, read while it runs, and a way to stop them from outside.

    Parts that are done are counted by an accumulator, which tasks that end send to the driver. Stopping makes a file in the shared folder, which tasks
    look for between two pieces of work; those that run end soon, and those that follow at once.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.done, self.total = spark, spark.sparkContext.accumulator(0), 0
        self.mark = f"{shared_folder(spark)}/stop-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.mark)
        self._files, self._path = path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def begun(self, parts: int) -> Callable[[], bool]:
        """Adds to the parts that there are; what a task asks to know whether to stop."""
        self.total += parts
        mark = self.mark

        def stopped() -> bool:
            from reelgrid.sources.ranged import opened

            try:
                with opened(mark):
                    return True
            except OSError:
                return False

        return stopped

    @property
    def fraction(self) -> float:
        """The share of parts that are done; none before the first is known. Parts that are tried again count twice, so it is held to one."""
        return min(1.0, self.done.value / self.total) if self.total else 0.0

    def stop(self) -> None:
        self._files.create(self._path, True).close()

    @property
    def stopped(self) -> bool:
        return self._files.exists(self._path)
