"""What every job needs from its session: the shared work folder and the package on the executors."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Bytes of an Arrow batch on its way to Python, unless the session says otherwise: a batch is held several times over.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python workers can import it; bound Arrow batches by bytes."""
    if BATCH[0] not in spark.conf.getAll:
        spark.conf.set(*BATCH)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lodestone-ship-")
    target = os.path.join(folder, "lodestone_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where it is unset a temporary one, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc()
        known = jsc.getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def release(spark: SparkSession) -> None:
    """Let the driver's cleaner delete shuffle files that no live plan refers to, instead of whenever it next collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Workspace:
    """Tables written to the shared folder: they cut lineage and survive lost executors.

    Tables that no later plan reads are removed with drop(); those a returned DataFrame still reads stay
    until the owner of the shared folder clears it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/lodestone-{name}-{uuid.uuid4().hex[:12]}"

    def table(self, name: str, df: DataFrame, *partition_by: str) -> DataFrame:
        path = f"{self.base}/{name}"
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        release(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(conf).delete(path, True)

