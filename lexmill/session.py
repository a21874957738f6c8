"""Session helpers shared by all operators: tables, shared scratch folder, code shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


#: Bytes of a table from which it pays to deal it to all cores.
SPREAD_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of ``sf_dir``, read by Spark alone so that any store works."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(table: DataFrame) -> DataFrame:
    """``table`` dealt to all cores if it comes in fewer splits, as a single row group does.

    Large tables have more splits than cores and are never shuffled here; columns and filters
    are still pushed into the scan.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    if int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SPREAD_BYTES or table.rdd.getNumPartitions() >= cores:
        return table
    return table.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir``; where that is unset in local mode (tests) a local temporary
    folder is made once and set on the context. On a cluster it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get().rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexmill-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, so a lost executor costs at most the tasks that were running, and
    a plan used in several branches runs once.
    """
    path = f"{shared_dir(df.sparkSession)}/lexmill-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lexmill_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and no plan needs any more.

    What a returned plan still reads must stay; it is cleared with the shared folder.
    """
    for table in tables:
        path = getattr(table, "_lexmill_path", None)
        if path:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per Spark context.

    Executors share no folder with the driver, so Arrow functions of this package would
    otherwise fail to unpickle there.
    """
    context = spark.sparkContext
    if getattr(context, "_lexmill_shipped", False):
        return
    out = os.path.join(tempfile.mkdtemp(prefix="lexmill-code-"), "lexmill_code.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, str(Path("lexmill") / p.relative_to(_PACKAGE)))
    context.addPyFile(out)
    context._lexmill_shipped = True
