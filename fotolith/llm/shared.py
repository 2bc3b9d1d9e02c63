"""The folder that the driver and all executors share, and tables written there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a folder of this machine is made and set,
    but only if the executors are on this machine too; a cluster without the setting is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="fotolith-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder, so that reruns and concurrent runs don't meet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark then removes the shuffle files of a job when it is over, not when the driver's memory is cleaned.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str, **options: str) -> None:
    """Writes a Parquet table. Nothing reads the job's shuffle files again, so they go at once."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written as a Parquet table in the shared folder and read back: it cuts the lineage,
    and survives the loss of any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    write_table(df, path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Removes tables that `written` returned, once nothing will read them again."""
    for table in tables:
        spark = table.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if path.startswith(shared_folder(spark)) or path.startswith(shared_folder(spark).replace("file://", "file:")):
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bounded_batches(df: DataFrame, limit: int = 4 << 20) -> None:
    """Rows go to Python workers in batches of at most about `limit` bytes, or one row: executors hold
    each batch twice. Lowers the session's setting, never raises it."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", conf.get(name).strip().lower()).groups()
    if not 0 < int(number) << 10 * " kmgtp".index(unit or " ") <= limit:
        conf.set(name, str(limit))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of all texts, by one aggregate."""
    from pyspark.sql import functions as F

    return int(df.agg(F.sum(F.octet_length(F.col(column)).cast("long"))).first()[0] or 0)
