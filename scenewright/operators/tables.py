"""Tables that end a lineage: written to the folder that all executors share, deleted when they are no longer read."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_own: list[str] = []
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or on one machine, where it is unset, a temporary folder of this process."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(f"file://{tempfile.mkdtemp(prefix='atlas-')}")
        at = _own[0]
    return at.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/atlas/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and a lost executor costs nothing done before."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def dropped(*tables: DataFrame | None) -> None:
    """Delete the tables that written() made for these frames, once nothing reads them any more."""
    names = {p.rsplit("/", 1)[-1]: p for p in _written}
    for df in tables:
        for f in df.inputFiles()[:1] if df is not None else []:
            path = names.get(f.rsplit("/", 2)[-2])
            if path:
                delete(_written.pop(path), path)


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): the distinct keys of df, null left out, numbered from 0 in their order, however Spark deals them out:
    each partition of the sorted keys counts for itself, and the counts before it, one row a partition, are added."""
    dealt = df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key)
    dealt = written(dealt.select(key, F.monotonically_increasing_id().alias("m")))
    part = F.shiftright("m", 33)
    counts = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = counts.select("part", before.alias("first"))
    in_part = F.col("m").bitwiseAND((1 << 33) - 1)
    return dealt.withColumn("part", part).join(F.broadcast(first), "part").select(key, (F.col("first") + in_part).alias(name))


@atexit.register
def _clean() -> None:
    for path, spark in _written.items():
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended already; the folder is the cluster's to empty
            return
