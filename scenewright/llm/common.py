"""Small helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that one window task numbers.
ROWS_PER_TASK = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, on one machine, a temporary one set here."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(f"file://{tempfile.mkdtemp(prefix='shared-')}")
        at = _own[0]
    return at.rstrip("/")


_own: list[str] = []
_written: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended already; the folder is the cluster's to empty
            return


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: its lineage ends there, and a lost executor costs
    no work that was done before. The tables go when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the table that cut() wrote for df, once nothing reads it any more."""
    spark = df.sparkSession
    mine = {p.rsplit("/", 1)[-1]: p for _, p in _written}
    for f in df.inputFiles()[:1]:
        if (name := f.rsplit("/", 2)[-2]) in mine:
            _delete(spark, mine[name])
            _written[:] = [x for x in _written if x[1] != mine[name]]


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sliced(rows: int, per: int = ROWS_PER_TASK) -> int:
    """Slices so that each has about `per` rows."""
    return max(1, -(-rows // per))


def gapless(df: DataFrame, group: list[str], order: list[str], name: str, rows: int) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in no task more than about ROWS_PER_TASK rows.

    A group is dealt into slices by a hash of its order columns; the slices' counts, summed up in slice order, give
    each slice its first number, and a window numbers the rows inside a slice. Rows equal in all order columns fall
    into one slice and are interchangeable, so the numbering is the same in every run as a set of rows. rows: the
    rows of df, from which the number of slices follows. Nulls in any column are values like others."""
    n = sliced(rows)
    cut_by = F.pmod(F.xxhash64(F.lit("slice"), *order), F.lit(n)).cast("int")
    dealt = df.withColumn("_gapless_slice", cut_by)
    counts = dealt.groupBy(*group, "_gapless_slice").agg(F.count("*").alias("_gapless_n"))
    before = Window.partitionBy(*group).orderBy("_gapless_slice").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(
        *[F.col(g).alias(f"_gapless_{i}") for i, g in enumerate(group)],
        F.col("_gapless_slice").alias("_gapless_s"),
        F.coalesce(F.sum("_gapless_n").over(before), F.lit(0)).alias("_gapless_first"),
    )
    inside = Window.partitionBy(*group, "_gapless_slice").orderBy(*order)
    on = F.col("_gapless_slice") == F.col("_gapless_s")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_gapless_{i}"))
    numbered = dealt.withColumn("_gapless_in", F.row_number().over(inside) - 1)
    out = numbered.join(first, on).withColumn(name, (F.col("_gapless_first") + F.col("_gapless_in")).cast("long"))
    return out.drop("_gapless_slice", "_gapless_s", "_gapless_in", "_gapless_first", *[f"_gapless_{i}" for i in range(len(group))])


def most_frequent(told: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of told (n, ...) with the greatest n, at most `most`, and the others, None if there are none. Counts
    are told apart by eighths of their binary logarithm."""
    size = F.floor(8 * F.log2(F.greatest("n", F.lit(0.5)))).cast("int")
    least, room = None, most
    for of, n in sorted(told.groupBy(size.alias("size")).agg(F.count("*")).collect(), reverse=True):  # 8 x 63 rows at most
        if n > room:
            break
        least, room = of, room - n
    else:
        return told, None
    return (told.limit(0), told) if least is None else (told.where(size >= least), told.where(size < least))


#: Keys with so many rows that their one row of the other side goes to all tasks instead; at most 1 / HOT_SHARE of them.
HOT_SHARE, HOT_ROWS = 1e-4, 128


def join_hot(rows: DataFrame, one: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows joined with `one`, which has a row for each of its keys and in n how many of rows have that key (dropped).

    A key may hold any share of the rows: what belongs to keys of at least HOT_SHARE of them is never shuffled."""
    hot = F.col(n) >= max(HOT_ROWS, HOT_SHARE * total)
    mark = F.lit(True).alias("_hot")
    often, seldom = one.where(hot).drop(n), one.where(~hot).drop(n)
    marked = rows.join(F.broadcast(often.select(key, mark)), key, "left")  # at most 1 / HOT_SHARE rows
    cold = marked.where("_hot is null").drop("_hot").join(seldom, key)
    return cold.unionByName(rows.join(F.broadcast(often), key))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LONG, DOUBLE, STRING = T.LongType(), T.DoubleType(), T.StringType()
