"""Stores, snapshots, seed lists and canons as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenewright.functions.text import fold_term

CITY_CANON = "nonPlaces array<string>, cityAliases map<string,string>"
ACCOUNT_CANON = "hubs array<string>, hubTerms array<string>, artists array<string>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a store has a table at that path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def with_columns_of(df: DataFrame, schema: str) -> DataFrame:
    """df with the columns that it lacks of a schema, as nulls behind its own; those that it has stay as they are."""
    want = T.StructType.fromDDL(schema)
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in want if f.name not in df.columns])


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table in at least a schema's columns; empty where the store doesn't have it yet."""
    return with_columns_of(spark.read.parquet(path), schema) if exists(spark, path) else spark.createDataFrame([], schema)


def write_snapshot(tables: dict[str, DataFrame], root: str, run: int) -> str:
    """Each table as gzip JSON lines in the run's folder, whose path is returned."""
    folder = f"{root.rstrip('/')}/run-{run:04d}"
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "gzip").option("ignoreNullFields", "false").json(f"{folder}/{name}.ndjson")
    return folder


def read_lines(spark: SparkSession, path: str, schema: str, key: str, skip: int = 0) -> DataFrame:
    """Objects of JSON lines, one for each key, without the `skip` least keys. Lines that aren't objects don't count."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where(F.col(key).isNotNull()).dropDuplicates([key])
    return rows.join(rows.select(key).orderBy(key).limit(skip), key, "left_anti") if skip else rows


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file of one object; without the file, nulls."""
    if not exists(spark, path):
        return spark.createDataFrame([tuple(None for _ in T.StructType.fromDDL(schema))], schema)
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def seeds(spark: SparkSession, path: str, urn_prefix: str, site: str) -> DataFrame:
    """(entry, urn, url) of a seed list {"seeds": [...]}: an urn is taken as it is, a full url or a permalink of the
    site has yet to be resolved. A list without seeds is an error."""
    told = _document(spark, path, "seeds array<string>").select(F.explode("seeds").alias("entry"))
    if told.isEmpty():
        raise ValueError(f"{path} contains no seeds")
    urn = F.when(F.startswith("entry", F.lit(urn_prefix)), F.col("entry"))
    url = F.when(F.startswith("entry", F.lit("http")), F.col("entry")).otherwise(F.concat(F.lit(f"{site.rstrip('/')}/"), "entry"))
    return told.select("entry", urn.alias("urn"), F.when(urn.isNull(), url).alias("url"))


def city_canon(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(fold) of what is no place, and (fold, city) of other spellings; both empty without the file."""
    canon = _document(spark, path, CITY_CANON)
    none = canon.select(F.explode("nonPlaces").alias("name")).select(fold_term(F.col("name")).alias("fold")).where("fold != ''").distinct()
    named = canon.select(F.explode("cityAliases").alias("spelling", "city"))
    return none, named.select(fold_term(F.col("spelling")).alias("fold"), "city").where("fold != ''").dropDuplicates(["fold"])


def account_canon(spark: SparkSession, path: str) -> DataFrame:
    """(kind, name): hub and artist permalinks in lower case, hub terms folded; empty without the file."""
    canon = _document(spark, path, ACCOUNT_CANON)

    def part(kind: str, field: str, put) -> DataFrame:
        return canon.select(F.explode(field).alias("name")).select(F.lit(kind).alias("kind"), put(F.col("name")).alias("name"))

    told = part("hub", "hubs", F.lower).unionByName(part("artist", "artists", F.lower)).unionByName(part("term", "hubTerms", fold_term))
    return told.where("name != ''").distinct()


def roster(json: Column) -> Column:
    """The entries of a stored roster; counts that an entry lacks are 0."""
    entry = "array<struct<urn:string,permalink:string,followers:bigint,plays:bigint,likes:bigint,comments:bigint>>"
    counts = ["followers", "plays", "likes", "comments"]
    return F.transform(F.from_json(json, entry), lambda x: F.struct(x["urn"].alias("urn"), x["permalink"].alias("permalink"), *[F.coalesce(x[c], F.lit(0)).alias(c) for c in counts]))
