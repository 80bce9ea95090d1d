"""A store of tables that are replaced or merged as one: data first, then one file that names the live version.

    <root>/data/<write>/<table>/bucket=<b>/...   the rows, by a hash of their keys
    <root>/versions/<number>.json                which write holds each table's buckets

A version's file is made under another name and renamed to its number, which fails if that exists; so a version is there
as a whole or not at all, and of two writers one fails. Readers keep the version that they opened: its data stay until
vacuum(). A write that dies before the rename leaves the version before it as it was."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer made the version that this one was about to make."""


@dataclass(frozen=True)
class Version:
    """tables: name to {schema, keys, buckets, at: {bucket: write}}; sources: the last batch merged of each source."""

    number: int
    tables: dict
    sources: dict


class Store:
    """Tables under one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, at: str):
        return self.jvm.org.apache.hadoop.fs.Path(at)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.conf)

    def version(self, number: int | None = None) -> Version:
        """The live version, or one by its number; number 0 is the empty store."""
        folder = self._path(f"{self.root}/versions")
        fs = self._fs()
        if number is None:
            names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
            number = max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)
        if not number:
            return Version(0, {}, {})
        stream = fs.open(self._path(f"{self.root}/versions/{number:010d}.json"))
        try:
            told = json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(number, told["tables"], told["sources"])

    def _make(self, version: Version) -> Version:
        fs, name = self._fs(), f"{self.root}/versions/{version.number:010d}.json"
        draft = f"{self.root}/versions/.draft-{uuid.uuid4().hex}"
        out = fs.create(self._path(draft), False)
        out.write(bytearray(json.dumps({"tables": version.tables, "sources": version.sources}).encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self.conf)
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(self._path(draft)), fs.makeQualified(self._path(name)), options)
        except Exception as e:
            fs.delete(self._path(draft), False)
            raise Conflict(f"version {version.number} of {self.root} is there already") from e
        return version

    def read(self, table: str, version: Version | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table of a version, or some of its buckets, without reading the others."""
        told = (version or self.version()).tables[table]
        at = {b: w for b, w in told["at"].items() if buckets is None or int(b) in buckets}
        paths = [f"{self.root}/data/{w}/{table}/bucket={b}" for b, w in at.items()]
        return self.spark.read.schema(told["schema"]).parquet(*paths) if paths else self.spark.createDataFrame([], told["schema"])

    def _write(self, table: str, df: DataFrame, keys: list[str], buckets: int) -> tuple[str, list[int]]:
        """The write's name, and the buckets that it has."""
        write = uuid.uuid4().hex
        at = f"{self.root}/data/{write}/{table}"
        dealt = df.withColumn("bucket", bucket_of(keys, buckets))
        dealt.repartition(F.col("bucket")).write.partitionBy("bucket").parquet(at)
        fs = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(self._path(at))]
        return write, sorted(int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket="))

    def publish(self, tables: dict[str, tuple[DataFrame, list[str]]], buckets: int = 16) -> Version:
        """Replace tables (rows, keys), all of them in one version; other tables stay as they are. Publishing the same
        rows again makes equal tables."""
        now = self.version()
        made = dict(now.tables)
        for name, (df, keys) in tables.items():
            write, found = self._write(name, df, keys, buckets)
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
            made[name] = {"schema": schema, "keys": keys, "buckets": buckets, "at": {str(b): write for b in found}}
        return self._make(Version(now.number + 1, made, now.sources))

    def merge(
        self, table: str, batch: DataFrame, keys: list[str], fold: Callable[[DataFrame], DataFrame], source: str | None = None, number: int | None = None, buckets: int = 16
    ) -> Version:
        """Fold a batch into a table, whose columns it has: only the buckets of its keys are read and written.

        fold: rows of old and new to one of each key, so that folding again changes nothing. A batch of a source with a
        number that is not above the last one merged is left out, so one that is repeated after a failure counts once.
        A table that isn't there yet begins empty."""
        now = self.version()
        if source is not None and number is not None and now.sources.get(source, -1) >= number:
            return now
        told = now.tables.get(table) or {
            "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema), "keys": keys, "buckets": buckets, "at": {},
        }
        touched = [r[0] for r in batch.select(bucket_of(told["keys"], told["buckets"]).alias("b")).distinct().collect()]  # as many as buckets at most
        old = self.read(table, Version(now.number, {**now.tables, table: told}, now.sources), touched)
        both = old.unionByName(batch.select(old.columns))
        write, found = self._write(table, fold(both).select(old.columns), told["keys"], told["buckets"])
        at = {b: w for b, w in told["at"].items() if int(b) not in touched} | {str(b): write for b in found}
        sources = now.sources | ({source: number} if source is not None and number is not None else {})
        return self._make(Version(now.number + 1, {**now.tables, table: {**told, "at": at}}, sources))

    def vacuum(self, keep: int = 2) -> int:
        """Delete the versions before the last `keep`, and the buckets that no version left names. How many went."""
        last, fs = self.version(), self._fs()
        kept = [self.version(n) for n in range(max(1, last.number - keep + 1), last.number + 1)]
        live = {f"{w}/{name}/bucket={b}" for v in kept for name, t in v.tables.items() for b, w in t["at"].items()}
        below = lambda path: [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
        gone = 0
        for path in below(self._path(f"{self.root}/versions")):
            name = path.getName()
            if not name.endswith(".json") or int(name.removesuffix(".json")) <= last.number - keep:
                fs.delete(path, False)
        for write in below(self._path(f"{self.root}/data")):
            some = False
            for table in below(write):
                for bucket in below(table):
                    if f"{write.getName()}/{table.getName()}/{bucket.getName()}" in live:
                        some = True
                    elif bucket.getName().startswith("bucket="):
                        fs.delete(bucket, True)
                        gone += 1
            if not some:
                fs.delete(write, True)
        return gone


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
