"""A sharded table with size-tiered compaction, in DataFrame operations only.

Arrivals are appended as small immutable Parquet shards. Compaction groups the shards of the current version by
size tier (powers of ``fanout``); a tier with at least ``fanout`` shards below the target size is merged into files
of about ``target_bytes``, without a shuffle: the reader packs neighbouring files into tasks and each task writes
one file. Every change ends with one commit: the complete list of live shards and the table's schema are written beside the
table and renamed to the next version number, a rename that fails if another writer took the number. Readers see whole
versions only; shards that a version no longer lists stay until ``vacuum``.

Edge cases: an arrival may have any name; a null name counts as the empty one. An arrival may bring new columns, which are null in
older rows, and may lack columns; a column of another type, or one that differs in case only, is refused before anything
is written, as is a column named ``__shard``. Null values, repeated rows and empty texts are kept as they are. An append
or a merge that lists other rows than it wrote raises ``LostRows`` and commits nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

TARGET_BYTES, FANOUT = 64 << 20, 4
#: files merged by one job at most; more are merged by further jobs
FILES_PER_JOB = 20_000

MANIFEST = "path string, arrival string, bytes long, rows long, level int"


class ConcurrentCommit(RuntimeError):
    """Another writer committed the same version first; nothing was changed."""


class SchemaMismatch(ValueError):
    """An arrival's columns do not fit the table's; nothing was written."""


class LostRows(RuntimeError):
    """Files hold other rows than were written to them; nothing was committed."""


def merged_schema(old: StructType, new: StructType) -> StructType:
    """The old fields, then the new ones that it lacks, all nullable."""
    by_name = {f.name.lower(): f for f in old}
    for f in new:
        known = by_name.get(f.name.lower())
        if f.name == "__shard" or (known is not None and (known.name != f.name or known.dataType.simpleString() != f.dataType.simpleString())):
            raise SchemaMismatch(f"{f.name} {f.dataType.simpleString()}" + (f", the table has {known.name} {known.dataType.simpleString()}" if known else " is reserved"))
    return StructType([StructField(f.name, f.dataType) for f in [*old, *[f for f in new if f.name.lower() not in by_name]]])


class ShardedTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    # ------------------------------------------------------------ versions

    def version(self) -> int:
        """The newest committed version; 0 for a table without commits."""
        at = self._path(f"{self.root}/manifest")
        if not self._fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return max([int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()], default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        if v == 0:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v{v:08d}/shards")

    def schema(self, version: int | None = None) -> StructType:
        """The table's columns at a version; none at version 0."""
        v = self.version() if version is None else version
        if v == 0:
            return StructType([])
        return StructType.fromJson(json.loads(self.spark.read.text(f"{self.root}/manifest/v{v:08d}/schema").first()[0]))

    def _commit(self, shards: DataFrame, base: int, schema: StructType) -> int:
        """Publish ``shards`` as version ``base + 1``; all or nothing."""
        draft = f"{self.root}/drafts/{uuid.uuid4().hex}"
        shards.select("path", "arrival", "bytes", "rows", "level").coalesce(1).write.parquet(f"{draft}/shards")
        self.spark.createDataFrame([(schema.json(),)], "value string").coalesce(1).write.text(f"{draft}/schema")
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))
        target = self._path(f"{self.root}/manifest/v{base + 1:08d}")
        if self._fs.exists(target):
            raise ConcurrentCommit(str(target))
        try:
            self._context.rename(self._path(draft), target, self._none)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise ConcurrentCommit(str(target)) from e
            raise
        return base + 1

    # ------------------------------------------------------------ writing

    def _described(self, folder: str, level: int, arrival: Column) -> DataFrame:
        """Manifest rows of the files below a folder; file sizes from the listing, row counts from the footers.

        Both name a file in their own form (one escapes it), so they meet on the part below the folder, which holds no special characters.
        """
        below = F.regexp_extract("file", r"((?:/arrival_*=a[0-9A-F]*)?/[^/]*)\z", 1)
        sizes = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder).select(F.col("path").alias("file"), F.col("length").alias("bytes")).select(below.alias("below"), "bytes")
        rows = self.spark.read.option("recursiveFileLookup", "true").schema("__none int").parquet(folder).select(F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.count("*").alias("rows")).select(below.alias("below"), "rows")
        return sizes.join(rows, "below", "left").select(F.concat(F.lit(folder), "below").alias("path"), arrival.alias("arrival"), "bytes", F.coalesce("rows", F.lit(0)).alias("rows"), F.lit(level).alias("level"))

    def _written(self, df: DataFrame, folder: str, level: int, arrival: Column, by: tuple[str, ...] = ()) -> DataFrame:
        """Write ``df`` and describe its files; every row written must be listed."""
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.partitionBy(*by).parquet(folder)
        made = self._kept(self._described(folder, level, arrival))
        listed = made.agg(F.sum("rows")).first()[0] or 0
        if listed != seen.get["rows"]:
            raise LostRows(f"{folder}: {seen.get['rows']} rows written, {listed} listed")
        return made.where("rows > 0")

    def append(self, batch: DataFrame, arrival: str) -> int:
        """Add one arrival as small shards, one or more for each partition of ``batch``; returns the new version.

        A batch without rows commits a version without new shards.
        """
        base = self.version()
        schema = merged_schema(self.schema(base), batch.schema)
        made = self._written(batch, f"{self.root}/data/{uuid.uuid4().hex}", 0, F.lit(arrival or ""))
        return self._commit(self.manifest(base).unionByName(made), base, schema)

    def append_all(self, batches: DataFrame, arrival_col: str) -> list[int]:
        """Add several arrivals, named by a column that does not become one of the table: written in one pass, committed one after the other in
        the order of their names.

        An arrival without rows is no arrival; an empty frame commits a version without new shards.
        """
        base = self.version()
        schema = merged_schema(self.schema(base), batches.drop(arrival_col).schema)
        part = "arrival"
        while part in {c.lower() for c in batches.columns}:
            part += "_"
        # names may hold anything, folders may not
        coded = F.concat(F.lit("a"), F.hex(F.encode(F.coalesce(F.col(arrival_col).cast("string"), F.lit("")), "utf-8")))
        name = F.decode(F.unhex(F.regexp_extract("below", "=a([0-9A-F]*)/", 1)), "utf-8")
        made = self._written(batches.withColumn(part, coded).drop(arrival_col), f"{self.root}/data/{uuid.uuid4().hex}", 0, name, (part,))
        names = sorted(r[0] for r in made.select("arrival").distinct().collect())  # the arrivals of one call
        if not names:
            return [self._commit(self.manifest(base), base, schema)]
        out = []
        for x in names:
            base = self._commit(self.manifest(base).unionByName(made.where(F.col("arrival") == x)), base, schema)
            out.append(base)
        return out

    def _kept(self, described: DataFrame) -> DataFrame:
        path = f"{self.root}/drafts/{uuid.uuid4().hex}"
        described.coalesce(1).write.parquet(path)
        return self.spark.read.schema(MANIFEST).parquet(path)

    def compact(self, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT) -> int:
        """Merge tiers until none holds ``fanout`` shards below half the target; returns the newest version."""
        while True:
            base = self.version()
            live, schema = self.manifest(base), self.schema(base)
            tier = F.floor(F.log2(F.greatest(F.col("bytes"), F.lit(1))) / F.log2(F.lit(float(fanout)))).cast("int")
            small = live.where(F.col("bytes") < target_bytes // 2).withColumn("tier", tier)
            tiers = small.groupBy("tier").agg(F.count("*").alias("files"), F.sum("bytes").alias("total"), F.max("level").alias("level")).where(F.col("files") >= fanout).orderBy("tier").collect()  # a few tiers
            if not tiers:
                return base
            merged, gone = [], []
            for t in tiers:
                picked = small.where(F.col("tier") == t.tier).orderBy("path").limit(FILES_PER_JOB).collect()  # file names only
                paths = [r.path for r in picked]
                folder = f"{self.root}/data/{uuid.uuid4().hex}"
                files = max(1, -(-sum(r.bytes for r in picked) // target_bytes))
                made = self._written(self.spark.read.schema(schema).parquet(*paths).coalesce(files), folder, t.level + 1, F.lit(""))
                if (now := made.agg(F.sum("rows")).first()[0] or 0) != (then := sum(r.rows for r in picked)):
                    raise LostRows(f"{folder}: {then} rows to merge, {now} merged")
                merged.append(made)
                gone += paths
            dead = self.spark.createDataFrame([(p,) for p in gone], "path string")
            rest = live.join(F.broadcast(dead), "path", "left_anti")
            for m in merged:
                rest = rest.unionByName(m)
            self._commit(rest, base, schema)

    def vacuum(self, keep_versions: int = 1) -> int:
        """Delete shards that none of the newest versions lists; returns how many. No reader of an older version may be left."""
        newest = self.version()
        plain = lambda x: self._path(x).toUri().getPath()
        live: set[str] = set()
        for v in range(max(1, newest - keep_versions + 1), newest + 1):
            live |= {plain(r.path) for r in self.manifest(v).select("path").collect()}
        dead = 0
        found = self._fs.listFiles(self._path(f"{self.root}/data"), True)
        while found.hasNext():
            p = found.next().getPath()
            if p.getName().endswith(".parquet") and plain(p.toString()) not in live:
                self._fs.delete(p, False)
                dead += 1
        return dead

    # ------------------------------------------------------------ reading

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of one version, with ``__shard``: the name of the file that holds a row."""
        v = self.version() if version is None else version
        paths = [r.path for r in self.manifest(v).select("path").collect()]  # as a reader of any table lists its files
        if not paths:
            return self.spark.createDataFrame([], self.schema(v)).withColumn("__shard", F.lit(None).cast("string"))
        return self.spark.read.schema(self.schema(v)).parquet(*paths).withColumn("__shard", F.col("_metadata.file_name"))
