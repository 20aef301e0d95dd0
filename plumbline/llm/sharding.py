"""Sharding by size-tiered compaction, with a versioned manifest.

A store is a folder. ``append`` writes arrivals as small immutable shards, as
the tasks hand them over. ``compact`` puts live shards of similar size (a tier
is a range of sizes) into runs of up to the target size, in the order in which
they arrived, and writes each run as one new file; shards that have reached the
target stay. ``compact(ordered=True)`` keeps the rows in the order of the
arrivals' tasks: only neighbours meet in a run, whatever their tiers, and all
shards are written anew, numbered in that order, unless there is nothing to
merge. So after one append of sorted rows, paths and places are that order.

Each change ends by committing a manifest, the list of live shards. Its record
is written aside in full and then renamed to the number of the new version,
which fails if another writer has taken that number: a version is there as a
whole or not at all. A writer that comes second starts again from the newest
version: an append adds its shards to that one, and so does a merge if all that
it merged is still live; otherwise it drops its work. Readers follow the newest
version; shards of older ones stay until ``vacuum``, which spares folders that
a writer has announced and not committed yet.

Manifests are Parquet tables made from the shards' own footers by Spark, of any
size; running sums over them are made in two levels, by blocks of arrivals. The
driver reads commit files, one for each version, and names of folders, one for
each change.

The rename is exclusive where the store's is (HDFS); on a local disk, two
writers within the same instant could both succeed, and so they could on an
object store, where a rename is a copy: there, changes need one writer at a time.

A version's schema has the columns of all arrivals so far, those of the first
one first, told by name without regard to case. A column that an arrival lacks
is null in its rows, and stays so through merges. A column may come with a
wider or narrower type of the same kind of number (``WIDER``): the version has
the wider one, and values are exact. Any other change of type is refused before
anything is written.

Nulls and odd input: rows are stored as they are, with all columns, repeated
ones as often as they come. An empty table adds no shard, but its columns.
Columns may have any names. A row larger than the target makes a shard of its
own size.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.llm.common import fresh

#: Size of a full shard, as stored.
TARGET_BYTES = 64 << 20
#: Rows of an arrival that go to one small shard.
ARRIVAL_ROWS = 4096
#: A tier's sizes differ by less than this factor.
TIER_FACTOR = 4
#: Shards of one tier from which a run is merged.
MIN_RUN = 2

#: Tasks of an arrival whose shards are summed together.
BLOCK_TASKS = 256
#: Runs are numbered from here, so that their paths sort as their numbers.
FIRST_RUN = 10_000_000

#: Types by what holds all their values and is read from their files as well.
WIDER: dict[str, tuple[str, ...]] = {
    "tinyint": ("smallint", "int", "bigint", "double"),
    "smallint": ("int", "bigint", "double"),
    "int": ("bigint", "double"),
    "float": ("double",),
}

MANIFEST = "path string, rows long, bytes long, tier int"


def _shape(kind: T.DataType) -> T.DataType:
    """A type with everything in it nullable, as it is read from files."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _shape(f.dataType), True) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_shape(kind.elementType), True)
    return T.MapType(_shape(kind.keyType), _shape(kind.valueType), True) if isinstance(kind, T.MapType) else kind


def merged_schema(old: T.StructType, new: T.StructType) -> T.StructType:
    """Columns of both; a ``TypeError`` where a column has types that don't go together."""
    fields = {f.name.lower(): T.StructField(f.name, _shape(f.dataType), True) for f in old.fields}
    for f in new.fields:
        here, kind = fields.get(f.name.lower()), _shape(f.dataType)
        if here is None:
            fields[f.name.lower()] = T.StructField(f.name, kind, True)
        elif here.dataType != kind:
            a, b = here.dataType.simpleString(), kind.simpleString()
            if b not in WIDER.get(a, ()) and a not in WIDER.get(b, ()):
                raise TypeError(f"column {f.name}: the store has {a}, the arrivals {b}")
            fields[f.name.lower()] = T.StructField(here.name, kind if b in WIDER.get(a, ()) else here.dataType, True)
    return T.StructType(list(fields.values()))


class ShardStore:
    """Shards and manifests under ``path``."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES):
        self.spark, self.path, self.target_bytes = spark, path.rstrip("/"), target_bytes

    # -- manifest -------------------------------------------------------------
    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        fs, at = self._at(f"{self.path}/commits")
        if not fs.exists(at):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit())

    def _newest(self) -> int:
        return max(self.versions(), default=0)

    def _commit_record(self, version: int) -> dict:
        fs, at = self._at(f"{self.path}/commits/{version}")
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> DataFrame:
        """Live shards of a version, by default the newest."""
        versions = self.versions()
        if not versions:
            return self.spark.createDataFrame([], MANIFEST)
        record = self._commit_record(versions[-1] if version is None else version)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{record['manifest']}")

    def _commit(self, base: int, live: DataFrame, schema: T.StructType) -> bool:
        """Make ``live`` version ``base + 1``, unless another writer has made one."""
        name = uuid.uuid4().hex
        live.select("path", "rows", "bytes", "tier").write.parquet(f"{self.path}/manifests/{name}")
        fs, aside = self._at(f"{self.path}/commits/_{name}")
        stream = fs.create(aside, False)
        stream.write(bytearray(json.dumps({"manifest": name, "schema": schema.jsonValue()}).encode()))
        stream.close()
        _, at = self._at(f"{self.path}/commits/{base + 1}")
        jvm = self.spark._jvm
        never_over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, at, never_over)
        except Py4JJavaError:
            fs.delete(aside, False)
            if fs.exists(at):
                return False
            raise
        return True

    def _announce(self, folder: str) -> str:
        """Note that a folder of shards is being written, for ``vacuum``."""
        fs, at = self._at(f"{self.path}/intents/{folder.rpartition('/')[2]}")
        fs.create(at, True).close()
        return folder

    def _settled(self, folder: str) -> None:
        fs, at = self._at(f"{self.path}/intents/{folder.rpartition('/')[2]}")
        fs.delete(at, False)

    def _listed(self, folder: str, schema: T.StructType) -> DataFrame:
        """Shards in a folder with their rows and bytes, from the files' footers."""
        files = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
        meta = files.metadataColumn("_metadata")
        found = files.select(meta["file_path"].alias("path"), meta["file_size"].alias("bytes")).groupBy("path", "bytes").agg(F.count("*").alias("rows"))
        return found.select("path", "rows", "bytes", self._tier(F.col("bytes")).alias("tier"))

    def _tier(self, size):
        steps = F.floor(F.log(float(TIER_FACTOR), F.greatest(size, F.lit(1)).cast("double"))).cast("int")
        return F.when(size >= self.target_bytes // 2, F.lit(-1)).otherwise(steps)

    # -- changes --------------------------------------------------------------
    def append(self, arrivals: DataFrame, rows: int = ARRIVAL_ROWS) -> int:
        """Add arrivals as shards of at most ``rows`` rows; returns the new version."""
        base = self._newest()
        merged_schema(self.schema(base), arrivals.schema)
        folder = self._announce(f"{self.path}/shards/a{base + 1:08d}-{uuid.uuid4().hex}")
        arrivals.write.option("maxRecordsPerFile", rows).option("compression", "zstd").parquet(folder)
        new = self._listed(folder, arrivals.schema)
        # Another writer may have brought columns meanwhile: those of the version this one follows count.
        while not self._commit(base, self.manifest(base).unionByName(new) if base else new, merged_schema(self.schema(base), arrivals.schema)):
            base = self._newest()
        self._settled(folder)
        return base + 1

    def compact(self, ordered: bool = False) -> int:
        """Merge runs of similar shards until no tier has one; returns the newest
        version. ``ordered`` merges runs of neighbours instead."""
        while base := self._newest():
            live = self.manifest(base)
            plan = (self._neighbours(live) if ordered else self._tiers(live)).persist()
            try:
                n_runs = plan.agg(F.max("run")).first()[0]
                if n_runs is None:
                    break
                self._merge(base, plan, n_runs + 1)
            finally:
                plan.unpersist()
        return base

    def _numbered(self, live: DataFrame) -> DataFrame:
        """Shards with the order of their arrival: version, task or run, and file of the task."""
        parts = {"arrival": r"/shards/[ac](\d+)-", "run": r"=(\d+)/[^/]*$", "task": r"/part-(\d+)-", "file": r"[.-]c(\d+)\.[^/-]*$"}
        n = {k: F.when(x != "", x.cast("long")) for k, x in ((k, F.regexp_extract("path", p, 1)) for k, p in parts.items())}
        return live.select("path", "bytes", "tier", n["arrival"].alias("n0"), F.coalesce(n["run"], n["task"]).alias("n1"), F.coalesce(n["file"], F.lit(0)).alias("n2"))

    @staticmethod
    def _before(shards: DataFrame, value: Column, name: str, by: tuple[str, ...] = ()) -> DataFrame:
        """``shards`` with the sum of ``value`` over those before each, in two
        levels: within blocks of tasks, and over the blocks."""
        block = F.expr(f"n1 div {BLOCK_TASKS}")
        keyed = shards.withColumns({"value": value, "block": block})
        sums = keyed.groupBy(*by, "n0", "block").agg(F.sum("value").alias("total"))
        sums = sums.select(*by, "n0", "block", (F.sum("total").over(Window.partitionBy(*by).orderBy("n0", "block")) - F.col("total")).alias("offset"))
        within = F.sum("value").over(Window.partitionBy(*by, "n0", "block").orderBy("n1", "n2", "path")) - F.col("value")
        return keyed.withColumn("within", within).join(sums, [*by, "n0", "block"]).withColumn(name, F.col("offset") + F.col("within")).drop("value", "block", "within", "offset")

    def _plan(self, runs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        """Shards with their runs numbered from 0, in the order of each run's first shard."""
        firsts = runs.groupBy(*keys).agg(F.min(F.struct("n0", "n1", "n2", "path")).alias("first")).select(*keys, "first.*")
        numbers = self._before(firsts, F.lit(1), "run").select(*keys, F.col("run").cast("int").alias("run"))
        return runs.join(numbers, list(keys)).select("path", "run", "n0", "n1", "n2")

    def _tiers(self, live: DataFrame) -> DataFrame:
        """Shards to merge: in each tier, shards in the order of arrival fill runs up to the target."""
        small = self._before(self._numbered(live.filter("tier >= 0")), F.col("bytes"), "filled", ("tier",))
        runs = small.withColumn("part", F.floor(F.col("filled") / self.target_bytes))
        many = runs.groupBy("tier", "part").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_RUN).select("tier", "part")
        return self._plan(runs.join(many, ["tier", "part"]), ("tier", "part"))

    def _neighbours(self, live: DataFrame) -> DataFrame:
        """All shards, where small neighbours fill runs up to the target and full
        ones stand alone; none if no two would meet."""
        full = F.col("tier") < 0
        shards = self._before(self._numbered(live), full.cast("long"), "stretch")
        shards = self._before(shards, F.when(full, 0).otherwise(F.col("bytes")), "filled")
        starts = shards.groupBy("stretch").agg(F.min("filled").alias("start"))
        shards = shards.join(starts, "stretch").withColumn("part", F.when(full, -1).otherwise(F.floor((F.col("filled") - F.col("start")) / self.target_bytes)))
        merges = shards.groupBy("stretch", "part").agg(F.count("*").alias("n")).agg(F.max("n").alias("most")).filter(F.col("most") >= MIN_RUN)
        return self._plan(shards, ("stretch", "part")).join(F.broadcast(merges)).drop("most")

    def _merge(self, base: int, plan: DataFrame, n_runs: int) -> None:
        """Write the planned runs and commit them in place of their shards; no
        change if another writer has merged some of these meanwhile."""
        schema = self.schema(base)
        run, n0, n1, n2, path, row = fresh(self.read(base), "run", "n0", "n1", "n2", "path", "row")
        files = self._files(schema, base)
        meta = files.metadataColumn("_metadata")
        source = files.select("*", meta["file_path"].alias(path), meta["row_index"].alias(row))
        planned = plan.select(F.col("path").alias("planned_path"), (F.col("run") + FIRST_RUN).cast("int").alias(run), *(F.col(a).alias(b) for a, b in zip(("n0", "n1", "n2"), (n0, n1, n2))))
        merged = source.join(planned, F.col(path) == F.col("planned_path")).drop("planned_path")
        folder = self._announce(f"{self.path}/shards/c{base + 1:08d}-{uuid.uuid4().hex}")
        # Each run is a partition, and so a task and a file. The run comes first, or the writer sorts again.
        order = (n0, n1, n2, path, row)
        dealt = merged.repartitionById(n_runs, F.col(run) - FIRST_RUN).sortWithinPartitions(run, *order).drop(*order)
        dealt.write.partitionBy(run).option("compression", "zstd").parquet(folder)
        new = self._listed(folder, schema)
        while True:
            live = self.manifest(base)
            if self._commit(base, live.join(plan.select("path"), "path", "left_anti").unionByName(new), self.schema(base)):
                break
            base = self._newest()
            if not plan.select("path").join(self.manifest(base), "path", "left_anti").isEmpty():
                break
        self._settled(folder)

    # -- reading --------------------------------------------------------------
    def schema(self, version: int | None = None) -> T.StructType:
        """Columns of a version; none before the first."""
        versions = self.versions()
        if not versions or version == 0:
            return T.StructType()
        return T.StructType.fromJson(self._commit_record(versions[-1] if version is None else version)["schema"])

    def _folders(self, version: int | None = None) -> list[str]:
        """Folders with live shards: at most one for each append or merge."""
        folder = F.regexp_extract("path", r"^(.*/shards/[^/]+)/", 1)
        return sorted(r[0] for r in self.manifest(version).select(folder.alias("f")).distinct().collect())

    def _files(self, schema: T.StructType, version: int | None = None) -> DataFrame:
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*self._folders(version))

    def read(self, version: int | None = None, places: bool = False) -> DataFrame:
        """Rows of a version; ``places`` adds the columns shard and place: the
        shard's path within the store, and the row's number in it."""
        schema = self.schema(version)
        if not self._folders(version):
            empty = self.spark.createDataFrame([], schema)
            shard, place = fresh(empty, "shard", "place")
            return empty.withColumns({shard: F.lit(""), place: F.lit(0).cast("long")}) if places else empty
        files = self._files(schema, version)
        live, shard, place = fresh(files, "live_path", "shard", "place")
        meta = files.metadataColumn("_metadata")
        df = files.select("*", meta["file_path"].alias(shard), meta["row_index"].alias(place))
        df = df.join(self.manifest(version).select(F.col("path").alias(live)), F.col(shard) == F.col(live), "left_semi")
        return df.withColumn(shard, F.regexp_extract(shard, r"/shards/(.*)$", 1)) if places else df.select(*schema.names)

    def vacuum(self, abandoned_after: float = 7 * 86400.0) -> None:
        """Delete folders that the newest version has no shard of, but for those
        that a writer announced in the last ``abandoned_after`` seconds and has
        not committed."""

        def listed(name: str) -> dict:
            fs, at = self._at(f"{self.path}/{name}")
            return {s.getPath().getName(): s for s in fs.listStatus(at)} if fs.exists(at) else {}

        # In this order: what is neither announced nor live now was not about to be.
        folders, intents = listed("shards"), listed("intents")
        live = {f.rpartition("/")[2] for f in self._folders()}
        young = (time.time() - abandoned_after) * 1000
        for name, status in folders.items():
            if name not in live and not (name in intents and intents[name].getModificationTime() > young):
                status.getPath().getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(status.getPath(), True)
                self._settled(name)
