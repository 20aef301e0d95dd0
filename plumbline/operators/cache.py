"""The cache of extracted graphs: a log of small committed files, and a base.

A record is a line of JSON: the key, the result as text, and a checksum of both.
Workers that call a backend commit their results themselves, in portions of a
few calls, under ``log/<run>/<task>/``: a portion has its name only when it is
whole. What a task paid for is thus kept, even if the task, its stage or the job
dies right after; the next attempt of the task finds it, and so does any later
run. Workers reach the store by Arrow's file systems, for ``file``, ``hdfs``,
``s3`` and ``gs`` addresses; elsewhere Spark commits the results of each stage.

Reading takes base and log together and has one row a key, whoever wrote it and
how often: the first by finishing time. A line that is damaged, or of a file
that is, is a miss and the lines around it are not. ``damaged`` counts such
lines by file. ``compact`` merges base and log into a new base with one line a
key, removes the merged files, and puts those with damaged lines aside in
``quarantine/``. It only removes what it has read, so runs that write meanwhile
lose nothing; a crash between its steps leaves lines twice, which reading
settles. The base before the newest stays until the next compaction, for those
who are still reading it.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.store import Store, arrow_path

LINE = "cache_key string, body string, crc bigint, damaged string"


def line(key: str, body: str) -> str:
    return json.dumps({"cache_key": key, "body": body, "crc": zlib.crc32(f"{key}\n{body}".encode())})


def lines(rows: DataFrame) -> DataFrame:
    """Rows of a cache table as lines."""
    body = F.to_json(F.struct(*(c for c in rows.columns if c != "cache_key")), {"ignoreNullFields": "false"})
    made = rows.select("cache_key", body.alias("body"))
    return made.select(F.to_json(F.struct("cache_key", "body", _crc().alias("crc"))).alias("value"))


def _crc() -> Column:
    return F.crc32(F.concat_ws("\n", "cache_key", "body"))


class Portions:
    """Where one task of one run commits its results, in files of a few lines.

    Made on the worker. ``done`` has the lines that earlier attempts committed.
    """

    def __init__(self, path: str, run: str, task: int):
        from pyarrow import fs

        self._fs, root = arrow_path(path)
        self.run, self._folder = run, f"{root}/log/{run}/{task}"
        self._types = fs.FileType, fs.FileSelector

    def done(self) -> Iterator[dict]:
        kind, selector = self._types
        for file in self._fs.get_file_info(selector(self._folder, allow_not_found=True)):
            if file.type == kind.File and file.base_name.endswith(".jsonl"):
                with self._fs.open_input_stream(file.path) as f:
                    text = f.read().decode("utf-8", "replace")
                for x in text.splitlines():
                    try:
                        got = json.loads(x)
                        if got["crc"] == zlib.crc32(f"{got['cache_key']}\n{got['body']}".encode()):
                            yield {"cache_key": got["cache_key"], **json.loads(got["body"])}
                    except (ValueError, KeyError, TypeError):  # a damaged line is a miss
                        continue

    def commit(self, portion: list[str]) -> None:
        name = uuid.uuid4().hex
        self._fs.create_dir(self._folder, recursive=True)
        new = f"{self._folder}/_{name}"  # Spark does not read names like this
        with self._fs.open_output_stream(new) as f:
            f.write(("\n".join(portion) + "\n").encode())
        self._fs.move(new, f"{self._folder}/{name}.jsonl")


class GraphCache:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        """``schema`` is that of the table, with ``cache_key``, ``error``, ``finished`` (seconds since 1970) and ``run``."""
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._body = ", ".join(f for f in _fields(schema) if not f.startswith("cache_key "))

    @property
    def store(self) -> Store:
        return Store(self.spark, self.path)

    def _bases(self) -> list[int]:
        store = self.store
        return sorted(int(n) for n in store.names("base") if n.isdigit() and store.exists(f"base/{n}/_SUCCESS"))

    def _raw(self) -> DataFrame:
        """All lines, with their file."""
        store, spark = self.store, self.spark
        bases = self._bases()
        places = [f"{self.path}/base/{bases[-1]}"] if bases else []
        places += [f"{self.path}/log"] if store.exists("log") else []
        if not places:
            return spark.createDataFrame([], f"{LINE}, file string")
        # Files may be merged and removed while they are read: their lines are in the next base.
        reader = spark.read.schema(LINE).option("columnNameOfCorruptRecord", "damaged").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
        return reader.json(places).select("*", F.col("_metadata.file_path").alias("file"))

    def _sound(self) -> Column:
        return F.coalesce(F.col("damaged").isNull() & (F.col("crc") == _crc()), F.lit(False))

    def read(self, run: str | None = None) -> DataFrame:
        """The table, one row a key: results without an error, and what failed in ``run``."""
        rows = self._raw().filter(self._sound()).select("cache_key", F.from_json("body", self._body).alias("x"))
        rows = rows.filter(F.col("x.error").isNull() | F.col("x.run").eqNullSafe(F.lit(run)))
        first = rows.groupBy("cache_key").agg(F.min_by("x", F.struct(F.col("x.error").isNotNull(), F.col("x.finished"), F.to_json("x"))).alias("x"))
        return first.select("cache_key", "x.*")

    def damaged(self) -> DataFrame:
        """(file, n_damaged): files with lines that cannot be trusted."""
        return self._raw().filter(~self._sound()).groupBy("file").agg(F.count("*").alias("n_damaged"))

    def append(self, rows: DataFrame, run: str) -> None:
        """Results of a stage, committed by Spark as it ends."""
        lines(rows.withColumn("run", F.lit(run))).write.text(f"{self.path}/log/{run}/stage-{uuid.uuid4().hex}")

    def portions(self, run: str) -> Callable[[int], Portions] | None:
        """How the workers of a run commit, or None where they can't reach the store."""
        path = self.path
        return None if arrow_path(path) is None else lambda task: Portions(path, run, task)

    def compact(self) -> int:
        """Merge base and log into a new base; its number."""
        store = self.store
        bases = self._bases()
        merged = [f"log/{f}" for f in store.files("log") if not f.rpartition("/")[2].startswith(("_", "."))]
        bad = {_plain(unquote(r.file)).removeprefix(_plain(store.base) + "/") for r in self.damaged().collect()}  # a row a damaged file
        number = bases[-1] + 1 if bases else 0
        lines(self.read()).write.text(f"{self.path}/base/{number}")
        for name in merged:
            if name in bad:
                store.move(name, f"quarantine/{number}/{name.replace('/', '-')}")
            else:
                store.delete(name)
        for old in bases[:-1]:
            store.delete(f"base/{old}")
        for name in sorted(b for b in bad if b.startswith("base/")):
            store.move(name, f"quarantine/{number}/{name.replace('/', '-')}")
        return number


def _plain(address: str) -> str:
    """An address without its scheme, which is written in several ways."""
    return re.sub(r"^[a-z0-9]+:/+", "/", address)


def _fields(schema: str) -> list[str]:
    """Fields of a schema, which are parted by commas outside of angle brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i].strip())
            start = i + 1
    return [*out, schema[start:].strip()]
