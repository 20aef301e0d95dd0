"""Token output in training order: fixed-stride shards behind a keyed permutation.

Documents are tokenized, each followed by an end token, and the stream of each
input partition is cut into sequences of ``length`` ids, two bytes each, or
four where the vocabulary needs them, little-endian. Every sequence has an
index, counted through the partitions. A keyed Feistel network with
cycle-walking maps the index to a global slot: a permutation of 0 .. n-1 that
any task can compute, and invert, by itself.

A shard is one plain file of a fixed number of consecutive slots, in order, with
a newline after each: so slot s is at byte (s mod k) * stride of shard s div k,
and a reader of any kind can seek to it, map the file, or go on anywhere. What
a slot's index is follows from the permutation; whose documents are in it is
kept beside the shards, by index.

The cut sequences are written first, so the text is tokenized once, and the
numbers rest on a table that no retry can change. The driver gets a count for
each partition. Then each sequence moves once, to its shard, in a few waves of
shards. A wave leaves a mark when it is whole; writing to the same path again
goes on with what has no mark, the cut sequences first. It does so only for the
same work: a fingerprint of all parameters and the vocabulary is written before
anything else, one of the documents (their number and two sums of hashes of id
and text, whatever their order) with the cut sequences, and others are refused.

Ids are those of a public tokenizer's ranks file; texts that spell special
tokens are ordinary text. Words are encoded once per worker and kept, up to a
bound: runs of letters and the like never span a single space.

Nulls and odd input: a null or empty text is an end token alone. Null ids
stand as null in a sequence's documents. Repeated rows are written as often as
they come. An empty table gives no sequences. Extra columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import json
import sys
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import kernel as K

LENGTH = 1024
#: Of 2 kB each; a reader of slots holds a shard as a whole.
ROWS_PER_SHARD = 8192
KEY = 20240229
#: Parts in which shards are written; the files behind an exchange are dropped after each.
WAVES = 4
ROUNDS = 6
#: Words whose ids a Python worker keeps, at some 300 bytes each.
CACHE_WORDS = 250_000
#: Files of byte-level vocabularies split text by this pattern (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_U = np.uint64


def load_encoding(lines: bytes) -> tiktoken.Encoding:
    """A tokenizer from the contents of a file of base64 tokens and ranks."""
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Words(dict):
    """Bytes of the ids of a space and a word, encoded when first asked for."""

    def __init__(self, encoding: tiktoken.Encoding, width: int = 2):
        super().__init__()
        self.encoding, self.kind = encoding, {2: "H", 4: "I"}[width]

    def encode(self, text: str) -> bytes:
        ids = array(self.kind, self.encoding.encode_ordinary(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def __missing__(self, word: str) -> bytes:
        out = self.encode(" " + word)
        if len(self) < CACHE_WORDS:  # frequent words come early
            self[word] = out
        return out

    def text(self, text: str) -> bytes:
        if "  " in text:  # runs of spaces are split otherwise
            return self.encode(text)
        head, *rest = text.split(" ")
        return self.encode(head) + b"".join(map(self.__getitem__, rest))


@lru_cache(maxsize=1)
def words_of(lines: bytes, width: int) -> Words:
    """One cache for all tasks that a Python worker runs."""
    return Words(load_encoding(lines), width)


def id_width(lines: bytes, end_token: int) -> int:
    """Bytes that hold each id of a ranks file and the end token."""
    return 2 if max(end_token, *(int(x.split()[1]) for x in lines.splitlines())) < 1 << 16 else 4


def feistel(index: np.ndarray, n: int, key: int, backwards: bool = False) -> np.ndarray:
    """The slot of each index below ``n`` (or the index of each slot).

    The network permutes an even number of bits, the fewest that hold n;
    values of n and above walk on along their cycle.
    """
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    mask = _U((1 << half) - 1)
    keys = [K.mix(np.array([(key + 1) * 0x9E3779B97F4A7C15 + r & 0xFFFFFFFFFFFFFFFF], dtype=_U))[0] for r in range(ROUNDS)]
    out = np.asarray(index, dtype=_U).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> _U(half), out[todo] & mask
        if backwards:
            for k in reversed(keys):
                left, right = right ^ (K.mix(left ^ k) & mask), left
        else:
            for k in keys:
                left, right = right, left ^ (K.mix(right ^ k) & mask)
        out[todo] = (left << _U(half)) | right
        todo = todo[out[todo] >= _U(n)]
    return out.astype(np.int64)


def _cut(docs: DataFrame, ranks: Broadcast, length: int, end_token: int, width: int) -> DataFrame:
    """Sequences of each partition (part, number), in the order of its rows; the
    last of a partition is filled up with end tokens, which n_tokens does not count."""
    end = end_token.to_bytes(width, "little")
    size = width * length
    id_type = docs.schema["id"].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        words = words_of(ranks.value, width)
        rest, owners, made, kind = b"", [], 0, pa.null()
        pending: list[tuple[bytes, int, list]] = []

        def flush() -> pa.RecordBatch:
            nonlocal pending
            n = len(pending)
            ends = np.concatenate(([0], np.cumsum([len(ids) for _, _, ids in pending]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array([x for _, _, own in pending for x in own], kind))
            columns = [pa.array(np.full(n, part)), pa.array(made - n + np.arange(n)), pa.array([t for t, _, _ in pending], pa.binary()), pa.array([k for _, k, _ in pending], pa.int64()), ids]
            pending = []
            return pa.RecordBatch.from_arrays(columns, ["part", "number", "tokens", "n_tokens", "ids"])

        for batch in batches:
            kind = batch.schema.field(0).type
            own_ids = batch.column(0).to_pylist()
            for own, text in zip(own_ids, batch.column(1)):
                ids = rest + words.text(text.as_py() or "") + end
                owners.append(own)
                at = 0
                while len(ids) - at >= size:
                    pending.append((ids[at : at + size], length, owners))
                    at += size
                    owners = owners[-1:] if at < len(ids) else []
                    made += 1
                    if len(pending) >= 1024:
                        yield flush()
                rest = ids[at:]
        if rest:
            pending.append((rest + end * ((size - len(rest)) // width), len(rest) // width, owners))
            made += 1
        if pending:
            yield flush()

    fields = [("part", T.LongType()), ("number", T.LongType()), ("tokens", T.BinaryType()), ("n_tokens", T.LongType()), ("ids", T.ArrayType(id_type))]
    return docs.mapInArrow(cut, T.StructType([T.StructField(*f) for f in fields]))


@dataclass(frozen=True)
class Shards:
    """Written shards: where they are, and what is in them."""

    spark: SparkSession
    path: str
    total: int
    length: int
    width: int
    rows_per_shard: int
    key: int

    @property
    def stride(self) -> int:
        return self.width * self.length + 1

    def owners(self) -> DataFrame:
        """(slot, index, n_tokens, ids): of each sequence, its index, the tokens without filling, and the documents in it."""
        rows = _indexed(self.spark, self.path)[0]
        return rows.select(_slot_of(self.total, self.key)(F.col("index")).alias("slot"), "index", "n_tokens", "ids")

    def slots(self, start: int = 0, stop: int | None = None) -> DataFrame:
        """(slot, shard, place, tokens) of slots start .. stop - 1, cut from
        their shards' files only. ``place`` is the row's in its file.

        Built-in functions cut a file where it is read; Python functions over
        this frame should follow a write or an exchange, or each row takes its
        file along.
        """
        stop = self.total if stop is None else min(stop, self.total)
        if start >= stop:
            return self.spark.createDataFrame([], "slot long, shard long, place long, tokens binary")
        files = self.spark.read.format("binaryFile").load(f"{self.path}/shards")
        files = files.filter(F.col("shard").between(start // self.rows_per_shard, (stop - 1) // self.rows_per_shard))
        each = files.select(F.col("shard").cast("long").alias("shard"), "content", F.explode(F.expr(f"sequence(0L, length div {self.stride} - 1)")).alias("place"))
        slot = F.col("shard") * self.rows_per_shard + F.col("place")
        tokens = F.substring(F.col("content"), (F.col("place") * self.stride + 1).cast("int"), F.lit(self.stride - 1))
        return each.filter(slot.between(start, stop - 1)).select(slot.alias("slot"), "shard", "place", tokens.alias("tokens"))


def _slot_of(total: int, key: int) -> Callable[[Column], Column]:
    @F.pandas_udf("long")
    def slot_of(index: pd.Series) -> pd.Series:
        return pd.Series(feistel(index.to_numpy(), total, key))

    return slot_of


def _whole(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` has left its mark."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _indexed(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The cut sequences with their index, and how many there are."""
    cut = spark.read.parquet(f"{path}/sequences")
    counts = {r["part"]: r["n"] for r in cut.groupBy("part").agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for part in sorted(counts):
        starts.append((part, total))
        total += counts[part]
    # A row for each partition of the input, 16 bytes.
    offsets = F.broadcast(spark.createDataFrame(starts, "part long, first long"))
    return cut.join(offsets, "part").withColumn("index", F.col("first") + F.col("number")), total


def _content(id_col: str, text_col: str) -> list[Column]:
    """What tells a table of documents from another, whatever their order."""
    hashed = F.xxhash64(F.col(id_col), F.col(text_col))
    return [F.count("*").cast("string").alias("documents"), F.sum(hashed.cast("decimal(38,0)")).cast("string").alias("sum"), F.bit_xor(hashed).cast("string").alias("parity")]


def _claim(spark: SparkSession, at: str, work: dict) -> None:
    """Leave the fingerprint of some work at a path, or check that it is there."""
    if not _whole(spark, at):
        spark.createDataFrame([(json.dumps(work, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(at)
        return
    found = json.loads(spark.read.text(at).first()[0])
    other = sorted(k for k in work.keys() | found.keys() if work.get(k) != found.get(k))
    if other:
        raise ValueError(f"{at} is of other work: {', '.join(f'{k} is {found.get(k)!r} and not {work.get(k)!r}' for k in other)}")


def write_shards(docs: DataFrame, path: str, ranks_file: str, length: int = LENGTH, rows_per_shard: int = ROWS_PER_SHARD, key: int = KEY, end_token: int = 50256, id_col: str = "doc_id", text_col: str = "text", waves: int = WAVES) -> Shards:
    """Write all sequences of ``docs`` under ``path``, or go on with it; a ``ValueError`` if it holds those of other work.

    ``shards/wave=W/shard=K`` has the one file of shard K, ``sequences`` the cut
    sequences by index. A shard is a range of slots and a partition of its own:
    the exchange is addressed by its number, which needs no sampling.
    """
    spark = docs.sparkSession
    with open(ranks_file, "rb") as f:  # a vocabulary has a fixed size, about a megabyte
        lines = f.read()
    width = id_width(lines, end_token)
    types = f"{docs.schema[id_col].dataType.simpleString()}, {docs.schema[text_col].dataType.simpleString()}"
    work = {"length": length, "width": width, "key": key, "rows_per_shard": rows_per_shard, "end_token": end_token, "waves": waves, "types": types, "vocabulary": hashlib.sha256(lines).hexdigest()}
    if not _whole(spark, f"{path}/fingerprint") and any(_whole(spark, f"{path}/{x}") for x in ("sequences", "shards/wave=0")):
        raise ValueError(f"{path} holds shards of unknown origin")
    _claim(spark, f"{path}/fingerprint", work)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if not (_whole(spark, f"{path}/sequences") and _whole(spark, f"{path}/content")):
        # What the documents are is summed up as they are cut; it stands before any shard does.
        seen = Observation()
        cut = _cut(narrow.observe(seen, *_content("id", "text")), spark.sparkContext.broadcast(lines), length, end_token, width)
        cut.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/sequences")
        spark.createDataFrame([(json.dumps(seen.get, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/content")
    else:
        _claim(spark, f"{path}/content", narrow.agg(*_content("id", "text")).first().asDict())
    rows, total = _indexed(spark, path)
    out = Shards(spark, path, total, length, width, rows_per_shard, key)
    shards = -(-total // rows_per_shard)
    placed = rows.withColumn("slot", _slot_of(total, key)(F.col("index"))).withColumn("shard", F.expr(f"slot div {rows_per_shard}"))
    for wave in range(min(waves, shards)):
        first, last = (shards * w // min(waves, shards) for w in (wave, wave + 1))
        target = f"{path}/shards/wave={wave}"
        if _whole(spark, target):
            continue
        own = placed.filter(F.col("shard").between(first, last - 1)).select("slot", "shard", "tokens")
        # The shard comes first, or the writer sorts again. As text, bytes are written as they are, with a newline.
        dealt = own.repartitionById(last - first, (F.col("shard") - first).cast("int")).sortWithinPartitions("shard", "slot")
        dealt.select("shard", F.col("tokens").cast("string").alias("value")).write.mode("overwrite").partitionBy("shard").text(target)
        # Spark drops the exchange's files when the driver collects the plan as garbage.
        spark.sparkContext._jvm.System.gc()
    return out


def map_shard(file: str, length: int = LENGTH, width: int = 2) -> np.ndarray:
    """A read-only map of one shard's file: ids by slot and position."""
    row = np.dtype([("ids", f"<u{width}", (length,)), ("end", "u1")])
    return np.memmap(file, dtype=row, mode="r")["ids"]
