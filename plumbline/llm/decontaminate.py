"""Benchmark decontamination: remove training text that holds test passages.

The benchmark's items are cut into n-grams of normalised words, whose hashes
form a set that is broadcast. Tasks scan all n-gram windows of the documents
against it, with array operations on the bytes, and confirm each hit on the
words themselves.

What is broadcast has a measured size. Items of up to ``block_bytes`` of text in
all are the set itself. A larger benchmark stays a table: its n-grams are made in
tasks, item by item and long items piece by piece, and what is broadcast is one
bit for each upper part of a hash, ``FILTER_BITS`` of them at most. One scan of
the documents lets the windows pass whose bit is set; those meet the n-grams in
an equi-join on hash and words, which confirms them, and are united by text. So
the documents are read twice, however large the benchmark is.

Nulls and odd input: a null text has no words and is clean. An item without
words has no windows; an item shorter than n is one window. Null item ids are
skipped. Items may repeat; an id counts once. Rows may repeat: each document
row gets a row. Empty tables are fine on either side. Extra columns of
``docs`` pass through ``remove_documents``, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import kernel as K
from plumbline.llm.common import fresh, text_key, written

#: Bytes of item texts whose set is broadcast.
BLOCK_BYTES = 16 << 20
#: Bits of a broadcast filter at most: 128 MB.
FILTER_BITS = 1 << 30
#: Bytes of a long item that are cut into n-grams at once.
PIECE_BYTES = 1 << 20


class Windows:
    """The n-grams of some benchmark items, sorted by hash."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        at: dict[tuple[int, bytes], set[str]] = defaultdict(set)
        for item, text in items:
            data = K.lower_ascii(np.frombuffer((text or "").encode(), dtype=np.uint8))
            starts, ends, _ = K.words(data, np.array([0, len(data)]), K.ALNUM)
            own = [data[s:e].tobytes() for s, e in zip(starts, ends)]
            size = min(n, len(own))
            for i in range(len(own) - size + 1 if size else 0):
                at[size, b" ".join(own[i : i + size])].add(item)
        self.by_size: dict[int, tuple[np.ndarray, list[bytes], list[list[str]], np.ndarray]] = {}
        for size in {s for s, _ in at}:
            keys = [k for s, k in at if s == size]
            hashes = np.array([self._hash(k, size) for k in keys], dtype=np.uint64)
            order = np.argsort(hashes, kind="stable")
            maybe = np.zeros(1 << 20, dtype=bool)  # cheap first test by the upper bits
            maybe[(hashes >> np.uint64(44)).astype(np.int64)] = True
            self.by_size[size] = hashes[order], [keys[i] for i in order], [sorted(at[size, keys[i]]) for i in order], maybe

    @staticmethod
    def _hash(key: bytes, size: int) -> np.uint64:
        data = np.frombuffer(key, dtype=np.uint8)
        starts, ends, _ = K.words(data, np.array([0, len(data)]), K.ALNUM)
        return K.window_hash(K.word_hash(data, starts, ends), size)[0]

    def scan(self, column: pa.Array) -> tuple[list[int], list[list[int]], list[list[int]], list[list[str]]]:
        """Words, maximal hit runs as word ranges, and items, of each text."""
        n_words, froms, tos, items = [], [], [], []
        for part in K.slices(column):
            data = K.lower_ascii(part.data)
            starts, ends, first = K.words(data, part.offsets, K.ALNUM)
            texts = len(part.offsets) - 1
            found: list[set[str]] = [set() for _ in range(texts)]
            edge = np.zeros(len(starts) + 1, dtype=np.int64)
            hashes = K.word_hash(data, starts, ends)
            for size, (known, keys, owners, maybe) in self.by_size.items():
                windows = K.window_hash(hashes, size)
                at = np.flatnonzero(maybe[(windows >> np.uint64(44)).astype(np.int64)]) if len(windows) else np.zeros(0, np.int64)
                row = np.searchsorted(known, windows[at])
                same = known[np.minimum(row, len(known) - 1)] == windows[at]
                at, row = at[same], row[same]
                text = np.searchsorted(first, at, side="right") - 1
                inside = at + size <= first[text + 1]
                for i, r, t in zip(at[inside].tolist(), row[inside].tolist(), text[inside].tolist()):
                    key = b" ".join(data[starts[j] : ends[j]].tobytes() for j in range(i, i + size))
                    while r < len(known) and keys[r] != key and known[r] == windows[i]:
                        r += 1
                    if r < len(known) and keys[r] == key:
                        edge[i] += 1
                        edge[i + size] -= 1
                        found[t].update(owners[r])
            hit = np.cumsum(edge[:-1]) > 0
            for t in range(texts):
                lo, hi = first[t], first[t + 1]
                n_words.append(int(hi - lo))
                items.append(sorted(found[t]))
                run = np.diff(np.concatenate(([0], hit[lo:hi].view(np.int8), [0]))) if found[t] else np.zeros(0, np.int8)
                froms.append(np.flatnonzero(run == 1).tolist())
                tos.append(np.flatnonzero(run == -1).tolist())
        return n_words, froms, tos, items


def _pieces(data: np.ndarray, n: int, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``limit`` bytes that end between words and hold every run of ``n`` words."""
    at, size = 0, limit
    while at < len(data):
        end = at + size
        if end < len(data):
            gap = np.flatnonzero(~K.ALNUM[data[end : end + limit]])
            if not len(gap):  # within a very long word
                size += limit
                continue
            end += int(gap[0])
        if end >= len(data):
            yield at, len(data)
            return
        starts, _, _ = K.words(data[at:end], np.array([0, end - at]), K.ALNUM)
        if len(starts) < 2 * n:  # too few words to go on from
            size += limit
            continue
        yield at, end
        at, size = at + int(starts[len(starts) - n + 1]), limit


def grams(benchmark: DataFrame, n: int, id_col: str, text_col: str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(hash, size, gram, item) of every window of every item, each once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                whole = K.lower_ascii(np.frombuffer(text.as_py().encode(), dtype=np.uint8))
                for a, b in _pieces(whole, n, piece_bytes):
                    data = whole[a:b]
                    starts, ends, _ = K.words(data, np.array([0, len(data)]), K.ALNUM)
                    size = min(n, len(starts))
                    if size:
                        hashes = K.window_hash(K.word_hash(data, starts, ends), size).view(np.int64)
                        own = [data[x:y].tobytes() for x, y in zip(starts, ends)]
                        keys = [b" ".join(own[i : i + size]) for i in range(len(hashes))]
                        yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array([size] * len(keys), pa.int32()), pa.array(keys, pa.binary()), pa.array([item] * len(keys))], ["hash", "size", "gram", "item"])

    return _items(benchmark, id_col, text_col).mapInArrow(cut, "hash long, size int, gram binary, item string").distinct()


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null").distinct()


class Filter:
    """A bit for each upper part of the hashes that n-grams have."""

    def __init__(self, known: DataFrame):
        facts = known.agg(F.count("*").alias("n"), F.collect_set("size").alias("sizes")).first()
        self.sizes = sorted(facts.sizes)
        self.log = min(FILTER_BITS.bit_length() - 1, max(15, (16 * facts.n).bit_length()))
        place = F.shiftrightunsigned("hash", 64 - self.log)
        bits = known.groupBy(F.expr(f"shiftrightunsigned(hash, {64 - self.log}) div 32768").alias("part")).agg(F.bitmap_construct_agg(F.pmod(place, F.lit(32768))).alias("bits"))
        self.bits = np.zeros(1 << (self.log - 3), dtype=np.uint8)
        for r in bits.toLocalIterator():  # 4,096 bytes each, FILTER_BITS in all
            self.bits[r.part * 4096 : (r.part + 1) * 4096] = np.frombuffer(r.bits, dtype=np.uint8)

    def passing(self, hashes: np.ndarray) -> np.ndarray:
        place = (hashes >> np.uint64(64 - self.log)).astype(np.int64)
        return np.flatnonzero((self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1)


def _passing_windows(docs: DataFrame, text_col: str, sent: Broadcast) -> DataFrame:
    """(key, at, size, hash, gram) of the windows of ``docs`` that the filter lets pass."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Filter = sent.value
        for batch in batches:
            keys = batch.column(0)
            for part in K.slices(batch.column(1)):
                data = K.lower_ascii(part.data)
                starts, ends, first = K.words(data, part.offsets, K.ALNUM)
                hashes = K.word_hash(data, starts, ends)
                for size in known.sizes:
                    windows = K.window_hash(hashes, size)
                    at = known.passing(windows) if len(windows) else np.zeros(0, dtype=np.int64)
                    text = np.searchsorted(first, at, side="right") - 1
                    inside = at + size <= first[text + 1]
                    at, text = at[inside], text[inside]
                    for a in range(0, len(at), 4096):
                        some, own = at[a : a + 4096], text[a : a + 4096]
                        words = [b" ".join(data[starts[j] : ends[j]].tobytes() for j in range(i, i + size)) for i in some.tolist()]
                        columns = [keys.take(pa.array(part.first + own)), pa.array(some - first[own], pa.int32()), pa.array([size] * len(words), pa.int32()), pa.array(windows[some].view(np.int64)), pa.array(words, pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, ["key", "at", "size", "hash", "gram"])

    texts = docs.select(text_key(F.col(text_col)).alias("key"), F.coalesce(text_col, F.lit("")).alias("text"))
    return texts.mapInArrow(scan, "key binary, at int, size int, hash long, gram binary")


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, list[str]]:
    """``docs`` with the words each text has, the maximal hit runs as half-open
    word ranges, and the items that occur. Returns the frame and the names of
    the four new columns."""
    names = fresh(docs, "n_words", "hit_from", "hit_to", "items")

    def scanned(sent: Broadcast) -> DataFrame:
        at = docs.columns.index(text_col)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_words, lo, hi, items = sent.value.scan(batch.column(at))
                new = [pa.array(n_words, pa.int64()), pa.array(lo, pa.list_(pa.int32())), pa.array(hi, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *names])

        schema = docs.limit(0).select("*", *(F.lit(None).cast(kind).alias(c) for c, kind in zip(names, ("long", "array<int>", "array<int>", "array<string>")))).schema
        return docs.mapInArrow(scan, schema)

    context = docs.sparkSession.sparkContext
    items_table = _items(benchmark, item_id, item_text)
    if items_table.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] <= block_bytes:
        return scanned(context.broadcast(Windows([tuple(r) for r in items_table.collect()], n))), names
    n_words, lo, hi, items = names
    (key,) = fresh(docs.select("*", *(F.lit(0).alias(c) for c in names)), "key")
    known = written(grams(benchmark, n, item_id, item_text), "grams")
    hits = _passing_windows(docs, text_col, context.broadcast(Filter(known))).join(known, ["hash", "size", "gram"])
    hits = written(hits.select("key", "at", "size", "item").distinct(), "hits")
    runs = F.array_sort(F.collect_set(F.struct(F.col("at").alias("lo"), (F.col("at") + F.col("size")).alias("hi"))))
    merged = hits.groupBy(F.col("key").alias(key)).agg(runs.alias("runs"), F.array_sort(F.collect_set("item")).alias(items))
    # Overlapping and adjacent runs become one.
    step = "aggregate(runs, cast(array() as array<struct<lo:int,hi:int>>), (a, r) -> if(size(a) > 0 and element_at(a, -1).hi >= r.lo, concat(slice(a, 1, size(a) - 1), array(named_struct('lo', element_at(a, -1).lo, 'hi', greatest(element_at(a, -1).hi, r.hi)))), concat(a, array(r))))"
    merged = merged.withColumn("runs", F.expr(step))
    base = scanned(context.broadcast(Windows([], n))).drop(lo, hi, items).withColumn(key, text_key(F.col(text_col)))
    none = F.array().cast("array<int>")
    joined = base.join(merged, key, "left").drop(key)
    out = joined.withColumns({lo: F.coalesce("runs.lo", none), hi: F.coalesce("runs.hi", none), items: F.coalesce(items, F.array().cast("array<string>"))}).drop("runs")
    return out.select(*docs.columns, *names), names


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", **options) -> DataFrame:
    """The documents in which no benchmark window occurs."""
    found, names = find_hits(docs, benchmark, n, text_col, **options)
    return found.filter(F.size(names[3]) == 0).select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", **options) -> DataFrame:
    """All documents, with the hit runs cut out of their texts, from the
    first hit word's start to the last one's end."""
    found, names = find_hits(docs, benchmark, n, text_col, **options)
    at = [found.columns.index(c) for c in (text_col, *names[1:3])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at[0]).to_pylist()
            lo, hi = (batch.column(i).to_pylist() for i in at[1:])
            for i, text in enumerate(texts):
                if not lo[i]:
                    continue
                raw = np.frombuffer(text.encode(), dtype=np.uint8)
                starts, ends, _ = K.words(K.lower_ascii(raw), np.array([0, len(raw)]), K.ALNUM)
                keep = np.ones(len(raw), dtype=bool)
                for a, b in zip(lo[i], hi[i]):
                    keep[starts[a] : ends[b - 1]] = False
                texts[i] = raw[keep].tobytes().decode()
            columns = list(batch.columns)
            columns[at[0]] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns[: len(docs_columns)], docs_columns)

    docs_columns = docs.columns
    return found.mapInArrow(cut, docs.schema)
