"""Suffix-array dedup: remove repeated passages, found by longest-previous-factor arrays.

A passage is a string of ``length`` bytes. Texts are UTF-8 bytes; passages do
not cross texts.

No task sees the whole corpus, so suffixes first meet by content. Of all
``GRAM``-byte strings in a passage, the one with the least hash is the
passage's anchor. Equal passages have equal anchors at the same distance from
their start, so passages whose anchor occurs once in the corpus are unique and
go no further. Neighbouring passages share anchors: a *context* is a run of
passages with one anchor. Contexts that are equal as a whole are repeats of
each other, and one of them stands for all.

The different contexts of an anchor meet in one task, set against each other at
the anchor. For each distance r, the suffixes that begin r bytes before an
anchor are put in order: those at the anchor are sorted, and each order comes
from the one before by a stable sort on one byte, as suffixes induce each
other. Common prefixes of neighbours, and previous and next smaller positions
in the order, give each passage's longest earlier match (the LPF array, here
capped at ``length``) and, with positions negated, its longest later one. All
of this compares bytes.

An anchor with more than ``max_contexts`` different contexts, as the edge of a
passage in very many texts makes, is split by longer anchors: each of its
passages reaches half of the open bytes further on one side or the other, and
those bytes join the anchor. What is still too large is split again; at the
seventh step the anchor is the passage, and all its contexts are equal. So no
task holds more than ``max_contexts`` contexts of one anchor.

For a passage only whether it is matched in full counts, so common prefixes
are told apart as ``length`` and less, and the arrays hold these two values.
Contexts and texts that are equal as a whole do not go through the arrays: their
digests say what the arrays would.

Anchors go by 64-bit hashes: where two collide, contexts meet that have nothing
in common. Texts and contexts are taken for equal by 128 bits (md5, xxh3).

Equal texts are one text with a count. Texts move once, into a table bucketed
by their hash; contexts move only where an anchor has several.

Nulls and odd input: null is the empty text; texts shorter than ``length``
have no passages. With ``keep="none"``, repeated rows are copies of each other
and lose all their passages; with ``keep="first"``, the first document by id,
then text, keeps its own, and rows with the same id and text are one document.
Ids may be null. An empty table gives an empty result. Columns other than the
two named ones are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import kernel as K
from plumbline.llm.common import shared_folder, text_key, written

#: Bytes of an anchor: longer than most lines that are common without being passages.
GRAM = 80
#: Different contexts of one anchor that one task compares; more are split.
MAX_CONTEXTS = 2000
#: Bytes of contexts that are put in order together, but for whole anchors.
ARRAY_BYTES = 1 << 22

_U = np.uint64


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every run of ``size`` entries, from minima of blocks."""
    count = len(x) - size + 1
    blocks = np.full(-(-len(x) // size) * size, np.iinfo(np.uint64).max, dtype=_U)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, size)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:count], ahead[size - 1 : size - 1 + count])


def find_contexts(part: K.Slice, length: int) -> tuple[np.ndarray, ...]:
    """Text number, anchor hash, first passage's start in its text, the anchor's
    distance from there, and the number of passages, of every context."""
    data, offsets = part.data, part.offsets
    long = np.flatnonzero(np.diff(offsets) >= length)
    if not len(long):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none
    hashed = K.prefix_hash(data)
    starts = np.arange(len(data) - GRAM + 1)
    grams = K.range_hash(hashed, starts, starts + GRAM)
    # The upper half of the hash decides, and of equals the leftmost, in every text alike.
    least = _sliding_min((grams & _U(0xFFFFFFFF00000000)) | starts.astype(_U), length - GRAM + 1)
    anchor = (least & _U(0xFFFFFFFF)).astype(np.int64)
    edge = np.zeros(len(anchor) + 1, dtype=np.int64)
    np.add.at(edge, offsets[long], 1)
    np.add.at(edge, offsets[long + 1] - length + 1, -1)
    inside = np.cumsum(edge[:-1]) > 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
    begins[offsets[long]] = True
    at = np.flatnonzero(begins)
    ends = np.flatnonzero(inside & np.append(begins[1:] | ~inside[1:], True)) + 1
    text = np.searchsorted(offsets, at, side="right") - 1
    return text, grams[anchor[at]].view(np.int64), at - offsets[text], anchor[at] - at, ends - at


def context_digest(raw: bytes, anchor: int) -> bytes:
    """128 bits that tell a context's bytes and anchor."""
    return xxhash.xxh3_128_digest(raw, anchor & 0xFFFFFFFFFFFFFFFF)


def _neighbours_share(strings: list[bytes], order: list[int], size: int) -> np.ndarray:
    """The length of the common prefix of each string and the one before it in order; 0 for the first."""
    out = np.zeros(len(order), dtype=np.int64)
    if size and len(order) > 1:
        lengths = np.array([len(strings[i]) for i in order])
        table = np.frombuffer(b"".join(strings[i].ljust(size, b"\0") for i in order), dtype=np.uint8).reshape(-1, size)
        differ = table[1:] != table[:-1]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), size)
        out[1:] = np.minimum(same, np.minimum(lengths[1:], lengths[:-1]))
    return out


def smaller_neighbour(value: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """For each place of the suffix order, the common prefix with the nearest
    place before it that has a smaller value; 0 where there is none.

    ``prefix[i]`` is the common prefix of places i - 1 and i. All places jump
    to their neighbour's neighbour until it is smaller.
    """
    n = len(value)
    before = np.arange(-1, n - 1)
    shared = prefix.copy()
    if n:
        shared[0] = 0
    todo = np.flatnonzero((before >= 0) & (shared > 0))
    todo = todo[value[before[todo]] > value[todo]]
    while len(todo):
        j = before[todo]
        shared[todo] = np.minimum(shared[todo], shared[j])
        before[todo] = before[j]
        todo = todo[before[todo] >= 0]
        todo = todo[(value[before[todo]] > value[todo]) & (shared[todo] > 0)]
    shared[before < 0] = 0
    return shared


def longest_factors(value: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a suffix order, the longest match with an earlier and with a later position."""
    back = np.zeros_like(prefix)
    back[1:] = prefix[:0:-1]  # for the order read backwards
    earlier, later = (np.maximum(smaller_neighbour(v, prefix), smaller_neighbour(v[::-1], back)[::-1]) for v in (value, -value))
    return earlier, later


def repeated_passages(raws: list[bytes], leads: list[int], length: int, keep: str) -> tuple[np.ndarray, np.ndarray]:
    """Which passages of some contexts are repeated, flat, and where each
    context's passages begin (one more entry than contexts).

    ``leads`` are the distances of the contexts' anchors from their starts. Of
    two passages, the one in the earlier context, or further left in it, is earlier.
    """
    n = len(raws)
    lead = np.array(leads, dtype=np.int64)
    many = np.array([len(b) for b in raws], dtype=np.int64) - length + 1
    least = lead - many + 1  # distance of the last passage's start from the anchor
    first = np.concatenate(([0], np.cumsum(many)))
    rights = [b[a:] for b, a in zip(raws, leads)]
    lefts = [b[:a][::-1] for b, a in zip(raws, leads)]
    reach = int(lead.max(initial=0))
    # Suffixes at the anchors, and what is left of the anchors, backwards.
    order = np.array(sorted(range(n), key=rights.__getitem__), dtype=np.int64)
    right_share = _neighbours_share(rights, order.tolist(), length)
    left_order = np.array(sorted(range(n), key=lefts.__getitem__), dtype=np.int64)
    left_share = _neighbours_share(lefts, left_order.tolist(), reach)
    right_place, left_place = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    right_place[order], left_place[left_order] = np.arange(n), np.arange(n)
    # The byte r before the anchor, plus one; 0 is none.
    before = np.zeros((n, reach), dtype=np.uint16)
    if reach:
        before[:] = np.frombuffer(b"".join(x.ljust(reach, b"\0") for x in lefts), dtype=np.uint8).reshape(n, reach)
        before += 1
        before[np.arange(reach) >= lead[:, None]] = 0

    rows, passages, prefixes = [], [], []
    for r in range(reach + 1):
        if r:
            order = order[np.argsort(before[order, r - 1], kind="stable")]
        some = order[(least[order] <= r) & (r <= lead[order])]
        if len(some) < 2:
            continue
        # Equal passages share r bytes before the anchor and length - r from it on.
        right = np.cumsum(right_share < length - r)[right_place[some]]
        left = np.cumsum(left_share < r)[left_place[some]]
        same = np.zeros(len(some) + 1, dtype=bool)
        same[1:-1] = (right[1:] == right[:-1]) & (left[1:] == left[:-1])
        alike = np.flatnonzero(same[:-1] | same[1:])  # others match nothing as long
        some = some[alike]
        rows.append(some)
        passages.append(first[some] + lead[some] - r)
        prefixes.append(np.where(same[alike], length, 0))
    repeated = np.zeros(first[-1], dtype=bool)
    if rows:
        passage = np.concatenate(passages)
        earlier, later = longest_factors(passage, np.concatenate(prefixes))
        repeated[passage] = earlier >= length if keep == "first" else np.maximum(earlier, later) >= length
    return repeated, first


RANGES = "array<struct<lo:int,hi:int>>"
VERDICT = f"context binary, ranges {RANGES}"
SITE = "anchor long, context binary, owner binary, place string, at int, lead int, many int, low int, high int"
SITE_COLUMNS = [x.split()[0] for x in SITE.split(", ")]


def _ranges(repeated: np.ndarray, first: np.ndarray) -> pa.Array:
    """The runs of repeated passages of each context."""
    inner = first[1:-1]
    begins, ends = repeated.copy(), repeated.copy()
    begins[1:] &= ~repeated[:-1]
    ends[:-1] &= ~repeated[1:]
    begins[inner], ends[inner - 1] = repeated[inner], repeated[inner - 1]
    lo, hi = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    base = first[np.searchsorted(first, lo, side="right") - 1]
    runs = pa.StructArray.from_arrays([pa.array((lo - base).astype(np.int32)), pa.array((hi - base).astype(np.int32))], ["lo", "hi"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(lo, first).astype(np.int32)), runs)


def _by_suffix_order(contexts: DataFrame, length: int, keep: str) -> DataFrame:
    """(context, ranges): runs of repeated passages by number, of the contexts that have any."""

    def bundle(rows: list[tuple[bytes, int, bytes]]) -> pa.RecordBatch:
        names, leads, raws = zip(*rows)
        ranges = _ranges(*repeated_passages(list(raws), list(leads), length, keep))
        out = pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), ranges], ["context", "ranges"])
        return out.filter(pa.array(np.diff(ranges.offsets.to_numpy()) > 0))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[bytes, int, bytes]] = []
        size, last = 0, None
        for batch in batches:
            for anchor, context, lead, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if anchor != last and size >= ARRAY_BYTES:
                    yield bundle(rows)
                    rows, size = [], 0
                rows.append((context, lead, raw))
                size += len(raw)
                last = anchor
        if rows:
            yield bundle(rows)

    dealt = contexts.repartition("anchor").sortWithinPartitions("anchor", "place")
    return dealt.select("anchor", "context", "lead", "bytes").mapInArrow(sort, VERDICT)


def _split(contexts: DataFrame, length: int) -> DataFrame:
    """Sites with longer anchors, the contexts being their owners, and their bytes.

    Passages begin ``low`` to ``high`` bytes before the anchor, so they have
    ``low`` bytes before it and ``length - high`` from it on in common. Each half
    of that range has more.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for context, place, lead, many, low, high, raw in zip(*(batch.column(i).to_pylist() for i in range(7))):
                middle = (low + high + 1) // 2
                for a, b in ((low, middle - 1), (middle, high)):
                    near, far = max(a, lead - many + 1), min(b, lead)
                    if near > far:
                        continue
                    start = lead - far
                    own = raw[start : lead - near + length]
                    anchor = xxhash.xxh3_64_intdigest(raw[lead - a : lead - b + length], b) - (1 << 63)
                    rows.append((anchor, context_digest(own, anchor), context, f"{place}:{start:04d}", start, far, far - near + 1, a, b, own))
            if rows:
                types = [pa.int64(), pa.binary(), pa.binary(), pa.string(), *[pa.int32()] * 5, pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [*SITE_COLUMNS, "bytes"])

    return contexts.select("context", "place", "lead", "many", "low", "high", "bytes").mapInArrow(split, f"{SITE}, bytes binary")


def _repeats(sites: DataFrame, with_bytes: Callable[[DataFrame], DataFrame], length: int, keep: str, max_contexts: int) -> DataFrame:
    """(owner, ranges): runs of repeated passages, by their starts in the owner.

    ``with_bytes`` adds the bytes of contexts, given the sites that stand for
    them. Tables are written before joins on them, so that Spark can split what
    very many sites share.
    """
    rest = [c for c in sites.columns if c not in ("anchor", "context", "place", "at")]
    groups = written(sites.groupBy("anchor", "context").agg(F.count("*").alias("sites"), F.min(F.struct("place", "at", *rest)).alias("first")), "groups")
    kinds = written(groups.groupBy("anchor").agg(F.count("*").alias("kinds"), F.max(F.col("first.high") - F.col("first.low")).alias("open")).filter("kinds > 1"), "kinds")
    several = groups.join(kinds, "anchor").select("anchor", "context", "kinds", "open", "first.*")
    too_many = (F.col("kinds") > max_contexts) & (F.col("open") > 0)
    verdicts = _by_suffix_order(with_bytes(several.filter(~too_many)), length, keep)
    if not kinds.filter(too_many).isEmpty():
        longer = written(_split(with_bytes(several.filter(too_many)), length), "longer")
        found = _repeats(longer, lambda same: same, length, keep, max_contexts)
        verdicts = verdicts.unionByName(found.withColumnRenamed("owner", "context"))

    judged = groups.join(verdicts, "context", "left").filter("sites > 1 or ranges is not null")
    judged = written(judged.select("context", "sites", F.col("first.owner").alias("first_owner"), F.col("first.at").alias("first_at"), "ranges"), "judged")
    each = sites.select("context", "owner", "at", "many").join(judged, "context")
    # Contexts found whole elsewhere are repeats throughout; with keep="first", but for the first of them.
    whole = F.col("sites") > 1
    if keep == "first":
        whole = ~((F.col("owner") == F.col("first_owner")) & (F.col("at") == F.col("first_at")))
    own = F.when(whole, F.array(F.struct(F.lit(0).alias("lo"), F.col("many").alias("hi")))).otherwise(F.col("ranges"))
    moved = F.transform(own, lambda x: F.struct((x["lo"] + F.col("at")).alias("lo"), (x["hi"] + F.col("at")).alias("hi")))
    return each.select("owner", moved.alias("ranges")).filter("ranges is not null").groupBy("owner").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def _row_and_place(docs: DataFrame, id_col: str, text_col: str, keep: str) -> tuple[Column, Column]:
    """What tells texts apart, and the order of documents."""
    key = text_key(F.col(text_col))
    if keep == "none":
        return key, F.lit("")
    own = F.col(id_col)
    if dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint"):
        name = F.lpad((own.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    else:
        name = F.concat(F.lit("0"), own.cast("string"))
    # Whole numbers in the order of numbers, other ids in the order of their strings, null last.
    place = F.concat_ws(":", F.coalesce(name, F.lit("~")), F.hex(key))
    return F.unhex(F.md5(place)), place


def _distinct_texts(keyed: DataFrame) -> DataFrame:
    """(row, place, text, copies), one for each row key, in files bucketed by
    the key: texts are shuffled here and nowhere else."""
    spark = keyed.sparkSession
    one = keyed.groupBy("row").agg(F.first("place").alias("place"), F.first("text").alias("text"), F.count("*").alias("copies"))
    name = f"texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one.write.bucketBy(buckets, "row").option("compression", "zstd").option("path", shared_folder(spark, "texts")).saveAsTable(name)
    texts = spark.table(name)
    # The plan has the files and their buckets by now: the catalogue need not keep the name.
    spark.sql(f"DROP TABLE {name}")
    return texts


def cut_repeats(docs: DataFrame, length: int = 200, keep: str = "none", id_col: str = "doc_id", text_col: str = "text", max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """For each different text (with ``keep="first"``, id and text): its
    ``row`` key, n_bytes, the removed byte ranges ``lo`` and ``hi``, and the
    ``kept`` bytes, which may cut a character.

    ``keep="none"`` removes every byte of a passage that also starts anywhere
    else, ``keep="first"`` of one that also starts earlier. ``length`` is at
    least ``GRAM``.
    """
    if length < GRAM:
        raise ValueError(f"passages of {length} bytes are shorter than an anchor of {GRAM}")
    row, place = _row_and_place(docs, id_col, text_col, keep)
    texts = _distinct_texts(docs.select(row.alias("row"), place.alias("place"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(find_contexts(part, length)[1])], ["anchor"])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch.column(2)):
                text, anchor, start, lead, many = find_contexts(part, length)
                at = start + part.offsets[text]
                raw = part.data.tobytes()
                digests = [context_digest(raw[a:b], own) for a, b, own in zip(at.tolist(), (at + many + length - 1).tolist(), anchor.tolist())]
                rows = pa.array(text + part.first)
                small = [pa.array(x.astype(np.int32)) for x in (start, lead, many, np.zeros(len(at)), np.full(len(at), length - GRAM))]
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(digests, pa.binary()), batch.column(0).take(rows), batch.column(1).take(rows), *small], SITE_COLUMNS)

    counted = texts.select("text").mapInArrow(anchors, "anchor long").groupBy("anchor").agg(F.count("*").alias("n"))
    again = written(counted.filter("n > 1").select("anchor"), "anchors")
    found = texts.select("row", "place", "text").mapInArrow(contexts, SITE)
    sites = written(found.join(again, "anchor"), "contexts")

    def with_bytes(several: DataFrame) -> DataFrame:
        wanted = several.groupBy("owner").agg(F.collect_list(F.struct("anchor", "context", "place", "at", "lead", "many", "low", "high")).alias("wanted"))
        spread = texts.join(wanted, texts["row"] == wanted["owner"]).select(F.encode("text", "UTF-8").alias("raw"), F.explode("wanted").alias("x"))
        where = F.concat_ws(":", "x.place", F.lpad(F.col("x.at").cast("string"), 10, "0"))
        return spread.select("x.anchor", "x.context", where.alias("place"), "x.lead", "x.many", "x.low", "x.high", F.substring(F.col("raw"), F.col("x.at") + 1, F.col("x.many") + (length - 1)).alias("bytes"))

    found_runs = _repeats(sites, with_bytes, length, keep, max_contexts)
    removed = written(found_runs.withColumnRenamed("owner", "row"), "removed")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lows, highs, sizes, kept = batch.column(0), [], [], [], []
            lo_all, hi_all, copied = (batch.column(i).to_pylist() for i in (2, 3, 4))
            raw = batch.column(1)
            for i in range(batch.num_rows):
                data = np.frombuffer(raw[i].as_buffer(), dtype=np.uint8)
                sizes.append(len(data))
                edge = np.zeros(len(data) + 1, dtype=np.int32)
                if copied[i] and len(data) >= length:
                    edge[0], edge[-1] = 1, -1
                elif lo_all[i]:
                    np.add.at(edge, lo_all[i], 1)
                    np.add.at(edge, np.add(hi_all[i], length - 1), -1)
                gone = np.cumsum(edge[:-1]) > 0
                turns = np.diff(np.concatenate(([0], gone.view(np.int8), [0])))
                lows.append(np.flatnonzero(turns == 1).tolist())
                highs.append(np.flatnonzero(turns == -1).tolist())
                kept.append(data[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([rows, pa.array(sizes, pa.int64()), pa.array(lows, pa.list_(pa.int32())), pa.array(highs, pa.list_(pa.int32())), pa.array(kept, pa.binary())], ["row", "n_bytes", "lo", "hi", "kept"])

    # Without an order, all copies of a text are repeats of each other.
    copied = (F.col("copies") > 1) if keep == "none" else F.lit(False)
    joined = texts.join(removed, "row", "left").select("row", "text", "ranges.lo", "ranges.hi", copied.alias("copied"))
    return joined.mapInArrow(cut, "row binary, n_bytes long, lo array<int>, hi array<int>, kept binary")


def row_keys(docs: DataFrame, keep: str = "none", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the ``row`` key by which ``cut_repeats`` tells texts apart."""
    row, _ = _row_and_place(docs, id_col, text_col, keep)
    return docs.select(F.col(id_col), row.alias("row"))
