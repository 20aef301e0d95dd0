"""Mixing sources to target weights by Pfair scheduling.

Every source is a task with a weight, every block of its text a unit job: the
i-th block of a source of weight w is released at slot floor(i / w) and due by
slot ceil((i + 1) / w). Earliest deadline first meets all deadlines, so in any
prefix of the schedule each source is less than one block off its weight.

Weights are exact. When sources run out, the others go on with their weights
scaled up: by virtual time v a source of n blocks has had min(w * v, n), and
slot T(v) is the sum of these, so block i is released at floor(T(i / w)) and
due by ceil(T((i + 1) / w)), in whole numbers throughout. A source is less than
one block off its share at every slot, however long the schedule is. One task
works it out from a row per source; it keeps a few numbers for each source, and
hands out slots by the thousand, which are joined to the blocks. No document
is dropped or repeated: the weights decide the order.

Within a source, documents stand in the order of a hash. Their places are
running sums of sizes, made in two levels, so that a source with a third of
all rows is summed by many tasks: the hash range is cut into about as many
chunks as a chunk has documents.

Nulls and odd input: a null source is a source of its own, a null text has
size one, like an empty one. A text larger than a block fills several slots.
Repeated rows keep their number, in any order among themselves. Sources
without a target weight take the least weight given; a weight of zero or below,
or one that is not a number, is an error. An empty table gives an
empty result. Extra columns pass through ``mix_documents``.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import fresh, text_key

#: Size of a block in code points.
BLOCK_CHARS = 100_000
#: Blocks whose slots make a row.
PART = 1024
#: Blocks and sources up to which their slots are broadcast: about 10 MB.
BROADCAST_BLOCKS = 1_000_000


def schedule(blocks: Sequence[int], weights: Sequence[float]) -> Iterator[tuple[int, int]]:
    """(source, block) of each slot, by earliest deadline first with exact weights."""
    exact = [Fraction(w) for w in weights]
    unit = math.lcm(*(w.denominator for w in exact)) if exact else 1
    whole = [int(w * unit) for w in exact]
    by_end = sorted((s for s, n in enumerate(blocks) if n), key=lambda s: Fraction(blocks[s], whole[s]))
    ends = [blocks[s] / whole[s] for s in by_end]
    # Up to the k-th end, T(v) = over[k] + rate[k] * v; T is the least of these.
    over, rate = [0], [sum(whole[s] for s in by_end)]
    for s in by_end:
        over.append(over[-1] + blocks[s])
        rate.append(rate[-1] - whole[s])

    def passed(i: int, s: int, up: bool) -> int:
        """T(i / w) of a source, rounded."""
        k, w = bisect.bisect_left(ends, i / whole[s]), whole[s]
        at = over[k] * w + rate[k] * i
        for step in (1, -1):
            while 0 <= k + step < len(over) and (x := over[k + step] * w + rate[k + step] * i) < at:
                k, at = k + step, x
        return -(-at // w) if up else at // w

    waiting = [(0, s, 0) for s in by_end]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    for slot in range(over[-1]):
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (passed(i + 1, s, True), s, i))
        due, s, i = heapq.heappop(ready)
        assert due > slot
        yield s, i
        if i + 1 < blocks[s]:
            heapq.heappush(waiting, (max(slot + 1, passed(i + 1, s, False)), s, i + 1))


def _slots(totals: DataFrame, given: Mapping[str, float] | None, block_chars: int) -> DataFrame:
    """Rows (p_pool, p_part, p_slots) with the slots of ``PART`` blocks each, of pools (pool, total)."""
    least = min(given.values(), default=1.0) if given is not None else 0.0

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["pool"], r["total"]) for batch in batches for r in batch.to_pylist())
        sizes = [-(-n // block_chars) for _, n in rows]
        weights = [float(n) ** 0.7 for _, n in rows] if given is None else [given.get(s, least) for s, _ in rows]
        last = sum(sizes)
        filled: list[list[int]] = [[] for _ in rows]
        out: list[tuple[str, int, list[int]]] = []
        for slot, (s, i) in enumerate(schedule(sizes, weights)):
            filled[s].append(slot)
            if (i + 1) % PART == 0 or i + 1 == sizes[s]:
                out.append((rows[s][0], i // PART, filled[s]))
                filled[s] = []
            if out and (len(out) >= 1000 or slot + 1 == last):
                pools, parts, slots = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(pools, pa.string()), pa.array(parts, pa.int64()), pa.array(slots, pa.list_(pa.int64()))], ["p_pool", "p_part", "p_slots"])
                out = []

    return totals.repartition(1).mapInArrow(plan, "p_pool string, p_part long, p_slots array<long>")


def checked(weights: Mapping[str | None, float]) -> dict[str, float]:
    """Target weights by pool. A source that is to be left out has to be left
    out of the documents: a weight that is not above zero is an error."""
    bad = {s: w for s, w in weights.items() if not (math.isfinite(w) and w > 0)}
    if bad:
        raise ValueError(f"weights must be finite and above zero: {bad}")
    return {"null" if s is None else f"s:{s}": float(w) for s, w in weights.items()}


def _scheduled(docs: DataFrame, weights: Mapping[str | None, float] | None, block_chars: int, source_col: str, text_col: str, id_col: str, seed: int) -> tuple[DataFrame, dict[str, str]]:
    wanted = ("pool", "size", "order", "chunk", "before", "block", "slot", "at", "key", "c_pool", "c_chunk", "c_total", "c_before", "p_pool", "p_part", "p_slots")
    names = dict(zip(wanted, fresh(docs, *wanted)))
    pool, size, order, chunk, before, block, slot, at, key, c_pool, c_chunk, c_total, c_before, p_pool, p_part, p_slots = names.values()
    df = docs.withColumn(pool, F.coalesce(F.concat(F.lit("s:"), F.col(source_col).cast("string")), F.lit("null")))
    df = df.withColumn(size, F.greatest(F.coalesce(F.length(text_col), F.lit(0)), F.lit(1)).cast("long"))
    df = df.withColumn(key, text_key(F.col(text_col)))
    df = df.withColumn(order, F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(key)))
    totals = df.groupBy(F.col(pool).alias("pool")).agg(F.sum(size).alias("total"), F.count("*").alias("n"))
    most, n_blocks = totals.agg(F.max("n"), F.sum(F.ceil(F.col("total") / block_chars))).first()
    # About as many chunks as documents in a chunk, for the largest source.
    bits = max(1, math.ceil(math.log2(max(2, most or 0)) / 2))
    df = df.withColumn(chunk, F.shiftrightunsigned(F.col(order), 64 - bits))

    given = None if weights is None else checked(weights)

    chunks = df.groupBy(pool, chunk).agg(F.sum(size).alias(c_total))
    running = F.expr(f"sum(`{c_total}`) over (partition by `{pool}` order by `{chunk}`) - `{c_total}`")
    chunks = chunks.select(F.col(pool).alias(c_pool), F.col(chunk).alias(c_chunk), running.alias(c_before))
    within = f"coalesce(sum(`{size}`) over (partition by `{pool}`, `{chunk}` order by `{order}`, `{key}` rows between unbounded preceding and 1 preceding), 0)"
    df = df.withColumn(before, F.expr(within)).join(chunks, (F.col(pool) == F.col(c_pool)) & (F.col(chunk) == F.col(c_chunk)))
    df = df.withColumn(before, F.col(before) + F.col(c_before))
    df = df.withColumn(block, F.expr(f"`{before}` div {block_chars}")).withColumn(at, F.pmod(F.col(before), F.lit(block_chars)))

    table = _slots(totals.select("pool", "total"), given, block_chars).toDF(p_pool, p_part, p_slots)
    if (n_blocks or 0) <= BROADCAST_BLOCKS:
        table = F.broadcast(table)
    df = df.join(table, (F.col(pool) == F.col(p_pool)) & (F.expr(f"`{block}` div {PART}") == F.col(p_part)))
    df = df.withColumn(slot, F.get(p_slots, F.pmod(F.col(block), F.lit(PART)).cast("int")))
    return df, names


def mixture_order(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_chars: int = BLOCK_CHARS, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", seed: int = 0) -> DataFrame:
    """``id_col``, ``source_col``, the block of its source that a document
    starts in, that block's slot in the schedule, and its place ``at`` within.

    ``weights`` are targets by source; by default the sources' sizes to the
    power of 0.7.
    """
    narrow = docs.select(id_col, source_col, text_col)
    df, n = _scheduled(narrow, weights, block_chars, source_col, text_col, id_col, seed)
    return df.select(id_col, source_col, F.col(n["block"]).alias("block"), F.col(n["slot"]).alias("slot"), F.col(n["at"]).alias("at"))


def with_slots(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_chars: int = BLOCK_CHARS, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", seed: int = 0) -> DataFrame:
    """``docs`` with two more columns at the end, by which ``in_order`` sorts
    them, also after they were written and read again."""
    df, n = _scheduled(docs, weights, block_chars, source_col, text_col, id_col, seed)
    return df.select(*docs.columns, n["slot"], n["at"])


def in_order(slotted: DataFrame) -> DataFrame:
    """Rows of ``with_slots`` in the order of the schedule, without its columns."""
    *columns, slot, at = slotted.columns
    return slotted.repartitionByRange(slot, at).sortWithinPartitions(slot, at).select(*columns)


def mix_documents(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_chars: int = BLOCK_CHARS, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", seed: int = 0) -> DataFrame:
    """``docs`` in the order of the schedule: partitions are ranges of slots."""
    return in_order(with_slots(docs, weights, block_chars, source_col, text_col, id_col, seed))
