"""MinHash near-dedup with BagMinHash signatures of word shingles.

A text is the bag of its five-word shingles, each weighted by how often it
occurs. For each shingle there is one Poisson process over (time, weight),
the same in every text, of which a text sees the part up to the shingle's
weight. Every point falls on one of the signature's places, which keeps its
earliest point; two texts agree on a place with the probability of their
weighted Jaccard similarity. The weight axis is discretised to occurrences and
covered by dyadic intervals that are split in halves only where a point falls
early enough to matter, so a shingle repeated w times costs its early points
and not w processes.

Bands of the signature make buckets. A bucket's leader is the text with most
company over all its buckets, usually what the others were copied from; every
member is compared with the leader by exact multiset overlap, and links make
components. Buckets whose members are still in several components go on by
family, that is by leader: the family's members outside its largest component
are set against all of its members, in tiles of two blocks of bounded size. A
task counts the common shingles of a tile by products of matrices, and emits
the links that join its components and no other pair. So every two texts that
share a bucket are compared or of one class, and bags that differ so much in
size that they cannot be similar are not compared with a leader.

Shingles are compared by 64-bit hashes in which each byte of a word has a
random value of its own place, so only chance makes two of them equal, about
once in 10**19 pairs.

Exact copies are one text from the start, whatever their number. Buckets are
counted and led by map-side combined aggregates. Texts move once, keyed by
their hash.

Nulls and odd input: null and empty texts, and those of white space only, have
no shingles; they are near copies of texts with the same bytes only, null
counting as empty. A text of one to four words is one shingle. Repeated rows
are copies. Null ids sort after others. An empty table gives an empty result.
Extra columns pass through ``drop_near_duplicates``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import kernel as K
from plumbline.llm.common import fresh, text_key, written
from plumbline.llm.components import connected_components

SHINGLE = 5
THRESHOLD = 0.8
#: Texts, and shingles in them, of a block of a family; a text larger than that is a block's worth alone.
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 1 << 20
#: Shingles that are counted in one product.
PRODUCT_COLUMNS = 4096
#: A pair at the threshold shares a bucket with probability 1 - (1 - 0.8**5)**25 = 0.99995.
BANDS, ROWS = 25, 5

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def _waits(state: np.ndarray) -> np.ndarray:
    """Exponential waiting times of rate 1."""
    return -np.log(((K.mix(state) >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53)


def _state(element: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return K.mix(element ^ K.mix(lo.astype(_U) * _STEP + hi.astype(_U)))


def weighted(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, value) and how often each occurs."""
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return text[at], value[at], np.diff(np.append(at, len(text)))


def bag_minhash(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n_texts: int, places: int) -> np.ndarray:
    """Signatures (n_texts x places) of bags of elements with integer weights.

    A place holds the time of its earliest point; texts without elements have
    infinity everywhere.
    """
    best = np.full(n_texts * places, np.inf)
    total = np.bincount(text, weights=weight, minlength=n_texts)
    # One node per dyadic interval [0,1), [1,2), [2,4), ... that begins below the weight.
    count = np.where(weight > 1, 2 + np.floor(np.log2(np.maximum(weight - 1, 1))).astype(np.int64), 1)
    of = np.repeat(np.arange(len(text)), count)
    k = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    lo = np.where(k == 0, 0, 1 << np.maximum(k - 1, 0))
    hi = 1 << k
    state = _state(element[of], lo, hi)
    t = _waits(state) / (hi - lo)
    draw = np.ones(len(of), dtype=_U)
    nodes = [of, lo, hi, t, state, draw]
    with np.errstate(divide="ignore"):
        until = places * (np.log(places) + 2) / total  # by then most places have a point

    def emit(of: np.ndarray, t: np.ndarray) -> None:
        place = K.mix(t.view(_U) ^ element[of]) % _U(places)
        np.minimum.at(best, text[of] * places + place.astype(np.int64), t)

    open_texts = total > 0
    while open_texts.any():
        later = []
        nodes = [x[open_texts[text[nodes[0]]]] for x in nodes]
        while len(nodes[0]):
            due = nodes[3] <= until[text[nodes[0]]]
            later.append([x[~due] for x in nodes])
            of, lo, hi, t, state, draw = (x[due] for x in nodes)
            if not len(of):
                break
            inside = hi <= weight[of]
            emit(of[inside], t[inside])
            leaf = hi - lo == 1
            # A leaf runs on by itself: as many waits as it may need, at once.
            l_of, l_lo, l_hi, l_t, l_state, l_draw = (x[leaf] for x in (of, lo, hi, t, state, draw))
            left = until[text[l_of]] - l_t
            many = np.ceil(left + 2 * np.sqrt(left) + 1).astype(np.int64)
            rep = np.repeat(np.arange(len(l_of)), many)
            ends = np.cumsum(many)
            place = np.arange(len(rep)) - np.repeat(ends - many, many)
            waits = _waits(l_state[rep] + (l_draw[rep] + place.astype(_U)) * _STEP)
            times = _running(l_t, waits, many)
            early = times <= until[text[l_of[rep]]]
            emit(l_of[rep][early], times[early])
            go_on = [l_of, l_lo, l_hi, times[ends - 1], l_state, l_draw + many.astype(_U)]
            # Others split: one half keeps the point, the other waits for its own.
            s_of, s_lo, s_hi, s_t, s_state = (x[~leaf] for x in (of, lo, hi, t, state))
            mid = (s_lo + s_hi) // 2
            upper = (K.mix(s_state ^ _STEP) & _U(1)) == 1
            parts = [go_on]
            for is_upper, a, b in ((False, s_lo, mid), (True, mid, s_hi)):
                own = _state(element[s_of], a, b)
                at = np.where(upper == is_upper, s_t, s_t + _waits(own) / (b - a))
                seen = a < weight[s_of]
                parts.append([x[seen] for x in (s_of, a, b, at, own, np.ones(len(s_of), dtype=_U))])
            nodes = [np.concatenate(x) for x in zip(*parts)]
        nodes = [np.concatenate(x) for x in zip(*later)]
        open_texts = open_texts & np.isinf(best.reshape(n_texts, places)).any(axis=1)
        until = until * 2
    return best.reshape(n_texts, places)


def _running(start: np.ndarray, waits: np.ndarray, many: np.ndarray) -> np.ndarray:
    """start plus running sums of the waits of each segment, added in the order
    of the segment alone, so that equal processes get equal times to the bit."""
    times = np.empty(len(waits))
    now, first = start.copy(), np.cumsum(many) - many
    alive = np.arange(len(many))
    for k in range(int(many.max(initial=0))):
        alive = alive[many[alive] > k]
        now[alive] += waits[first[alive] + k]
        times[first[alive] + k] = now[alive]
    return times


def sign(column: pa.Array, bands: int, rows: int, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Band hashes (texts x bands), 0 where there are no words, and the sizes
    of the bags, of each slice of a string column."""
    for part in K.slices(column):
        n = len(part.offsets) - 1
        text, value, weight = weighted(*K.shingles(part, shingle))
        best = bag_minhash(text, value, weight, n, bands * rows)
        points = K.mix(best.view(_U)).reshape(n, bands, rows)
        hashes = np.zeros((n, bands), dtype=_U)
        for r in range(rows):
            hashes = K.mix(hashes * _STEP + points[:, :, r])
        hashes ^= K.mix(np.arange(1, bands + 1, dtype=_U))
        hashes[np.isinf(best).all(axis=1)] = 0
        yield hashes, np.bincount(text, weights=weight, minlength=n).astype(np.int64)


def overlap(a: pa.Array, b: pa.Array, shingle: int) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle bags of each row's two texts."""
    size = np.cumsum([len(x.as_buffer()) + len(y.as_buffer()) for x, y in zip(a, b)])
    out, i = [], 0
    while i < len(a):  # as many rows at a time as make a slice
        reach = (size[i - 1] if i else 0) + K.SLICE_BYTES
        j = max(i + 1, int(np.searchsorted(size, reach, side="right")))
        out.append(_overlap(a.slice(i, j - i), b.slice(i, j - i), shingle))
        i = j
    return np.concatenate(out) if out else np.zeros(0)


def _overlap(a: pa.Array, b: pa.Array, shingle: int) -> np.ndarray:
    texts, values, n = [], [], len(a)
    for column, base in ((a, 0), (b, n)):
        for part in K.slices(column):
            text, value = K.shingles(part, shingle)
            texts.append(text + part.first + base)
            values.append(value)
    text, value, weight = weighted(np.concatenate(texts), np.concatenate(values))
    total = np.bincount(text, weights=weight, minlength=2 * n)
    text = text % n
    order = np.lexsort((text, value))
    text, value, weight = text[order], value[order], weight[order]
    twin = np.flatnonzero((text[1:] == text[:-1]) & (value[1:] == value[:-1]))
    common = np.bincount(text[twin], weights=np.minimum(weight[twin], weight[twin + 1]), minlength=n)
    both = total[:n] + total[n:] - common
    return np.where(both > 0, common / np.maximum(both, 1), 0.0)


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """``pairs`` (a, b: text keys) with their similarity ``sim``."""
    left = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    full = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sim = overlap(batch.column(2), batch.column(3), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim)], ["a", "b", "sim"])

    return full.mapInArrow(verify, "a binary, b binary, sim double")


def near_duplicate_links(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """Verified links (a, b, sim) between different texts, by text key."""
    return _linked(docs, text_col, threshold, bands, rows, shingle)[0]


def _linked(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Links, enough to make the classes, and the components (node, root) they make."""
    keyed = docs.select(text_key(F.col(text_col)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for hashes, sizes in sign(batch.column(1), bands, rows, shingle):
                n = len(hashes)
                flat = pa.array(np.ascontiguousarray(hashes).view(np.int64).reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), lists, pa.array(sizes)], ["key", "buckets", "size"])
                at += n

    signatures = keyed.mapInArrow(signed, "key binary, buckets array<long>, size long").dropDuplicates(["key"])
    signatures = written(signatures, "signatures")
    in_bucket = signatures.select("key", "size", F.explode("buckets").alias("bucket")).filter("bucket <> 0")
    # Written, as are the leaders, so that the joins can split a bucket with very many members.
    shared = written(in_bucket.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    # Texts with company, their shared buckets, and how much company they have.
    members = written(in_bucket.join(shared, "bucket").groupBy("key", "size").agg(F.collect_list("bucket").alias("buckets"), F.sum("n").alias("company")), "members")
    each = members.select("key", "size", "company", F.explode("buckets").alias("bucket"))
    texts = written(keyed.dropDuplicates(["key"]).join(members.select("key"), "key", "left_semi"), "texts")

    first = written(each.groupBy("bucket").agg(F.max(F.struct("company", "key", "size")).alias("leader")).select("bucket", F.col("leader.key").alias("leader"), F.col("leader.size").alias("leader_size")), "leaders")
    # A bag that is too small or too large cannot be similar.
    fits = F.least("size", "leader_size") >= threshold * F.greatest("size", "leader_size") - 1e-6
    pairs = each.join(first, "bucket").filter("key <> leader").filter(fits).select(F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b")).distinct()
    tested = written(_verified(pairs, texts, shingle), "tested")
    links = tested.filter(F.col("sim") >= threshold)

    roots = connected_components(links)
    labelled = each.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    mixed = labelled.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("bucket")
    family = labelled.join(written(mixed, "mixed"), "bucket").join(first.select("bucket", "leader"), "bucket")
    family = written(family.select("leader", "key", "size", "root").distinct(), "family")
    if family.isEmpty():
        return links, roots
    joined = written(_in_tiles(family, texts, threshold, shingle), "tested")
    if joined.isEmpty():
        return links, roots
    links = links.unionAll(joined)
    return links, connected_components(links)


def _in_tiles(family: DataFrame, texts: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """Links (a, b, sim) between members (leader, key, size, root) of a family
    that are not of one root: enough to join the components that any link joins."""
    by_root = family.groupBy("leader", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    main = by_root.groupBy("leader").agg(F.max(F.struct("n", "root", "size")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("total"))

    def blocks(n: str, size: str) -> Column:
        return F.expr(f"cast(1 + ({n}) div {BLOCK_TEXTS} + ({size}) div {BLOCK_SHINGLES} as int)")

    main = written(main.select("leader", F.col("main.root").alias("main"), blocks("n", "total").alias("across"), blocks("n - main.n", "total - main.size").alias("down")), "families")
    spread = family.join(main, "leader").withColumn("rest", F.col("root") != F.col("main"))
    number = F.xxhash64("key")
    # Everyone stands in one block of columns, in each row of tiles; the rest also in one row, in each block of columns.
    members = spread.select("leader", "key", "root", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("i"), F.pmod(number, F.col("across")).cast("int").alias("j"))
    asking = spread.filter("rest").select("leader", "key", "root", F.lit(True).alias("asks"), F.pmod(number, F.col("down")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("j"))
    placed = members.unionByName(asking).join(texts, "key").select("leader", "i", "j", "key", "root", "asks", "text")
    return placed.groupBy("leader", "i", "j").applyInArrow(lambda tile: _tile_links(tile, threshold, shingle), "a binary, b binary, sim double")


def _tile_links(tile: pa.Table, threshold: float, shingle: int) -> pa.Table:
    asks = tile.column("asks").to_numpy(zero_copy_only=False)
    keys, roots = tile.column("key").to_pylist(), tile.column("root").to_pylist()
    texts, values, base = [np.zeros(0, np.int64)], [np.zeros(0, _U)], 0
    for chunk in tile.column("text").chunks:
        for part in K.slices(chunk):
            text, value = K.shingles(part, shingle)
            texts.append(text + part.first + base)
            values.append(value)
        base += len(chunk)
    text, value, weight = weighted(np.concatenate(texts), np.concatenate(values))
    total = np.bincount(text, weights=weight, minlength=len(keys))
    # A shingle that occurs w times is w elements: bags become sets.
    nth = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    text, value = np.repeat(text, weight), K.mix(np.repeat(value, weight) + nth.astype(_U) * _STEP)
    _, column = np.unique(value, return_inverse=True)
    both = np.bincount(column[asks[text]], minlength=column.max(initial=-1) + 1) > 0
    both &= np.bincount(column[~asks[text]], minlength=len(both)) > 0
    some = both[column]
    text, column = text[some], (np.cumsum(both) - 1)[column[some]]
    order = np.argsort(column, kind="stable")
    text, column = text[order], column[order]
    ask, member = np.flatnonzero(asks), np.flatnonzero(~asks)
    place = np.empty(len(keys), dtype=np.int64)
    place[ask], place[member] = np.arange(len(ask)), np.arange(len(member))
    common = np.zeros((len(ask), len(member)), dtype=np.float32)
    for lo in range(0, int(both.sum()), PRODUCT_COLUMNS):
        a, b = np.searchsorted(column, (lo, lo + PRODUCT_COLUMNS))
        t, c, asking = text[a:b], column[a:b] - lo, asks[text[a:b]]
        left, right = (np.zeros((n, PRODUCT_COLUMNS), dtype=np.float32) for n in common.shape)
        left[place[t[asking]], c[asking]] = 1
        right[place[t[~asking]], c[~asking]] = 1
        common += left @ right.T
    sim = common / np.maximum(total[ask][:, None] + total[member] - common, 1)
    # Labels of components; a link between two of them makes one, others add nothing.
    known: dict[bytes, int] = {}
    label = np.array([known.setdefault(r, len(known)) for r in roots], dtype=np.int64)
    rows = []
    for i, own in enumerate(ask):
        near = member[sim[i] >= threshold]
        for other in np.unique(label[near]):
            if other != label[own]:
                at = near[label[near] == other][0]
                rows.append((*sorted((keys[own], keys[at])), float(sim[i, place[at]])))
                label[label == other] = label[own]
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("a", "b", "sim"), columns, (pa.binary(), pa.binary(), pa.float64()))})


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """For each row: ``id_col``, ``key`` of its text, ``class_id`` (the smallest
    id in its class), ``class_size`` in rows, and ``kept``: whether it is the
    one that stands for its class, the first by id and text key."""
    _, roots = _linked(docs, text_col, **options)
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"))
    rooted = rows.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    classes = rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"), F.count("*").alias("class_size"))
    # Written, so that the join can split a class with very many rows.
    classes = written(classes, "classes")
    out = rooted.join(classes, "root")
    kept = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key"))
    return out.select(F.col("id").alias(id_col), "key", F.col("first.id").alias("class_id"), "class_size", kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class; of repeated rows, one stays."""
    key, number, dropped_id, copies = fresh(docs, "key", "number", "dropped_id", "copies")
    classes = near_duplicate_classes(docs, id_col, text_col, **options).select(F.col(id_col).alias(dropped_id), "key", "kept")
    kept = classes.filter("kept").groupBy(dropped_id, F.col("key").alias(number)).agg(F.count("*").alias(copies))
    keyed = docs.withColumn(key, text_key(F.col(text_col)))
    joined = keyed.join(kept, (F.col(key) == F.col(number)) & F.col(id_col).eqNullSafe(F.col(dropped_id)))
    single = joined.filter(F.col(copies) == 1).select(*docs.columns)
    # Rows that share id and text are rare; only they are compared again.
    repeated = joined.filter(F.col(copies) > 1).dropDuplicates([key, dropped_id]).select(*docs.columns)
    return single.unionAll(repeated)
