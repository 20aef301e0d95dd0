"""URL filter: rules in a sorted digest array, probed by binary search.

An index holds one entry for each rule ``host/path``: its 64-bit xxhash,
sorted, and the full string. Spark broadcasts it; each Python worker writes it
once to an unlinked file of its own, memory-maps that, and keeps the map for its
tasks. A rule's *shape* is how many labels its host and how many characters its
path has. A url's candidate keys are one for each shape that some rule has: so
many of the last labels of its host, with so much of its path. They are hashed
and sought in the digests for a whole batch at once; each hit is confirmed on
the stored string. Long hosts and paths thus cost no more than the rules' shapes.

Of the rules that fit, the one with the most characters ``host/path`` wins, of
two as long the greater string (by code points, as Spark compares them), and of
a rule that is given with both verdicts, ``block``.

The index is built on the driver from a list whose size is checked against
``MAX_RULES`` and ``MAX_BYTES``; ``join_rules`` is the way for more: the same
candidate keys as an equi-join with a table of rules, of any size, with the same
result. ``apply_rule_table`` takes a table of rules and goes the way that its
size allows.

Nulls and odd input: a null url or one without ``://`` has empty host and
path, fits no rule and is allowed. Repeated rows each get a result row. An
empty table gives an empty result. Columns other than the two named ones are
not looked at.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import LOWER, UPPER

#: Entries an index may have: 8 bytes of digest and the string for each, on the driver and on disk.
MAX_RULES = 5_000_000
#: Bytes that the strings of an index may have.
MAX_BYTES = 256 << 20


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @classmethod
    def parse(cls, verdict: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(verdict, host, slash + path)


#: What the contract's query applies.
CONTRACT_RULES = tuple(Rule.parse(*x) for x in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def build_index(rules: Iterable[Rule]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted digests; string start, string end, shape (two numbers) and verdict of each; the strings."""
    by_text: dict[str, Rule] = {}
    for r in rules:
        if r.text not in by_text or r.verdict == "block":
            by_text[r.text] = r
    rules = list(by_text.values())
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; an index takes {MAX_RULES}: use join_rules")
    keys = [r.text.encode() for r in rules]
    if sum(map(len, keys)) > MAX_BYTES:
        raise ValueError(f"rules of more than {MAX_BYTES} bytes: use join_rules")
    digests = np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64)
    order = np.argsort(digests, kind="stable")
    ends = np.cumsum([len(keys[i]) for i in order], dtype=np.int64)
    spans = np.array([(end - len(keys[i]), end, rules[i].host.count(".") + 1, len(rules[i].path), rules[i].verdict == "block") for i, end in zip(order, ends)], dtype=np.int64)
    return digests[order], spans.reshape(-1, 5), np.frombuffer(b"".join(keys[i] for i in order), dtype=np.uint8)


def _mapped(array: np.ndarray) -> np.ndarray:
    """A read-only map of the array's bytes in a file that is already unlinked,
    so that it leaves nothing behind and its pages can be dropped."""
    if not array.size:
        return array
    with tempfile.TemporaryFile() as f:
        array.tofile(f)
        f.flush()
        return np.memmap(f, dtype=array.dtype, mode="r", shape=array.shape)


class Index:
    """Memory-mapped digests with their strings."""

    def __init__(self, arrays: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.digests, self.spans, self.strings = map(_mapped, arrays)
        self.shapes = sorted(set(map(tuple, self.spans[:, 2:4].tolist())))

    def probe(self, keys: list[bytes]) -> np.ndarray:
        """Row of the entry equal to each key, or -1."""
        digests = np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64)
        found = np.full(len(keys), -1, dtype=np.int64)
        if not len(self.digests):
            return found
        at = np.searchsorted(self.digests, digests)
        hits = np.flatnonzero((at < len(self.digests)) & (self.digests[np.minimum(at, len(self.digests) - 1)] == digests))
        for i in hits:  # few: confirm against the stored string; equal digests stand together
            row = int(at[i])
            while row < len(self.digests) and self.digests[row] == digests[i]:
                lo, hi = self.spans[row, :2]
                if self.strings[lo:hi].tobytes() == keys[i]:
                    found[i] = row
                    break
                row += 1
        return found


#: Maps that a worker keeps.
KEPT_MAPS = 4
_maps: dict[str, Index] = {}


def _index(name: str, sent: Broadcast) -> Index:
    """The index of a name, mapped once in each worker."""
    if name not in _maps:
        while len(_maps) >= KEPT_MAPS:
            _maps.pop(next(iter(_maps)))
        _maps[name] = Index(sent.value)
    return _maps[name]


def candidate_keys(host: str, path: str, shapes: list[tuple[int, int]]) -> list[str]:
    """Rule strings that would fit, one for each shape that some rule has and the url is long enough for."""
    if not host or not shapes:
        return []
    most = shapes[-1][0]
    tail = host.rsplit(".", most)  # its first part is what no rule's host can reach
    n = len(tail) - (len(tail) > most)
    tail = tail[len(tail) - n :]
    return [".".join(tail[n - labels :]) + path[:size] for labels, size in shapes if labels <= n and size <= len(path)]


def block_list(rules: Iterable[Rule]) -> tuple[Rule, ...]:
    """Rules that all block, for ``otherwise``."""
    return tuple(r._replace(verdict="block") for r in rules)


def apply_rules(urls: DataFrame, rules: Iterable[Rule], otherwise: Iterable[Rule] = (), default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col``, host, path, the longest fitting rule (or null) and the verdict of each url.

    A url that no rule fits is judged by
    ``otherwise``, lists of the filter's own, in the same way but with a null
    rule; one that those don't fit either gets ``default``.
    """
    spark = urls.sparkSession
    lists = [(uuid.uuid4().hex, spark.sparkContext.broadcast(build_index(own))) for own in (rules, otherwise)]
    host, path = host_and_path(F.col(url_col))
    parsed = urls.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))

    def longest(index: Index, hosts: list[str], texts: list[str]) -> tuple[list[str | None], list[str | None]]:
        keys: list[str] = []
        owner: list[int] = []
        for i, (h, p) in enumerate(zip(hosts, texts)):
            own = candidate_keys(h, p, index.shapes)
            keys += own
            owner += [i] * len(own)
        best: list[str | None] = [None] * len(hosts)
        verdict: list[str | None] = [None] * len(hosts)
        found = index.probe([k.encode() for k in keys])
        for k in np.flatnonzero(found >= 0):
            i = owner[k]
            if best[i] is None or (len(keys[k]), keys[k]) > (len(best[i]), best[i]):
                best[i] = keys[k]
                verdict[i] = "block" if index.spans[found[k], 4] else "allow"
        return best, verdict

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = (_index(*x) for x in lists)
        for batch in batches:
            hosts, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            best, verdict = longest(first, hosts, texts)
            _, own = longest(second, hosts, texts)
            final = pa.array([v or o or default for v, o in zip(verdict, own)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), final], [*batch.schema.names, "rule", "verdict"])

    schema = T.StructType([*parsed.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    return parsed.mapInArrow(judge, schema).withColumnRenamed("id", id_col)


def join_rules(urls: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """As ``apply_rules``, for rules in a table (verdict, host, path) of any size.

    Candidate keys meet the rules in an equi-join; only urls with a hit are
    grouped, by their own columns. The shapes of the rules are one row.
    """
    host, path = host_and_path(F.col(url_col))
    parsed = urls.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))

    def labels(c: str) -> Column:
        return F.length(c) - F.length(F.replace(F.col(c), F.lit("."), F.lit(""))) + 1

    known = rules.select(F.concat("host", "path").alias("rule"), labels("host").alias("labels"), F.length("path").alias("size"), "verdict")
    shapes = known.agg(F.collect_set(F.struct("labels", "size")).alias("shapes"))
    own = parsed.filter("host <> ''").distinct().join(shapes).withColumn("n", labels("host"))
    fits = F.filter("shapes", lambda s: (s["labels"] <= F.col("n")) & (s["size"] <= F.length("path")))
    keys = own.select("host", "path", F.explode(fits).alias("s")).withColumn("rule", F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -F.col("s.labels")), F.substring("path", F.lit(1), F.col("s.size"))))
    hit = keys.select("host", "path", "rule").join(known.select("rule", F.col("verdict").alias("rule_verdict")), "rule")
    # The longest, then the greatest; block comes after allow.
    best = hit.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "rule_verdict")).alias("best"))
    out = parsed.join(best, ["host", "path"], "left")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))


def apply_rule_table(urls: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """As ``apply_rules``, for rules in a table (verdict, host, path): by an index
    if the table is within its bounds, else by ``join_rules``. Rules without a
    host are skipped, and a null path is none."""
    known = rules.select("verdict", "host", F.coalesce("path", F.lit("")).alias("path")).filter("host <> '' and verdict is not null")
    n, size = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path")), F.lit(0))).first()
    if n > MAX_RULES or size > MAX_BYTES:
        return join_rules(urls, known, default, id_col, url_col)
    return apply_rules(urls, (Rule(*r) for r in known.collect()), default=default, id_col=id_col, url_col=url_col)
