"""Quality rules: a ledger of failure bits, judged by versioned policies.

DataFrame operations only, and no shuffle. Every rule is evaluated once per
document. The ledger holds what was measured and one bit for each rule that
fails; a policy is a version with a mask of the rules it applies, so changing
the policy, or asking what a rule costs, reads the ledger and not the texts. A
stored ledger names the version of the rules that filled it, and is refused
when these have changed; each judgement names its policy.

Nulls and odd input: a null text has no words and fails the rule on length.
Each row is judged by itself: repeated rows get the same result. An empty
table gives an empty ledger. Other columns pass through ``keep_passing``.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import fresh

WINDOW = 8

#: Measurements, in order.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")

#: Rules by bit: name and the condition under which a document fails, over the measurements.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 5 * word_chars"),
    ("shouting", "100 * n_upper > 30 * n_letters"),
    ("repeated_lines", "100 * n_dup_lines > 60 * n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
)
#: Changes with ``RULES`` or with how a measurement is made.
RULES_VERSION = 1
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {name: 1 << i for i, (name, _) in enumerate(RULES)}
        return sum(bits[name] for name in self.rules)


POLICIES: Mapping[int, Policy] = {p.version: p for p in (Policy(1, BASE), Policy(2, tuple(name for name, _ in RULES)))}
CURRENT = POLICIES[2]


def _shifted(array: Column, by: int) -> Column:
    return F.slice(array, by + 1, F.greatest(F.size(array) - by, F.lit(0)))


def _pairs(array: Column, by: int) -> Column:
    """Hashes of (entry, entry ``by`` further), without the last ``by`` entries."""
    both = F.zip_with(array, _shifted(array, by), lambda a, b: F.xxhash64(a, b))
    return F.slice(both, 1, F.greatest(F.size(array) - by, F.lit(0)))


def _places(ordered: Column) -> Column:
    """In order, the windows whose hash occurs twice or more, from sorted (hash, place)."""
    twins = F.zip_with(ordered, _shifted(ordered, 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    return F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))


def _covered(places: Column) -> Column:
    """Words inside windows at these places."""
    gaps = F.zip_with(places, _shifted(places, 1), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    return F.aggregate(gaps, F.lit(0), lambda total, x: total + x)


def measure(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with a column for each of ``MEASURES``; returns their names too.

    What is used more than once has a column of its own, as arguments of
    higher-order functions are worked out again for each use.
    """
    steps = ("text0", "words", "lines_with_words", "hash1", "hash2", "hash4", "hash8", "ordered", "places", "bare", "rest")
    names = dict(zip((*MEASURES, *steps), fresh(docs, *MEASURES, *steps)))
    n = names.__getitem__
    c = lambda name: F.col(n(name))
    df = docs.withColumn(n("text0"), F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumn(n("words"), F.filter(F.split(c("text0"), r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    df = df.withColumn(n("lines_with_words"), F.filter(F.split(c("text0"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn(n("hash1"), F.transform(c("words"), lambda x: F.xxhash64(x)))
    df = df.withColumn(n("hash2"), _pairs(c("hash1"), 1))
    df = df.withColumn(n("hash4"), _pairs(c("hash2"), 2))
    df = df.withColumn(n("hash8"), _pairs(c("hash4"), 4))
    # Sorted only if needed: most texts repeat nothing.
    repeats = F.size(F.array_distinct(c("hash8"))) < F.size(c("hash8"))
    placed = F.transform(c("hash8"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn(n("ordered"), F.when(repeats, F.sort_array(placed)))
    df = df.withColumn(n("places"), _places(c("ordered")))
    df = df.withColumn(n("bare"), F.array_join(c("words"), ""))
    df = df.withColumn(n("rest"), F.regexp_replace(c("bare"), "[A-Za-z]+", ""))
    df = df.withColumns(
        {
            n("n_words"): F.size(c("words")).cast("long"),
            n("word_chars"): F.length(c("bare")).cast("long"),
            n("n_symbols"): (F.length(c("rest")) - F.length(F.regexp_replace(c("rest"), r"[#*$%&|<>]+", ""))).cast("long"),
            n("n_dup_lines"): (F.size(c("lines_with_words")) - F.size(F.array_distinct(c("lines_with_words")))).cast("long"),
            n("n_repeat_words"): F.coalesce(_covered(c("places")), F.lit(0)).cast("long"),
            n("n_lines"): F.size(c("lines_with_words")).cast("long"),
            n("n_upper"): (F.length(c("bare")) - F.length(F.regexp_replace(c("bare"), "[A-Z]+", ""))).cast("long"),
            n("n_letters"): (F.length(c("bare")) - F.length(c("rest"))).cast("long"),
        }
    )
    return df.select(*docs.columns, *(n(m) for m in MEASURES)), {m: n(m) for m in MEASURES}


def failure_bits(names: Mapping[str, str]) -> Column:
    """One bit for each failed rule, given the measurements' column names."""
    total = F.lit(0).cast("long")
    for i, (_, condition) in enumerate(RULES):
        condition = re.sub(r"\b(" + "|".join(MEASURES) + r")\b", lambda m: f"`{names[m[1]]}`", condition)
        total = total.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return total


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the measurements and ``failed``, the bits of the failed rules."""
    narrow = docs.select(F.col(id_col).alias("ledger_id"), F.col(text_col).alias("ledger_text"))
    measured, names = measure(narrow, "ledger_text")
    return measured.select(F.col("ledger_id").alias(id_col), *MEASURES, failure_bits(names).alias("failed"))


def write_ledger(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Store the ledger of ``docs``, with the version of the rules."""
    ledger(docs, id_col, text_col).withColumn("rules_version", F.lit(RULES_VERSION)).write.parquet(f"{path}/rules={RULES_VERSION}")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A stored ledger; an error if it was filled by other rules than these."""
    return spark.read.parquet(f"{path}/rules={RULES_VERSION}")


def passes(failed: Column, policy: Policy = CURRENT) -> Column:
    return failed.bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablation(records: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """What each rule of a policy costs: documents that fail it, and documents
    that fail nothing else. One pass over the ledger; rows per distinct bits."""
    mask = F.lit(policy.mask).cast("long")
    sets = records.groupBy(F.col("failed").bitwiseAND(mask).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (name, _) in enumerate(RULES) if name in policy.rules))
    each = sets.select("bits", "n", F.explode(rules).alias("r")).select(F.lit(policy.version).alias("policy"), "bits", "n", "r.rule", "r.bit")
    return each.groupBy("policy", "rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_fail"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def keep_passing(docs: DataFrame, policy: Policy = CURRENT, text_col: str = "text") -> DataFrame:
    """The documents that pass a policy, with the columns they came with."""
    measured, names = measure(docs, text_col)
    (failed,) = fresh(measured, "failed")
    # Exploding an array of one keeps the filter above: pushed below, it would
    # work out every measurement again for each use.
    judged = measured.select(*docs.columns, F.explode(F.array(failure_bits(names))).alias(failed))
    return judged.filter(passes(F.col(failed), policy)).select(*docs.columns)
