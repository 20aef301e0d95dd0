"""String functions as Column expressions: all run in the JVM."""

from __future__ import annotations

import json
import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.config import ExtractionSettings

#: Runs of white space as Unicode text has it, but for single spaces, which stay.
_SPACES = r"(?: [\t\n\x0B\f\r\x1c-\x1f\x85\p{Z}]|[\t\n\x0B\f\r\x1c-\x1f\x85\p{Z}&&[^ ]])[\t\n\x0B\f\r\x1c-\x1f\x85\p{Z}]*"
#: ASCII punctuation and white space, to be stripped from both ends.
_EDGE = string.punctuation + " \t\n\r"
#: What counts as part of a word at a boundary.
_WORD = r"[\p{L}\p{N}_]"
#: One lower-case ASCII word: as it is when normalised, and with no boundary inside.
_PLAIN = r"\A[a-z0-9]+\z"
#: Also with low lines inside: as it is when normalised.
_AS_IS = r"\A(?!_)[a-z0-9_]+(?<!_)\z"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it stands in there."""
    return F.transform(F.array(value), use)[0]


def tokens(text: Column) -> Column:
    """ASCII words of four characters or more, lower-cased, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9]{3,}"), F.lit(0))


#: Characters at the beginning of a text in which its first distinct tokens are looked for first.
_HEADS = (256, 1024)


def first_tokens(text: Column, cap: int) -> Column:
    """The first ``cap`` distinct tokens, in order: of the beginning, if that has more than these
    (its last token may be cut), else of all the text."""

    def first(t: Column) -> Column:
        return F.array_distinct(tokens(t))

    def of(heads: tuple[int, ...]) -> Column:
        return let(first(F.substring(text, 1, heads[0])), lambda head: F.when(F.size(head) > cap, head).otherwise(of(heads[1:]))) if heads else first(text)

    return F.slice(of(_HEADS), 1, cap)


def normalize(name: Column) -> Column:
    """Lower case, single spaces, no punctuation at the ends, and without one
    leading article if something follows. Null becomes empty. Twice is not
    once: "the the x" loses an article each time."""
    s = F.regexp_replace(F.lower(F.coalesce(name.cast("string"), F.lit(""))), _SPACES, " ")
    whole = F.trim(F.regexp_replace(F.btrim(s, F.lit(_EDGE)), "^(a|an|the) (?=.)", ""))
    return F.when(name.cast("string").rlike(_AS_IS), name.cast("string")).otherwise(whole)


def is_plain(name: Column) -> Column:
    """One lower-case ASCII word: of two such names that differ, none stands in the other at word boundaries."""
    return name.rlike(_PLAIN)


def words(text: Column) -> Column:
    """Maximal runs of word characters."""
    return F.regexp_extract_all(text, F.lit(f"{_WORD}+"), F.lit(0))


def contains_at_boundary(long: Column, short: Column) -> Column:
    """``short``, not empty, stands in ``long`` with no word character beside it."""
    literal = F.regexp_replace(short, r"([^\p{L}\p{N}_ ])", r"\\$1")
    pattern = F.concat(F.lit(rf"(?<!{_WORD})"), literal, F.lit(rf"(?!{_WORD})"))
    return (short != "") & F.call_function("rlike", long, pattern)


def guarded_containment(a: Column, b: Column, min_chars: int, stopwords: tuple[str, ...]) -> Column:
    """The shorter of a and b (a, of equals) is long enough, no stop-word, and
    contained in the other at word boundaries."""
    a_short = F.length(a) <= F.length(b)
    short, long = F.when(a_short, a).otherwise(b), F.when(a_short, b).otherwise(a)
    # The plain search spares most pairs the pattern.
    return (F.length(short) >= min_chars) & long.contains(short) & ~short.isin(*stopwords) & contains_at_boundary(long, short)


def cosine(a: Column, b: Column) -> Column:
    """Dot product, which is the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def unit(vector: Column) -> Column:
    """The vector divided by its norm; a zero vector stays."""

    def divided(v: Column, norm: Column) -> Column:
        return F.transform(v, lambda x: F.coalesce(F.try_divide(x, norm), x).cast("float"))

    return let(vector, lambda v: let(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x)), lambda norm: divided(v, norm)))


def cache_key(text: Column, settings: ExtractionSettings) -> Column:
    """SHA-256 over the extraction parameters and the text."""
    params = {"chunk_chars": settings.chunk_chars, "cluster": settings.cluster, "model": settings.model, "temperature": settings.temperature, "v": 1}
    return F.sha2(F.concat(F.lit(json.dumps(params, sort_keys=True)), F.char(F.lit(0)), text), 256)


def truthy(flag: Column) -> Column:
    """Flags that come as true, "true", "yes" or 1 in any case."""
    return F.coalesce(F.lower(F.trim(flag.cast("string"))).isin("true", "yes", "1"), F.lit(False))


def composite(eg: Column, rp: Column, alpha: Column | float) -> Column:
    """alpha * eg + (1 - alpha) * rp; eg alone where rp is null; null where eg is."""
    weight = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return F.when(rp.isNull(), eg).otherwise(weight * eg + (1 - weight) * rp)


def risk(eg: Column, rp: Column, alpha: Column | float, impute: float | None = None) -> Column:
    """One minus the composite, or ``impute`` where that is null."""
    h = 1 - composite(eg, rp, alpha)
    return h if impute is None else F.coalesce(h, F.lit(float(impute)))
