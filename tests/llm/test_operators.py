"""The ten operators against brute force, and on nulls, ties, long and empty texts."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, html_text, kernel, line_dedup, minhash, mixing, quality, sharding, suffix_dedup, token_output, url_filter
from plumbline.llm.common import shared_folder
from plumbline.llm.queries import VOCABULARY

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, key string, n_words int"


def words(rng, n, vocabulary=2000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    base = words(rng, 120)
    rows = [base, base, base.replace("w1", "v1", 2), " ".join(base.split()[:60]) + " " + words(rng, 60), None, "", "", "   \t", "one two", "One TWO", "Ünï cödé ßtraße " * 3, "same line\n" * 30]
    rows += [words(rng, rng.randrange(1, 80)) + "\n  Shared LINE \n" + words(rng, 5) for _ in range(12)]
    rows += [words(rng, 5000, 50), "x" * 3000, "ab" * 400]
    out = [(i, t) for i, t in enumerate(rows)]
    return [*out, out[3], (None, "null id text here"), (None, base)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "k", 7) for i, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- kernel -------------------------------------------------------------------


def test_words_are_the_patterns_words(texts):
    column = pa.array([t for _, t in texts])
    for table, pattern in ((kernel.NOT_SPACE, r"[^\x20\x09-\x0D]+"), (kernel.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        for limit in (64, 1 << 20):
            got = []
            for part in kernel.slices(column, limit):
                data = kernel.lower_ascii(part.data)
                starts, ends, first = kernel.words(data, part.offsets, table)
                got += [[data[s:e].tobytes().decode() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(first, first[1:])]
            assert got == [re.findall(pattern, (t or "").translate(LOWER)) for _, t in texts]


# -- 1 HTML -------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &lt;text&gt;  here", "plain <text> here"),
        ("<p>a<p>b<div>c</div>d", "a\n\nb\n\nc\nd"),
        ("<head><title>T</title><style>x</style><body>a<script>var t='</p>'</script><!-- c --> b", "a b"),
        ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>e", "- a\n- b\n  3. c\n  4. d\n\ne"),
        ("<table><tr><th>Name<th>N<tr><td>long name<td>1</table>", "Name       N\nlong name  1"),
        ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"),
        ("<p hidden>x</p><p style='display: none'>y</p><p>z", "z"),
        ("<pre>\n a\n  b</pre>c", " a\n  b\n\nc"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("x</p></div>y<b><i>z", "xyz"),
        ("a <!-- never closed", "a"),
    ],
)
def test_rendering(page, text):
    assert html_text.render(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<a href='it's'>link</a> <b c='d'e=\"f>\">g</b>", "link g"),
        ("<p a=b/>x<p =c>y<p d = 'e' f>z", "x\n\ny\n\nz"),
        ("a <b unclosed='x> y</b> z", "a"),
        ("1 < 2 <3> 4 </5> <é>", "1 < 2 <3> 4 </5> <é>"),
        ("<div style='visibility:hidden'>a <b style='visibility: visible'>b</b> c<ul><li>d</ul></div>e", "b\n\ne"),
        ("<div style='display:none'>a <b style='visibility:visible'>b</b></div>e", "e"),
        ("<ol><li value=7>a<li>b<li value=x>c</ol>", "7. a\n8. b\n9. c"),
        ("<ol reversed><li>a<ol><li>in<li>in</ol><li>b<li>c</ol>", "3. a\n   1. in\n   2. in\n2. b\n1. c"),
        ("<ol reversed start=10><li>a<li>b</ol>", "10. a\n9. b"),
        ("<table><tr><td>漢字<td>a<tr><td>abcde<td>b<tr><td>e\u0301e<td>c</table>", "漢字   a\nabcde  b\ne\u0301e     c"),
        ("<table><tr><td>a<td><td>c<tr><td colspan=2>wide cell<td>d</table>", "a            c\nwide cell    d"),
        ("<details><summary>s</summary>body</details>", "s\nbody"),
    ],
)
def test_tags_and_rules(page, text):
    assert html_text.render(page) == text


@pytest.mark.parametrize(
    "page",
    [
        "<div><b>" * 120_000 + "deep",
        "deep" + "</i>" * 250_000,
        "deep" + '<a href="x ' * 90_000,
        "deep<!-- " * 100_000,
        "deep<script></script " * 50_000,
        "<blockquote>deep" * 60_000,
        "<table><tr><td>" * 60_000 + "deep " * 20_000,
        "<table>" + "<tr><td colspan=1000 rowspan=1000>deep" * 20_000,
        "<table><tr><td>" + "deep" * 70_000 + "<td>b" + "<tr><td>a<td>b" * 40_000,
        "<select>" * 100_000 + "</select>deep",
        "deep <" + "<" * 1_000_000,
        "<svg><g>" * 60_000 + "<p>deep" * 40_000,
        "<ol reversed><li>deep" * 40_000,
    ],
)
def test_hostile_pages_take_no_longer_than_others(page):
    began = time.process_time()
    text = html_text.render(page)
    assert text.count("deep") == page.count("deep") or "<!--" in page or "<script" in page
    assert time.process_time() - began < 30 and len(text) < 20 * len(page)


def test_all_visible_words_come_out(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    for r in pages.collect():
        body = re.sub(r"(?s)<!--.*?-->|<(script|style|head)\b.*?</\1>", " ", r.html)
        assert got[r.page_id].replace("- ", " ").split() == [w for w in html_text.html.unescape(re.sub(r"<[^>]*>", " ", body)).replace("- ", " ").split()]


# -- 2 MinHash ----------------------------------------------------------------


def bag(text):
    w = (text or "").translate(LOWER)
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    return Counter([tuple(w)] if 0 < len(w) < 5 else (tuple(w[i : i + 5]) for i in range(len(w) - 4)))


def similarity(a, b):
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common) if a and b else 0.0


def brute_classes(rows):
    bags, parent = [bag(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or similarity(bags[i], bags[j]) >= 0.8:
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        groups[find(i)].append(doc)
    return sorted((min((d for d in g if d is not None), default=None), len(g), d) for g in groups.values() for d in g if d is not None)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    errors = []
    for trial in range(30):
        element = kernel.mix(np.arange(60, dtype=np.uint64) + np.uint64(trial * 1000))
        a = rng.integers(0, 9, 60)
        b = np.where(rng.random(60) < 0.5, a, rng.integers(0, 40, 60))
        text = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        s = minhash.bag_minhash(text, np.concatenate([element[a > 0], element[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 1000)
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.02


def test_near_duplicates_are_those_of_brute_force(docs, texts):
    got = minhash.near_duplicate_classes(docs).collect()
    assert sorted((r.class_id, r.class_size, r.doc_id) for r in got if r.doc_id is not None) == brute_classes(texts)
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and sorted(i for i in ids if i is not None) == sorted({c for c, _, _ in brute_classes(texts)})


def test_large_family_of_near_copies_loses_no_link(spark):
    rng = random.Random(2)
    base = words(rng, 150).split()
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randrange(0, 7)):
            copy[rng.randrange(150)] = f"edit{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    got = minhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.class_id, r.class_size, r.doc_id) for r in got) == brute_classes(rows)


def test_near_duplicates_of_the_given_table(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = minhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.class_id, r.class_size, r.doc_id) for r in got) == brute_classes(rows)


def test_words_of_two_letters_do_not_collide():
    """Words that any polynomial modulo a power of two takes for equal."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    a, b = ("".join("xy"[x ^ flip] for x in bits) for flip in (0, 1))
    tail = " one two three four five"
    assert minhash.overlap(pa.array([a + tail, a]), pa.array([b + tail, a]), 5).tolist() == [1 / 3, 1.0]
    assert minhash.overlap(pa.array([], pa.string()), pa.array([], pa.string()), 5).tolist() == []


def test_near_dedup_of_nothing(empty):
    assert minhash.near_duplicate_classes(empty).count() == 0


# -- 3 decontamination --------------------------------------------------------


def brute_hits(rows, items):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    out = []
    for doc, text in rows:
        w = find((text or "").translate(LOWER))
        hit, its = set(), set()
        for item, t in items:
            q = find((t or "").translate(LOWER))
            n = min(10, len(q))
            grams = {tuple(q[i : i + n]) for i in range(len(q) - n + 1)} if n and item is not None else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    its.add(str(item))
        out.append((doc, len(w), len(hit), sorted(its)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_hits_are_those_of_brute_force(spark, docs, texts, block_bytes):
    base = texts[0][1].split()
    items = [(1, " ".join(base[5:25]).upper() + "!"), (2, "one, two"), (3, ""), (4, None), (10, " ".join(base[20:40])), (None, "one two"), (2, "one, two"), (5, " ".join(base[:10]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found, (n_words, lo, hi, its) = decontaminate.find_hits(docs, bench, block_bytes=block_bytes)
    got = [(r.doc_id, r[n_words], sum(b - a for a, b in zip(r[lo], r[hi])), r[its]) for r in found.collect()]
    assert sorted(got, key=repr) == brute_hits(texts, items)
    clean = decontaminate.remove_documents(docs, bench, block_bytes=block_bytes)
    assert clean.columns == docs.columns and clean.count() == sum(not h for _, _, h, _ in brute_hits(texts, items))
    again, names = decontaminate.find_hits(decontaminate.remove_spans(docs, bench), bench)
    assert again.count() == len(texts)


def test_long_items_are_cut_in_pieces(spark, monkeypatch):
    """A benchmark that is no block: an item of many pieces, passages across their ends, items with one gram."""
    rng = random.Random(8)
    long = words(rng, 3000, 5000)
    own = long.split()
    assert all(any(a <= len(" ".join(own[:i]) + " ") and len(" ".join(own[: i + 10])) <= b for a, b in decontaminate._pieces(np.frombuffer(long.encode(), dtype=np.uint8), 10, 700)) for i in range(1, len(own) - 10))
    wide = b"w" * 5000 + b" " + b"v" * 3000 + b" a b"
    assert list(decontaminate._pieces(np.frombuffer(wide, dtype=np.uint8), 10, 100)) == [(0, len(wide))] and list(decontaminate._pieces(np.zeros(0, dtype=np.uint8), 10, 100)) == []
    items = [(7, long), (8, " ".join(own[200:215])), (9, "zero"), (11, long.upper())]
    rows = [(i, words(rng, 30) + " " + " ".join(own[p : p + 12]) + " " + words(rng, 9)) for i, p in enumerate(range(0, 2900, 60))] + [(90, "zero"), (91, long), (92, long), (93, None)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate.grams, "__defaults__", (700,))
    found, (n_words, lo, hi, its) = decontaminate.find_hits(docs, bench, block_bytes=1000)
    got = [(r.doc_id, r[n_words], sum(b - a for a, b in zip(r[lo], r[hi])), r[its]) for r in found.collect()]
    assert sorted(got, key=repr) == brute_hits(rows, items)


def test_decontamination_of_and_by_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.remove_documents(docs, none).count() == docs.count()
    assert decontaminate.remove_documents(empty, none).count() == 0


# -- 4 lines ------------------------------------------------------------------


def test_lines_are_those_of_brute_force(docs, texts, empty):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    seen = Counter(k for _, t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    expected = []
    for doc, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if seen[key(x)] < 10]
        expected.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = [tuple(r) for r in line_dedup.drop_common_lines(docs, min_docs=10).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr) and any(d for _, _, d, _ in expected)
    assert line_dedup.drop_common_lines(empty).count() == 0


# -- 5 sharding ---------------------------------------------------------------


def test_store_keeps_every_row_and_versions(spark, docs, empty):
    store = sharding.ShardStore(spark, shared_folder(spark, "store"), target_bytes=1 << 20)
    assert store.append(docs, rows=4) == 1
    first = store.manifest().count()
    version = store.compact()
    assert version > 1 and store.manifest().count() < first
    rows = sorted(map(repr, docs.collect()))
    assert sorted(map(repr, store.read().collect())) == rows == sorted(map(repr, store.read(1).collect()))
    placed = store.read(places=True)
    assert placed.select("shard", "place").distinct().count() == len(rows)
    assert store.compact() == version
    store.append(empty)
    assert not store._commit(version, store.manifest(), docs.schema)
    store.vacuum()
    assert sorted(map(repr, store.read().collect())) == rows


@pytest.fixture
def numbers(spark):
    return lambda a, b: spark.range(a, b).selectExpr("id AS doc_id", "id AS run", "repeat('x', 10) AS path", "id AS row", "id AS n0")


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_tiers_over_generations(spark, numbers):
    """Small arrivals become larger shards, and these larger ones, until they are full; clashing names are kept."""
    store = sharding.ShardStore(spark, shared_folder(spark, "tiers"), target_bytes=40_000)
    total, tiers = 0, set()
    for size in [50] * 4 + [600] * 3 + [3000] * 3:
        store.append(numbers(total, total + size).repartition(2), rows=10_000)
        total += size
        store.compact()
        tiers |= {r.tier for r in store.manifest().collect()}
        small = [r.n for r in store.manifest().filter("tier >= 0").groupBy("tier").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).filter("b < 40000").collect()]
        assert set(small) <= {1}
    assert len(tiers) >= 3
    assert ids(store.read()) == list(range(total)) and store.read().columns == ["doc_id", "run", "path", "row", "n0"]
    assert ids(store.read(1)) == list(range(50))


def test_a_crash_within_a_commit_leaves_the_store_whole(spark, numbers, monkeypatch):
    store = sharding.ShardStore(spark, shared_folder(spark, "crash"))
    store.append(numbers(0, 0).select("*"))
    store.append(numbers(0, 5))
    rename = sharding.ShardStore._at

    def crash(self, path):
        if path.endswith("/commits/3"):
            raise KeyboardInterrupt
        return rename(self, path)

    monkeypatch.setattr(sharding.ShardStore, "_at", crash)
    with pytest.raises(KeyboardInterrupt):
        store.append(numbers(5, 9))
    monkeypatch.undo()
    assert store.versions() == [1, 2] and ids(store.read()) == list(range(5))
    assert store.append(numbers(5, 7)) == 3 and ids(store.read()) == list(range(7))


def test_writers_that_come_second_start_again(spark, numbers, monkeypatch):
    path = shared_folder(spark, "writers")
    store, other = (sharding.ShardStore(spark, path, target_bytes=1 << 20) for _ in range(2))
    store.append(numbers(0, 10).repartition(3))
    listed, before = sharding.ShardStore._listed, []

    def then(act):
        """Another writer commits while ours has written its shards."""

        def late(self, *args):
            out = listed(self, *args)
            if self is store and not before:
                before.append(True)
                act()
            return out

        before.clear()
        monkeypatch.setattr(sharding.ShardStore, "_listed", late)

    then(lambda: other.append(numbers(10, 15)))
    assert store.append(numbers(15, 20)) == 3 and ids(store.read()) == list(range(20))
    then(lambda: other.append(numbers(20, 25)))
    store.compact()
    assert ids(store.read()) == list(range(25))
    store.append(numbers(25, 30).repartition(3))
    then(lambda: other.compact())  # merges what ours was about to replace
    store.compact()
    assert ids(store.read()) == list(range(30))
    then(lambda: other.vacuum())  # while an append is under way
    store.append(numbers(30, 33))
    assert ids(store.read()) == list(range(33))
    monkeypatch.undo()
    store.vacuum()
    assert ids(store.read()) == list(range(33))


# -- 6 quality ----------------------------------------------------------------


def test_measures_are_those_of_brute_force(docs, texts, empty):
    expected = []
    for doc, t in texts:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {p for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expected.append((doc, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)))
    records = quality.ledger(docs)
    got = [tuple(r)[:6] for r in records.collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    kept = quality.keep_passing(docs)
    assert kept.columns == docs.columns
    assert kept.count() == records.filter(quality.passes(F.col("failed"))).count() < len(texts)
    assert quality.keep_passing(empty).count() == 0
    costs = {r.rule: (r.n_fail, r.n_only) for r in quality.ablation(records).collect()}
    bits = [r.failed for r in records.collect()]
    assert costs["few_words"] == (sum(b & 1 for b in bits), sum(b == 1 for b in bits))


# -- 7 suffix arrays ----------------------------------------------------------


def test_factor_arrays_are_those_of_brute_force():
    rng = random.Random(4)
    for alphabet in ("ab", "abcde"):
        s = "".join(rng.choice(alphabet) for _ in range(150))

        def lcp(i, j):
            n = 0
            while i + n < len(s) and j + n < len(s) and s[i + n] == s[j + n]:
                n += 1
            return n

        order = sorted(range(len(s)), key=lambda i: s[i:])
        prefix = np.array([0, *(lcp(i, j) for i, j in zip(order, order[1:]))])
        earlier, later = suffix_dedup.longest_factors(np.array(order), prefix)
        for place, i in enumerate(order):
            assert earlier[place] == max((lcp(i, j) for j in range(i)), default=0)
            assert later[place] == max((lcp(i, j) for j in range(i + 1, len(s))), default=0)


@pytest.mark.parametrize("keep", ["none", "first"])
def test_passages_of_contexts_are_those_of_brute_force(keep):
    """Contexts of any left and right reach around their anchors, with zero bytes."""
    rng, length = random.Random(5), 12
    for _ in range(60):
        raws, leads, seen, expected = [], [], defaultdict(list), []
        for _ in range(rng.randint(1, 25)):
            lead = rng.randint(0, length - 4)
            right = rng.randint(1, lead + 1) + length - lead - 5
            raws.append(bytes(rng.choices(b"ab\0", k=lead)) + b"ANCH" + bytes(rng.choices(b"ab\0", k=right)))
            leads.append(lead)
        places = [(i, k) for i, b in enumerate(raws) for k in range(len(b) - length + 1)]
        for i, k in places:
            seen[raws[i][k : k + length]].append((i, k))
        for i, k in places:
            same = seen[raws[i][k : k + length]]
            expected.append(len(same) > 1 if keep == "none" else (i, k) > min(same))
        got, first = suffix_dedup.repeated_passages(raws, leads, length, keep)
        assert got.tolist() == expected
        for i, runs in enumerate(suffix_dedup._ranges(got, first).to_pylist()):
            assert sorted(first[i] + x for r in runs for x in range(r["lo"], r["hi"])) == [x for x in range(first[i], first[i + 1]) if expected[x]]


def brute_passages(rows, keep="none", length=200):
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of (id, text) rows."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = defaultdict(list)
    for n, (who, t) in enumerate(raw):
        for s in range(len(t) - length + 1):
            seen[t[s : s + length]].append((who if keep == "first" else n, s))
    out = []
    for n, (who, t) in enumerate(raw):
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            places = seen[t[s : s + length]]
            if len(places) > 1 if keep == "none" else (who, s) > min(places):
                gone[s : s + length] = b"\1" * length
        spans = sum(g > p for p, g in zip(b"\0" + gone, gone))
        out.append((who, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def spark_passages(docs, keep="none", **options):
    cut = suffix_dedup.cut_repeats(docs, 200, keep, **options)
    removed = F.col("n_bytes") - F.length("kept")
    found = suffix_dedup.row_keys(docs, keep).join(cut, "row").select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("lo").alias("n_spans"), F.sha2("kept", 256).alias("sha"))
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("max_contexts", [2000, 1])
def test_passages_are_those_of_brute_force(spark, texts, keep, max_contexts):
    rows = list(dict.fromkeys((i, t) for i, t in texts if i is not None)) if keep == "first" else texts
    docs = spark.createDataFrame([(i, t, "k", 7) for i, t in rows], SCHEMA).repartition(3)
    assert spark_passages(docs, keep, max_contexts=max_contexts) == brute_passages(rows, keep)


@pytest.mark.parametrize("keep", ["none", "first"])
def test_hot_anchors_are_split(spark, keep):
    """A line in every text, with few continuations on either side, is in very many different contexts."""
    rng = random.Random(8)
    line = " ".join(words(rng, 14, 9) for _ in range(2))[:100]
    sides = [words(rng, 40) for _ in range(12)]
    rows = [(i, f"{rng.choice(sides)[-rng.randrange(20, 180):]} {line} {rng.choice(sides)[: rng.randrange(20, 180)]}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.catalog.listTables()
    assert spark_passages(docs, keep, max_contexts=3) == brute_passages(rows, keep)
    assert spark.catalog.listTables() == before


# -- 8 mixing -----------------------------------------------------------------


def earliest_deadline_first(blocks, weights):
    """The schedule in exact fractions, slot by slot, as the definition has it."""
    exact = [Fraction(w) for w in weights]

    def passed(v):
        return sum(min(w * v, n) for w, n in zip(exact, blocks))

    windows = {(s, i): (math.floor(passed(i / exact[s])), math.ceil(passed((i + 1) / exact[s]))) for s, n in enumerate(blocks) for i in range(n)}
    out, done = [], [0] * len(blocks)
    for slot in range(sum(blocks)):
        ready = [(windows[s, done[s]][1], s, done[s]) for s, n in enumerate(blocks) if done[s] < n and windows[s, done[s]][0] <= slot]
        due, s, i = min(ready)
        assert due > slot
        done[s] += 1
        out.append((s, i))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_schedule_is_earliest_deadline_first(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 7)
    blocks = [rng.choice([0, 1, 3, 17, 60]) for _ in range(n)]
    weights = [rng.choice([0.1, 0.25, 1.0, 3.7, 10.0, 1e-3]) for _ in range(n)]
    assert list(mixing.schedule(blocks, weights)) == earliest_deadline_first(blocks, weights)


def test_schedule_is_less_than_a_block_off():
    weights = (50, 20, 9, 9, 5, 3, 2, 1, 1)
    order = [s for s, _ in mixing.schedule([10 * w for w in weights], weights)]
    for s, w in enumerate(weights):
        had = 0
        for t, x in enumerate(order, 1):
            had += x == s
            assert abs(had - t * w / 100) < 1


@pytest.mark.parametrize("bad", [0, -1, float("nan"), float("inf")])
def test_weights_have_to_be_above_zero(spark, bad):
    docs = spark.createDataFrame([(1, "x", "a"), (2, "y", "b")], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="above zero"):
        mixing.mixture_order(docs, {"a": 1.0, "b": bad})


def test_order_follows_the_weights(spark):
    rows = [(i, "x" * 10, "big" if i % 10 else ("small" if i % 20 else None)) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {"big": 0.5, "small": 0.25, None: 0.25}
    placed = mixing.mixture_order(docs, weights, block_chars=100).collect()
    assert len(placed) == 4000 and len({(r.slot, r["at"]) for r in placed}) == 4000
    slots = {r.slot: r.source for r in placed}
    for t in range(1, 80):  # before the small ones run out
        assert abs(sum(slots[s] == "big" for s in range(t)) - t / 2) <= 1 and abs(sum(slots[s] == "small" for s in range(t)) - t / 4) <= 1
    ordered = [r.doc_id for r in mixing.mix_documents(docs, weights, block_chars=100).collect()]
    assert ordered == [r.doc_id for r in sorted(placed, key=lambda r: (r.slot, r["at"]))]


def test_mixing_keeps_nulls_and_repeats(docs, empty):
    odd = docs.withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.lit("a")))
    assert sorted(map(repr, mixing.mix_documents(odd).collect())) == sorted(map(repr, odd.collect()))
    assert mixing.mix_documents(empty.withColumn("source", F.lit("a"))).count() == 0


# -- 9 tokens -----------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000])
def test_permutation_and_its_inverse(n):
    slots = token_output.feistel(np.arange(n), n, 7)
    assert sorted(slots) == list(range(n)) and (token_output.feistel(slots, n, 7, backwards=True) == np.arange(n)).all()
    assert n < 64 or (slots != token_output.feistel(np.arange(n), n, 8)).any()


def test_words_encode_as_texts_do():
    with open(VOCABULARY, "rb") as f:
        w = token_output.Words(token_output.load_encoding(f.read()))
    for text in ("", " ", "a  b", " a b ", "a \nb\n c\n\n d", "don't 's 1234 x,y. <|endoftext|>", "ünï\u00a0 cödé \u00a0x", "tab\t x"):
        assert w.text(text) == w.encode(text)


def decoded(rows, width=2, end=50256, vocabulary=VOCABULARY):
    """The texts behind sequences (index, n_tokens, tokens)."""
    stream = [t for r in sorted(rows, key=lambda r: r["index"]) for t in np.frombuffer(r.tokens, dtype=f"<u{width}")[: r.n_tokens].tolist()]
    with open(vocabulary, "rb") as f:
        encoding = token_output.load_encoding(f.read())
    out, now = [], []
    for t in stream:
        if t == end:
            out.append(encoding.decode(now))
            now = []
        else:
            now.append(t)
    assert not now
    return sorted(out)


def test_round_trip(spark, docs, texts, empty, tmp_path):
    path = f"{tmp_path}/tokens"
    shards = token_output.write_shards(docs, path, VOCABULARY, length=64, rows_per_shard=10)
    n = shards.total
    rows = shards.slots().join(shards.owners(), "slot").collect()
    assert decoded(rows) == sorted(t or "" for _, t in texts)
    assert sorted(r.slot for r in rows) == list(range(n)) and n > 40
    by_index = token_output.feistel(np.arange(n), n, token_output.KEY)
    # The files themselves, read by seeking: row s mod k of shard s div k is what the permutation put there.
    cut = {r["index"]: r.tokens for r in rows}
    at = {int(by_index[i]): i for i in cut}
    files = {int(f.parent.name.partition("=")[2]): f for f in (tmp_path / "tokens/shards").glob("wave=*/shard=*/part-*")}
    assert sorted(files) == list(range(-(-n // 10)))
    for s in range(n):
        ids = token_output.map_shard(files[s // 10], length=64)[s % 10]
        assert ids.tobytes() == cut[at[s]] and len(cut[at[s]]) == 128
    assert all(by_index[r["index"]] == r.slot and (r.shard, r.place) == divmod(r.slot, 10) for r in rows)
    # A stretch over two shards, from their files only.
    some = shards.slots(5, 12)
    assert sorted(r.slot for r in some.collect()) == list(range(5, 12)) and shards.slots(n, n + 5).count() == 0
    assert sorted(i for i in {i for r in rows for i in r.ids} if i is not None) == sorted({i for i, _ in texts if i is not None})
    nothing = token_output.write_shards(empty, f"{tmp_path}/nothing", VOCABULARY)
    assert nothing.total == 0 and nothing.slots().count() == 0 and nothing.owners().count() == 0


def test_writing_goes_on_after_a_failure(spark, docs, texts, tmp_path):
    def write():
        return token_output.write_shards(docs, f"{tmp_path}/tokens", VOCABULARY, length=64, rows_per_shard=10)

    write()
    files = {w: {f.name: f.stat().st_mtime_ns for f in (tmp_path / f"tokens/shards/wave={w}").rglob("part-*")} for w in range(4)}
    (tmp_path / "tokens/shards/wave=2/_SUCCESS").unlink()
    shards = write()
    again = {w: {f.name: f.stat().st_mtime_ns for f in (tmp_path / f"tokens/shards/wave={w}").rglob("part-*")} for w in range(4)}
    assert [files[w] == again[w] for w in range(4)] == [True, True, False, True]
    assert decoded(shards.slots().join(shards.owners(), "slot").collect()) == sorted(t or "" for _, t in texts)


def test_wide_ids(spark, docs, texts, tmp_path):
    """A vocabulary of single bytes, numbered beyond two bytes."""
    ranks = tmp_path / "wide.tiktoken"
    ranks.write_bytes(b"\n".join(b"%s %d" % (token_output.base64.b64encode(bytes([i])), 70_000 + i) for i in range(256)))
    shards = token_output.write_shards(docs, f"{tmp_path}/tokens", str(ranks), length=32, end_token=80_000)
    assert shards.width == 4
    rows = shards.slots().join(shards.owners(), "slot").collect()
    assert decoded(rows, 4, 80_000, ranks) == sorted(t or "" for _, t in texts)


# -- 10 urls ------------------------------------------------------------------


URLS = [None, "", "no scheme", "http://NET/x", "http://a.net/", "http://a.net", "https://x.example.net/en/1?q#f", "http://example.com/de/2", "http://badexample.com/de/2", "ftp://b.org/fr/", "http://x.org/fr?de", "http://q/a://b.net/"]


def brute_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    fits = [r for r in rules if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.text), r.text), default=None)
    return host, path, best.text if best else None, best.verdict if best else "allow"


def test_verdicts_are_those_of_brute_force(spark):
    rng = random.Random(6)
    urls = URLS + [f"http://{'.'.join(rng.choices(['a', 'b', 'net', 'org', 'example', 'com'], k=rng.randint(1, 4)))}/{rng.choice(['en/', 'de/', 'fr/', 'e', ''])}{rng.randint(0, 9)}" for _ in range(300)]
    rules = [*url_filter.CONTRACT_RULES, url_filter.Rule("block", "a", ""), url_filter.Rule("allow", "b.net", "/e")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    expected = [(i, *brute_verdict(u, rules)) for i, u in enumerate(urls)]
    assert sorted(map(tuple, url_filter.apply_rules(df, rules).collect())) == expected
    table = spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")
    assert sorted(map(tuple, url_filter.join_rules(df, table).collect())) == expected
    assert {r.verdict for r in url_filter.apply_rules(df, [], default="block").collect()} == {"block"}
    assert url_filter.apply_rules(df.limit(0), rules).count() == 0


def test_rule_tables_of_any_size(spark, monkeypatch):
    """An index of 200,000 rules, and the join that takes over beyond the bounds."""
    urls = [(i, f"http://www.h{i * 977 % 400_000}.net/p{i % 3}/x") for i in range(500)] + [(500, None), (500, "http://h1.net/p1/")]
    df = spark.createDataFrame(urls, "page_id long, url string")
    rules = spark.range(200_000).selectExpr("if(id % 3 = 0, 'allow', 'block') AS verdict", "concat('h', id, '.net') AS host", "if(id % 2 = 0, '/p1/', null) AS path")
    rules = rules.unionAll(spark.createDataFrame([("block", None, "/"), ("block", "", "")], "verdict string, host string, path string"))

    def expected(i, url):
        _, host, path, _, _ = (i, *brute_verdict(url, []))
        n = int(re.search(r"h(\d+)\.net$", host)[1]) if host else 400_000
        fits = n < 200_000 and (n % 2 or path.startswith("/p1/"))
        return (i, host, path, f"h{n}.net" + ("" if n % 2 else "/p1/"), "allow" if n % 3 == 0 else "block") if fits else (i, host, path, None, "allow")

    wanted = sorted((expected(*u) for u in urls), key=repr)
    assert sorted(map(tuple, url_filter.apply_rule_table(df, rules).collect()), key=repr) == wanted
    monkeypatch.setattr(url_filter, "MAX_RULES", 1000)
    assert sorted(map(tuple, url_filter.apply_rule_table(df, rules).collect()), key=repr) == wanted


def test_equal_digests_are_told_apart(monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda k: len(k))
    index = url_filter.Index(url_filter.build_index([url_filter.Rule.parse("block", x) for x in ("ab/", "cd/", "efg/")]))
    assert [index.strings[slice(*index.spans[r, :2])].tobytes() if r >= 0 else None for r in index.probe([b"cd/", b"ab/", b"xy/", b"efg/", b"z"])] == [b"cd/", b"ab/", None, b"efg/", None]
