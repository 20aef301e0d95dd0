"""Cases in which an operator once did less than the whole job."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import html_text, minhash, mixing, sharding
from plumbline.llm.common import shared_folder


def test_shards_follow_the_schedule(spark, tmp_path):
    """Through files of odd sizes, whose order a reader does not keep."""
    rows = [(i, "x" * (1 + 37 * i % 211), "big" if i % 10 else "small", None) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard string").drop("shard")
    mixed = corpus_pipeline.mixing.with_slots(docs, {"big": 0.5, "small": 0.5}, block_chars=1000)
    slot, at = mixed.columns[-2:]
    mixed.repartition(7, F.expr("doc_id div 13")).write.parquet(f"{tmp_path}/mixed")
    out = corpus_pipeline.shard_output(spark, spark.read.parquet(f"{tmp_path}/mixed"), "").collect()
    wanted = [r.doc_id for r in sorted(mixed.collect(), key=lambda r: (r[slot], r[at]))]
    assert [r.doc_id for r in sorted(out, key=lambda r: (r.shard, r.place))] == wanted


@pytest.mark.parametrize("target", [3000, 20_000])
def test_ordered_runs_keep_the_order(spark, target):
    """Full shards, between small ones too, stand where they belong."""
    rng = random.Random(5)
    rows = [(i, "".join(chr(rng.randrange(97, 123)) for _ in range(400 if 200 <= i < 260 else 5))) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(40, "doc_id").sortWithinPartitions("doc_id")
    store = sharding.ShardStore(spark, shared_folder(spark, "ordered"), target_bytes=target)
    store.append(docs, rows=10)
    version = store.compact(ordered=True)
    placed = store.read(places=True).collect()
    assert len({r.shard for r in placed}) > 2
    assert [r.doc_id for r in sorted(placed, key=lambda r: (r.shard, r.place))] == list(range(1200))
    assert store.compact(ordered=True) == version


def test_pairs_among_a_templates_texts_are_found(spark):
    """Texts that share most of a template, in many pairs of near copies."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    template, rows = [word() for _ in range(200)], []
    for _ in range(40):
        own = template + [word() for _ in range(42)]
        rows += [" ".join(own), " ".join([*own, word(), word(), word()])]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    # Two texts of different pairs share 196 of 280 and more shingles, 0.7 at most.
    got = {r.doc_id: r.class_id for r in minhash.near_duplicate_classes(docs).collect()}
    assert got == {i: i - i % 2 for i in range(80)}


@pytest.mark.parametrize("block", [7, 1024])
def test_families_in_tiles_lose_no_link(spark, monkeypatch, block):
    """Copies of one text with many edits each, of which some share edits; repeated words count."""
    from test_operators import brute_classes

    monkeypatch.setattr(minhash, "BLOCK_TEXTS", block)
    rng = random.Random(9)
    base = [f"w{rng.randrange(60)}" for _ in range(120)]
    rows, versions = [], [base]
    for i in range(120):
        copy = list(rng.choice(versions[-12:]))
        for _ in range(rng.choice((1, 2, 4, 5))):
            copy[rng.randrange(120)] = f"edit{rng.randrange(400)}"
        if i % 3 == 0:
            versions.append(copy)
        rows.append((i, " ".join(copy)))
    got = minhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.class_id, r.class_size, r.doc_id) for r in got) == brute_classes(rows)
    assert 5 < len({r.class_id for r in got}) < 100


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body>a <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math> b", "a x=1 b"),
        ("<p>a<svg><title>no</title><defs><text>no</text></defs><g><text>one</text><text>two</text></g></svg>", "a\none\ntwo"),
        ("<body>a<svg width='1' /> b<math/> c<svg><path d=''/><title/><text>d</text></svg>", "a b c\nd"),
        ("<body><svg><path><p>left</p> more", "left\n\nmore"),
        ("<svg><text><![CDATA[a &lt; b > c]]></text></svg>", "a &lt; b > c"),
        ("<select><option>a<option selected>b<option>c</select>d", "b\nd"),
        ("<select><option disabled>a<option>b<option>c</select>", "b"),
        ("<select multiple><option>a<option>b</select>", "a\nb"),
        ("<p>x <textarea>\n one\n<b>two</textarea> y", "x\n one\n<b>two\ny"),
        ("<body>a<textarea></textarea><pre>\nb</pre>", "a\n\nb"),
    ],
)
def test_formulas_drawings_and_forms_show(page, text):
    assert html_text.render(page) == text


def test_schedule_keeps_the_given_weights():
    """Over many periods, for a tiny weight too, and after sources ran out."""
    weights = [0.5, 0.3, 0.19998765, 1e-5, 0.1]
    blocks = [30_000, 17_000, 12_000, 3, 40]
    had = [0] * 5
    for t, (s, i) in enumerate(mixing.schedule(blocks, weights), 1):
        assert i == had[s]
        had[s] += 1
        if had[4] < 39 and t < 400:
            assert all(abs(n - t * w / sum(weights)) < 1 for n, w in zip(had, weights))
        elif t % 97 == 0:
            low, high = 0.0, 1e6  # the virtual time of slot t
            for _ in range(80):
                mid = (low + high) / 2
                low, high = (mid, high) if sum(min(w * mid, n) for w, n in zip(weights, blocks)) < t else (low, mid)
            assert all(abs(n - min(w * low, b)) < 1 + 1e-6 for n, w, b in zip(had, weights, blocks))
    assert had == blocks


def test_sources_have_no_limit(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "repeat('x', 50) AS text", "concat('site', id % 2500) AS source")
    assert len({(r.slot, r["at"]) for r in mixing.mixture_order(docs, block_chars=100).collect()}) == 6000
