"""Matching in tiles against plain loops: containment by automata, vectors in blocks, triples by their ends."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.config import MatchSettings
from plumbline.functions.contain import contained
from plumbline.functions.near import Blocks
from plumbline.operators import match, tiles

STOP = ("the", "of")


def stands_in(short, long):
    return re.search(rf"(?<![^\W])(?<!\w){re.escape(short)}(?!\w)", long) is not None


def pairs(names, refs, least=2, stop=STOP):
    out = set()
    for n, r in itertools.product(names, refs):
        short, long = (n, r) if len(n) <= len(r) else (r, n)
        if len(short) >= least and short not in stop and stands_in(short, long):
            out.add((n, r))
    return out


def phrases(rng, n):
    words = ["ab", "abc", "b", "the", "of", "éa", "x_y", "9", "a-b", "%", "日本", "ab.c"]
    return sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(n)})


def test_automata_find_what_patterns_find():
    rng = random.Random(2)
    for _ in range(60):
        names, refs = phrases(rng, 25), phrases(rng, 25)
        got = list(contained(names, refs, 2, STOP))
        assert len(got) == len(set(got)) and set(got) == pairs(names, refs)
    assert list(contained([], ["a b"], 1, ())) == [] and list(contained(["a"], [], 1, ())) == [] and list(contained(["", "a"], ["", "b"], 0, ())) == []


def tables(spark, rng, sources):
    names = [(f"s{i}", x) for i in range(sources) for x in phrases(rng, 12)] + [("hot", x) for x in phrases(rng, 300)] + [("names only", "ab"), (None, "ab")]
    refs = [(f"s{i}", x) for i in range(sources) for x in phrases(rng, 12)] + [("hot", x) for x in phrases(rng, 300)] + [("refs only", "ab"), (None, "ab")]
    return names, refs, spark.createDataFrame(names, "source_id string, norm string").repartition(5), spark.createDataFrame(refs, "source_id string, ref string").repartition(3)


@pytest.mark.parametrize("tile_rows", [7, 20_000])
def test_containment_in_tiles(spark, tile_rows):
    names, refs, n, r = tables(spark, random.Random(4), 20)
    settings = MatchSettings(stopwords=STOP)
    got = [tuple(x) for x in match.match_contained(n, r, settings, tile_rows).collect()]
    sources = {s for s, _ in names if s}
    expected = {(s, a, b) for s in sources for a, b in pairs([x for t, x in names if t == s], [x for t, x in refs if t == s])}
    assert len(got) == len(set(got)) and set(got) == expected
    first = {(x.source_id, x.norm): (x.ref, x.method) for x in match.match_named(n, r, settings, tile_rows).collect()}
    for s, a in names:
        known = {x for t, x in refs if t == s}
        whole = (a, "exact") if a in known else None
        inside = min((b for t, x, b in expected if (t, x) == (s, a)), default=None)
        assert first.get((s, a)) == (whole or (inside and (inside, "substring")) if s else None)
    assert match.match_contained(n.limit(0), r, settings).count() == 0 and match.match_named(n, r.limit(0), settings).count() == 0


def test_hot_source_is_many_tiles_of_a_bounded_size(spark):
    _, _, n, r = tables(spark, random.Random(4), 20)
    dealt = tiles.dealt(n.withColumnRenamed("norm", "text"), r.withColumnRenamed("ref", "text"), 50)
    sizes = dealt.groupBy("source_id", "i", "j", "is_ref").count().collect()
    assert max(x["count"] for x in sizes) < 2.5 * 50 and len({(x.i, x.j) for x in sizes if x.source_id == "hot"}) > 4
    assert {(x.i, x.j) for x in sizes if x.source_id != "hot"} == {(0, 0)}


def clustered(rng, n, dim=24):
    centers = rng.normal(size=(n // 40, dim))
    out = centers[rng.integers(len(centers), size=n)] + rng.normal(size=(n, dim)) * 0.05
    return (out / np.linalg.norm(out, axis=1, keepdims=True)).astype(np.float32)


def test_blocks_compare_few_and_miss_none():
    rng = np.random.default_rng(7)
    refs = clustered(rng, 2000)
    refs[1500:1510] = refs[3]
    queries = [*refs[:30] + rng.normal(size=(30, 24)).astype(np.float32) * 0.01, refs[3], np.zeros(24)]
    blocks = Blocks(refs)
    exact = refs.astype(float) @ np.array(queries, dtype=float).T
    for i, q in enumerate(queries):
        best = blocks.nearest(q)
        assert max(s for _, s in best) == pytest.approx(exact[:, i].max(), abs=1e-12)
        assert {3, *range(1500, 1510)} <= {r for r, _ in best} or i != 30
    assert len(blocks.nearest(np.zeros(24))) == 2000  # all are alike
    blocks.compared = 0
    for q in queries[:31]:
        blocks.nearest(q)
    assert blocks.compared < 31 * 2000 / 10
    for i, q in enumerate(queries[:31]):
        found = dict(blocks.within(q, 0.9))
        assert {r for r in found} == set(np.flatnonzero(exact[:, i] >= 0.9).tolist())
    odd = Blocks(np.array([[0.0, 0.0], [3.0, 0.0], [0.0, 0.5]]))  # of any length, zero too
    assert [r for r, _ in odd.nearest([1, 0])] == [1] and [r for r, _ in odd.nearest([-1, 0.1])] == [2] and dict(odd.within([1, 1], 0.5)) == {1: 3.0, 2: 0.5}


@pytest.mark.parametrize("tile_rows", [9, 5000])
def test_nearest_and_near_pairs_in_tiles(spark, tile_rows):
    rng = np.random.default_rng(9)
    vecs = clustered(rng, 160, 8)
    vecs[50:60] = vecs[7]
    rows = [(f"t{i:03}", [float(x) for x in v]) for i, v in enumerate(vecs)]
    side = [(("hot" if i % 3 else f"s{i % 6}"), t, i % 4 == 0) for i, (t, _) in enumerate(rows)]
    table = spark.createDataFrame(side, "source_id string, text string, asks boolean")
    names, refs = table.filter("asks").select("source_id", F.col("text").alias("norm")), table.filter("not asks").select("source_id", F.col("text").alias("ref"))
    vectors = spark.createDataFrame(rows, "text string, embedding array<float>")
    where = {t: i for i, (t, _) in enumerate(rows)}
    sim = vecs.astype(float) @ vecs.astype(float).T
    got = {(x.source_id, x.norm): (x.ref, x.sim) for x in match.nearest(names, refs, vectors, tile_rows).collect()}
    wanted, close = {}, set()
    for s, a, asks in side:
        if asks:
            own = [(-round(sim[where[a], where[b]], 12), b) for t, b, other in side if t == s and not other]
            wanted[(s, a)] = min(own)[1]
            close |= {(s, a, b) for d, b in own if -d >= 0.8}
    assert {k: v[0] for k, v in got.items()} == wanted
    assert all(v[1] == pytest.approx(sim[where[k[1]], where[v[0]]]) for k, v in got.items())
    assert {(x.source_id, x.norm, x.ref) for x in match.near_pairs(names, refs, vectors, 0.8, tile_rows).collect()} == close


@pytest.mark.parametrize("inverse,fuzzy", [(False, False), (True, False), (True, True)])
def test_alignment_is_the_loop_over_triples(spark, inverse, fuzzy):
    rng = random.Random(5)
    ends = ["ab", "ab c", "c", "x y", "zz", "zz q", "the zz"]
    predicates = ["is", "was", "has"]
    make = lambda n: sorted({("s" + str(rng.randrange(3)), rng.choice(ends), rng.choice(predicates), rng.choice(ends)) for _ in range(n)})
    triples, refs = make(60), make(25)
    settings = MatchSettings(inverse_edges=inverse, entity_threshold=0.9, relation_threshold=0.9, min_substring_chars=2)
    angle = {**{e: 0.3 * i for i, e in enumerate(ends)}, "zz": 0.0, "is": 2.0, "was": 2.1, "has": 4.0}
    vectors = spark.createDataFrame([(t, [float(np.cos(a)), float(np.sin(a))]) for t, a in angle.items()], "text string, embedding array<double>") if fuzzy else None
    t = spark.createDataFrame(triples, "source_id string, s string, p string, o string")
    r = spark.createDataFrame(refs, "source_id string, s2 string, p2 string, o2 string")
    gates = spark.createDataFrame([(s, e.removeprefix("the ")) for s in ("s0", "s1", "s2") for e in ends if e != "x y"], "source_id string, norm string")

    def near(a, b, least):
        return fuzzy and np.cos(angle[a] - angle[b]) >= least

    def same(a, b):
        return a == b or bool(pairs([a], [b], 2, settings.stopwords)) or near(a, b, 0.9)

    expected = set()
    for source, s, p, o in triples:
        if "x y" in (s, o):
            continue
        ways = []
        for other, s2, p2, o2 in refs:
            if other == source and (p == p2 or near(p, p2, 0.9)):
                if same(s, s2) and same(o, o2):
                    ways.append((s2, p2, o2, "forward"))
                elif inverse and same(s, o2) and same(o, s2):
                    ways.append((s2, p2, o2, "inverse"))
        if ways:
            expected.add((source, s, p, o, *min(ways)))
    got = [tuple(x) for x in match.align_relations(t, r, gates, settings, vectors).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and expected
