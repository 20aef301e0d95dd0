"""Work that is done once: texts go through extraction and cutting in one pass, and tiles in one exchange."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.config import MatchSettings
from plumbline.functions import near, text
from plumbline.functions.embed import HashEmbedder
from plumbline.functions.near import nearest_in_rows
from plumbline.operators import graph, match, score, tiles
from plumbline.plans import catalogue, pipeline
from plumbline.sources.views import split_documents


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_first_tokens_are_those_of_the_whole_text(spark):
    rows = [("Word " * 200 + "other words here",), ("x" * 600 + " abcd",), (" ".join(f"tok{i}x" for i in range(300)),), ("ab abc ABCD 1abcd abcd é",), ("",), (None,)]
    df = spark.createDataFrame(rows, "t string").select("t", *(text.first_tokens(F.col("t"), n).alias(f"f{n}") for n in (1, 3, 12)))
    for r in df.collect():
        own = None if r.t is None else list(dict.fromkeys(w for w in "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in r.t.lower()).split()))
        if own is not None:
            own = [w for w in dict.fromkeys(w.lstrip("0123456789") for w in own) if len(w) >= 4]
        assert [r.f1, r.f3, r.f12] == [own and own[:n] if own is None else own[:n] for n in (1, 3, 12)]


def test_graphs_are_extracted_once(spark, data):
    graphs = pipeline.extract_graphs(split_documents(spark, data, labelled=False))
    for df in (graphs.sources, graphs.answers, catalogue.graph_relations(spark, data)):
        assert "regexp_extract_all" not in plan(df) and "Join" not in plan(df)


def test_first_row_of_a_source_counts_for_both_kinds(spark):
    rows = [("r2", "s", "gamma", "delta", "alpha"), ("r1", "s", "alpha", "beta", "beta"), ("r3", None, "omega", None, "omega")]
    graphs = pipeline.extract_graphs(spark.createDataFrame(rows, "response_id string, source_id string, context string, query string, response string"))
    assert {(x.source_id, x.kind): x.entities for x in graphs.sources.collect()} == {("s", "context"): ["alpha"], ("s", "query"): ["beta"], (None, "context"): ["omega"], (None, "query"): []}
    assert {(x.response_id, x.source_id): x.entities for x in graphs.answers.collect()} == {("r1", "s"): ["beta"], ("r2", "s"): ["alpha"], ("r3", None): ["omega"]}
    assert graphs.failures.count() == 0


def test_phrases_are_cut_once(spark, data):
    for df in catalogue._phrases(spark, data):
        assert plan(df).count("split(") == 1 and "Aggregate" not in plan(df)


def test_tiles_take_equal_names_once_and_pass_one_exchange(spark):
    names = spark.createDataFrame([("s", x) for x in ("a b", "a b", "c", "zz")], "source_id string, norm string")
    refs = spark.createDataFrame([("s", x) for x in ("b", "b", "c", "c")], "source_id string, ref string")
    settings = MatchSettings(min_substring_chars=1)
    assert sorted(map(tuple, match.match_contained(names, refs, settings).collect())) == [("s", "a b", "b"), ("s", "c", "c")]
    assert sorted(map(tuple, match.match_entities(names, refs, settings).collect())) == [("s", "a b", "b", "substring"), ("s", "c", "c", "exact")]
    dealt = tiles.dealt(names.withColumnRenamed("norm", "text"), refs.withColumnRenamed("ref", "text"))
    assert plan(dealt).count("strategy=broadcast") == 1
    sizes = [b.num_rows for b in tiles.batched(((str(i),) for i in range(25)), pa.schema([("x", pa.string())]), 10)]
    assert sizes == [10, 10, 5]


def test_names_are_normalised_and_digested_once(spark, data):
    graphs = pipeline.extract_graphs(split_documents(spark, data, labelled=False))
    refs, ref_triples = score.reference_graphs(graphs.sources)
    assert plan(refs).count("lower(") == 1 and plan(ref_triples).count("lower(") == 3
    assert plan(HashEmbedder().embed(spark.createDataFrame([("a",)], "text string"))).count("md5(") == 1
    assert "lower(" not in plan(catalogue.score_with_embeddings(spark, data))


def test_sources_are_brought_together_once(spark, data):
    graphs = pipeline.extract_graphs(split_documents(spark, data, labelled=False))
    for df in (score.references(graphs.sources), *score.reference_graphs(graphs.sources)):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_graphs_are_aligned_in_one_join(spark, data):
    for query in (catalogue.align_forward, catalogue.align_inverse):
        assert plan(query(spark, data)).count("Join") == 1 and "MapInArrow" not in plan(query(spark, data))


@pytest.mark.parametrize("settings", [MatchSettings(), MatchSettings(inverse_edges=True), MatchSettings(inverse_edges=True, allow_substring=False)])
def test_alignment_in_rows_is_that_of_long_tables(spark, settings):
    rng = random.Random(3)
    ends = ["ab", "Ab c", "c", "x y", "zz", "zz q", "the zz", "The", "a.b", "", None, "é ab", "zz\n"]
    triples = f"array<{graph.TRIPLE}>"

    def made(n):
        entities = [rng.choice(ends) for _ in range(n)]
        return entities, [(rng.choice(entities), rng.choice(["is", "Was", "", None]), rng.choice(entities)) for _ in range(n)]

    sources = spark.createDataFrame([(s, k, *made(6)) for s in (*map(str, range(12)), None) for k in ("context", "query")], f"source_id string, kind string, entities array<string>, relations {triples}")
    answers = spark.createDataFrame([(s, *made(9)) for s in (*map(str, range(14)), None) for _ in "ab"], f"source_id string, entities array<string>, relations {triples}")
    refs, ref_triples = score.reference_graphs(sources)
    own = answers.select("source_id", F.inline(score.normal_triples("relations"))).distinct()
    gates = own.select("source_id", F.explode(F.array(*(text.normalize(F.col(c)) for c in "so"))).alias("norm"))
    wanted = match.align_relations(own, ref_triples, match.match_entities(gates, refs, settings), settings).collect()
    got = score.align(answers, sources, settings)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted)) and got.columns == list(wanted[0].asDict())
    assert {r.method for r in wanted} == ({"forward", "inverse"} if settings.inverse_edges else {"forward"})


def test_plain_words_are_as_they_are_when_normalised(spark):
    rows = spark.createDataFrame([(x,) for x in ("ab1", "the", "ab\n", "Ab", "a b", "_a", "é", "", None)], "x string")
    got = rows.select(text.is_plain(F.col("x")), text.normalize(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [(True, "ab1"), (True, "the"), (False, "ab"), (False, "ab"), (False, "b"), (False, "a"), (False, "é"), (False, ""), (None, "")]


def test_vectors_of_texts_are_drawn_where_they_are_needed(spark, data):
    assert "Join" not in plan(catalogue.score_with_embeddings(spark, data))
    embedder, texts = HashEmbedder({"given": [0.0] * 16}), ["a", "é b", "", "given", "x" * 99]
    stored = {r.text: r.embedding for r in embedder.embed(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert all(stored[t] == v for t, v in zip(texts, embedder.draw(texts).tolist()))
    assert HashEmbedder(dim=20).draw(["a"]).tolist()[0] == HashEmbedder(dim=20).embed(spark.createDataFrame([("a",)], "text string")).first().embedding


def test_nearest_in_rows_takes_the_first_of_equals():
    kind = pa.list_(pa.list_(pa.float32()))
    queries = pa.array([[[9, 9]], [[1, 0], [0, 1]], [], None, [[1, 1]]], kind).slice(1)
    known = pa.array([[[9, 9]], [[0, 1], [1, 0], [1, 0]], [[1, 0]], [[1, 0]], []], kind).slice(1)
    got = nearest_in_rows(queries, known).to_pylist()
    assert got == [[{"i": 1, "sim": 1.0}, {"i": 0, "sim": 1.0}], [], [], [{"i": 0, "sim": -np.inf}]]
    assert nearest_in_rows(pa.array([["b"]]), pa.array([["a", "b"]]), HashEmbedder().draw).to_pylist()[0][0]["i"] == 1


def test_scores_are_the_same_with_drawn_and_with_stored_vectors(spark):
    class Stored(HashEmbedder):
        row_local = False

    rng, triples = random.Random(8), f"array<{graph.TRIPLE}>"
    words = [f"w{i}" for i in range(60)] + ["w1 w2", "The w3", "", "w4."]

    def made(n):
        entities = [rng.choice(words) for _ in range(n)]
        return entities, [(rng.choice(entities), rng.choice(["is", "was"]), rng.choice(entities)) for _ in range(n)]

    sources = spark.createDataFrame([(str(i), "context", *made(12)) for i in range(30)] + [("none", "context", [], [])], f"source_id string, kind string, entities array<string>, relations {triples}")
    answers = spark.createDataFrame([(f"{s}{i}", s, *made(8)) for s in (*map(str, range(30)), "none") for i in "ab"], f"response_id string, source_id string, entities array<string>, relations {triples}")
    settings = MatchSettings(entity_threshold=0.4, relation_threshold=0.4, inverse_edges=True)
    drawn, stored = (sorted(map(tuple, score.score(answers, sources, settings, e).collect())) for e in (HashEmbedder(), Stored()))
    assert drawn == stored and any(x["method"] == "embedding" for r in score.score(answers, sources, settings, HashEmbedder()).collect() for x in r.matched_entities)


def test_rows_of_one_shape_are_compared_together(monkeypatch):
    rng, words = random.Random(4), [f"w{i}" for i in range(300)]
    queries, known = ([[rng.choice(words) for _ in range(rng.choice(sizes))] for _ in range(200)] for sizes in ((0, 3, 3, 7), (0, 5, 5, 9)))
    vectors, got, calls = dict(zip(words, HashEmbedder().draw(words).astype(float).tolist())), [], []
    cumsum = np.cumsum
    monkeypatch.setattr(np, "cumsum", lambda *a, **b: (calls.append(a), cumsum(*a, **b))[1])
    for room in (near.PRODUCTS, 40):
        monkeypatch.setattr(near, "PRODUCTS", room)
        got.append(near.nearest_in_rows(pa.array(queries), pa.array(known), HashEmbedder().draw).to_pylist())
    assert len(calls) < 20  # not one for each row
    assert got[0] == got[1]
    for names, refs, found in zip(queries, known, got[0]):
        for name, x in zip(names, found):
            sims = []
            for ref in refs:
                total = 0.0
                for a, b in zip(vectors[name], vectors[ref]):
                    total += a * b
                sims.append(total)
            best = max(sims, default=-np.inf)
            assert (x["i"], x["sim"]) == (sims.index(best) if sims else 0, best)


def test_answers_stand_beside_their_sources_in_one_exchange(spark):
    rng, words = random.Random(5), ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa"]

    def made():
        return rng.choice([None, "", *(" ".join(rng.choice(words) for _ in range(5)) for _ in range(8))])

    rows = [(rng.choice([None, f"r{i}", f"r{i % 7}"]), rng.choice([None, "s", "t", *map(str, range(12))]), made(), made(), made()) for i in range(80)]
    instances = spark.createDataFrame(rows, "response_id string, source_id string, context string, query string, response string")
    pairs = pipeline.paired_graphs(instances)
    assert plan(pairs).count("Join") == 0 and pairs._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    graphs = pipeline.extract_graphs(instances)
    for embedder in (None, HashEmbedder()):
        wanted, got = score.score(graphs.answers, graphs.sources, None, embedder), score.score_pairs(pairs, None, embedder)
        assert got.columns == wanted.columns and sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))
    assert got.filter("Vq > 0 AND RP > 0").count()


def test_low_lines_inside_words_need_no_normalising(spark):
    wanted = {"co_occurs_with": "co_occurs_with", "a__b": "a__b", "_a": "a", "a_": "a", "_": "", "a_\n": "a", "A_b": "a_b", "the_x": "the_x", "the a_b": "a_b"}
    rows = spark.createDataFrame([(x,) for x in wanted], "x string")
    assert {r.x: r.n for r in rows.select("x", text.normalize(F.col("x")).alias("n")).collect()} == wanted
    as_is = rows.filter(F.col("x").rlike(text._AS_IS))
    assert {r.x for r in as_is.collect()} == {"co_occurs_with", "a__b", "the_x"}
